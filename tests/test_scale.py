import random

from conftest import SF
from pyspark.sql import functions as F

from payproof import scale
from payproof.operators import gate
from payproof.plans import bridge
from payproof.scale import checkpointed
from payproof.sources.textfiles import latest


def test_running_counts_only_earlier_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "LINE_BLOCK", 8)
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(6), n, rng.randrange(-50, 90)) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, day int, line long, v long").repartition(5)
    got = {r["line"]: (r["before"], r["nth"]) for r in scale.running(
        df, ["k"], [("_d", F.col("day")), ("_b", scale.line_block(F.col("line")))], [F.col("line")], {"before": F.col("v"), "nth": F.lit(1)}).collect()}
    for k, d, n, _ in rows:
        earlier = [r for r in rows if r[0] == k and (r[1], r[2]) < (d, n)]
        assert got[n] == (sum(r[3] for r in earlier), len(earlier))


def test_latest_carries_over_blocks(spark, monkeypatch):
    import payproof.sources.textfiles as t
    monkeypatch.setattr(t, "line_block", lambda c: F.floor(c / 4))
    rows = [("A", n, n if n in (3, 9, 10, 27) else None) for n in range(1, 40)]
    df = spark.createDataFrame(rows, "dataset_id string, line_number long, head long").repartition(3)
    got = {r["line_number"]: r["head_at"] for r in latest(df, "head").collect()}
    heads = [3, 9, 10, 27]
    assert all(got[n] == max((h for h in heads if h <= n), default=None) for n in got)


def test_components_match_union_find(spark):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"h{i}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in scale.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    groups = {}
    for n in got:
        groups.setdefault(find(n), set()).add(n)
    assert all({got[n] for n in g} == {min(g)} for g in groups.values())


def test_facts_are_sent_whole_only_while_few(spark, monkeypatch):
    lines = spark.range(1000).selectExpr("id % 3 AS file", "id")
    few = spark.range(3).selectExpr("id AS file", "id * 10 AS told")
    plan = lambda: lines.join(scale.facts(few), "file")
    assert "BroadcastHashJoin" in plan()._jdf.queryExecution().executedPlan().toString() and plan().count() == 1000
    monkeypatch.setattr(scale, "FEW_ROWS", 2)
    assert "SortMergeJoin" in plan()._jdf.queryExecution().executedPlan().toString() and plan().count() == 1000


def test_the_gate_reads_payments_once(spark):
    n = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: n.add(1) or x)
    v, a, p = (bridge.view(spark, SF, k).limit(300) for k in ("vendors", "approvals", "payments"))
    p = checkpointed(p)
    rows = p.count()
    d = gate.evaluate(bridge.view(spark, SF, "payment_run").limit(100), v, a, p.withColumn("dataset_id", seen("dataset_id")))
    assert d.count() == 100 and n.value == rows


def test_payments_are_worked_out_once_for_a_query(spark):
    for name, v in zip(("findings", "lines"), bridge.views(spark, SF, ["findings", "lines"]), strict=True):
        assert not any("lineitem" in f for f in v.inputFiles())
        plain = bridge.run_sql(spark, SF, bridge.VIEWS[name])
        assert v.exceptAll(plain).isEmpty() and v.count() == plain.count() > 0
