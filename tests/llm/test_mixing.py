import hashlib
import math
import re

from pyspark.sql import functions as F

from helpers_llm import corpus, docs, ids_with_gaps  # noqa: F401
from payproof.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Shares by weight, with the excess of full sources shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    open_, left, target = set(order), sum(sizes.values()), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_equals_brute_force(docs):
    texts = corpus(7, 90, longest=200)
    ids = ids_with_gaps(len(texts))
    table = docs(texts, ids)
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in table.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = brute_targets(sizes)
    want = []
    for s in sizes:
        at = 0
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: ("" if r[0] is None else hashlib.md5(str(r[0]).encode()).hexdigest(), r[2])):
            demand = math.floor(target[s] + 0.5)
            want.append((d, n, sizes[s], round(target[s], 6), sum(max(0, min(n, demand - p * sizes[s] - at)) for p in range(3))))
            at += n
    got = mixing.plan(table, ["doc_id"]).collect()
    assert sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        places = [p.position for p in r.passes]
        assert places == sorted(places) and all(0 <= p <= 1 for p in places) and r.taken <= 3 * r.size


def test_positions_follow_the_schedule():
    """At progress t a source has given the integral of its weight up to t."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    got = spark.range(11).select((F.col("id") / 10).alias("f")).select("f", mixing.position(F.col("f"), F.lit(True)).alias("up"), mixing.position(F.col("f"), F.lit(False)).alias("down")).collect()
    for r in got:
        assert abs(0.5 * r.up + r.up ** 2 / 2 - r.f) < 1e-12 and abs(1.5 * r.down - r.down ** 2 / 2 - r.f) < 1e-12


def test_mixed_documents(docs):
    texts = [f"w{i} " * (i + 1) for i in range(30)] + [None, ""]
    table = docs(texts)
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.plan(table, ["doc_id"]).collect()}
    out = mixing.mixed(table)
    assert out.columns == table.columns
    words = {}
    for r in out.collect():
        words.setdefault(r.doc_id, []).append(len(WORD.findall(r.text)))
        assert r.n_chars == len(r.text)
    assert {d: sum(w) for d, w in words.items()} == {d: taken for d, (_, taken) in plan.items() if taken}
    assert mixing.mixed(table.where(F.lit(False))).collect() == [] and mixing.plan(table.where(F.lit(False)), ["doc_id"]).collect() == []


def test_sources_without_a_word(docs):
    """Their target is 0: nothing is taken of them, and the other sources aren't hindered."""
    table = docs([None, "a b c", "", "d e", " \n", "f g h i"], [1, 2, 3, 4, 5, 6]).withColumn("source", F.when(F.col("doc_id") % 2 == 1, "empty").otherwise("full"))
    got = {r.doc_id: (r.source_size, r.target, r.taken, len(r.passes)) for r in mixing.plan(table, ["doc_id"]).collect()}
    assert all(got[i] == (0, 0.0, 0, 0) for i in (1, 3, 5)) and sum(got[i][2] for i in (2, 4, 6)) == 9
    assert {r.doc_id for r in mixing.mixed(table).collect()} == {2, 4, 6}
    blank = table.where("source = 'empty'")
    assert [(r.target, r.taken) for r in mixing.plan(blank, ["doc_id"]).collect()] == [(0.0, 0)] * 3 and mixing.mixed(blank).collect() == []
