import hashlib
import hmac
import random

from conftest import SF
from pyspark.sql import functions as F

from payproof import scale
from payproof import schema as S
from payproof.operators import anonymise, evidence, review, scoring, trail
from payproof.plans import bridge, catalogue


def test_cases_join_findings_that_share_a_text(spark):
    f = bridge.view(spark, SF, "findings")
    got = {(r["dataset_id"], r["finding"]): r["case"] for r in review.cases(f).collect()}
    owner, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in f.collect():
        me = (r["dataset_id"], r["finding"])
        parent[me] = me
        for t in (r["evidence"], r["related_text"]):
            if t:
                k = (r["dataset_id"], r["source_file"], t)
                if k in owner:
                    parent[find(me)] = find(owner[k])
                else:
                    owner[k] = me
    want = {}
    for x in parent:
        want.setdefault(find(x), []).append(x[1])
    assert all(got[x] == min(want[find(x)]) for x in parent) and len(want) < len(parent)



def test_only_shared_texts_are_walked_for_cases(spark, monkeypatch):
    rows = [("D", n, "f.csv", f"own {n}", "") for n in range(1, 60)] + [("D", 100, "f.csv", "own 7", "own 9"), ("D", 101, "f.csv", "x", None), ("E", 7, "f.csv", "own 7", "")]
    seen = []

    def counted(edges):
        seen.append(edges.count())
        return scale.components(edges)
    monkeypatch.setattr(review, "components", counted)
    got = {(r["dataset_id"], r["finding"]): r["case"] for r in review.cases(spark.createDataFrame(
        rows, "dataset_id string, finding long, source_file string, evidence string, related_text string")).collect()}
    assert len(got) == 62 and seen == [2]
    assert {k for k, case in got.items() if case != k[1]} == {("D", 9), ("D", 100)} and got["D", 9] == got["D", 100] == 7


def test_credit_is_one_by_one(spark):
    rng = random.Random(7)
    # K9 stands before K10 in the key, whatever their ids' order as text
    pairs = [("A", "rules", p, f"K{k}", k, "problem", rng.random() < 0.4, "Confirmed") for p in range(40) for k in rng.sample(range(25), rng.randrange(1, 5))]
    df = spark.createDataFrame(pairs, "dataset_id string, engine string, finding long, id string, position long, expect string, own boolean, verdict string")
    taken, want = set(), {}
    for p in range(40):
        mine = sorted((not x[6], x[4], x[3]) for x in pairs if x[2] == p)
        pick = next((k for *_, k in mine if k not in taken), None)
        if pick:
            taken.add(pick)
            want[p] = pick
    assert {r["finding"]: r["id"] for r in scoring.credit(df).collect()} == want


def test_chain_seal_and_tampering(spark):
    t = bridge.view(spark, SF, "trail").where("dataset_id = 'D1'")
    log, key = trail.append(t, batch=50), b"k" * 70
    rows = sorted(log.collect(), key=lambda r: r["seq"])
    prev = S.GENESIS
    for r in rows:
        words = "\x1f".join(r[f] for f in trail.FIELDS)
        assert r["prev"] == prev and r["hash"] == hashlib.sha256((prev + words).encode()).hexdigest()
        prev = r["hash"]
    seals = trail.seals(log, key)
    assert seals.first()["seal"] == hmac.new(key, f"{len(rows)}|{prev}".encode(), hashlib.sha256).hexdigest()

    def broken(df):
        r = trail.verify(df, key, seals).first()
        return None if r["intact"] else r["broken_at"]
    at = rows[20]["seq"]
    assert broken(log) is None
    assert broken(log.withColumn("detail", F.when(F.col("seq") == at, "x").otherwise(F.col("detail")))) == 20
    assert broken(log.where(F.col("seq") != at)) == 20
    assert broken(log.where(F.col("seq") < rows[-1]["seq"])) == len(rows) - 1


def test_anonymised_files_give_the_same_findings(spark):
    rows = catalogue.QUERIES["anon_invariant"](spark, SF).collect()
    assert all(r["differing"] == 0 for r in rows) and sum(r["findings"] for r in rows) > 100


def test_unverified_quotes_do_not_pass(spark):
    f, n = bridge.view(spark, SF, "findings"), bridge.view(spark, SF, "lines")
    bad = evidence.verify(f, n).where("NOT verified").collect()
    assert bad and all(r["line_number"] % 97 == 0 or r["related_text"] == "no such line" for r in bad)


def test_scrubbed_text_keeps_parties_apart(spark):
    said = ["Pay GB29 NWBK 6016 1331 9268 19 for Kate Lowe", "Pay GB29 NWBK 6016 1331 9268 18 for Kate Lowry", "acct no: **77-123 SSN 123-45-6789", "acct no: 77123 SSN 123-45-6780",
            "call (020) 7946 0958 or +44 20 7946 0959", "Kate Lowe met K. Lowe, mail k.lowe@ashby.co.uk", "Team Dinner at 12 High Street, SW1A 1AA", "PLAIN WORDS only", "", None, "a\ue000b"]
    rows = spark.createDataFrame(list(enumerate(said)), "n int, text string").select("n", anonymise.scrub(F.col("text"), "k", free=True).alias("t"))
    got = [r["t"] for r in rows.orderBy("n").collect()]
    ids = {r["digits"]: r["fake"] for r in anonymise.id_map(spark.createDataFrame([("77-123",), ("77123",), ("123-45-6789",), ("123-45-6780",), ("29601613319268 19",)], "value string"), "k").collect()}
    assert len(ids) == 4 and got[2].startswith(f"acct no: **{ids['77123'][:2]}-{ids['77123'][2:]} SSN ") and got[3].startswith(f"acct no: {ids['77123']} SSN ")
    assert "".join(c for c in got[0] if c.isdigit()) == ids["2960161331926819"] and got[0].startswith("Pay GB") and got[0].split(" for ")[0] != got[1].split(" for ")[0]
    one, two = [g.split("SSN ")[1] for g in got[2:4]]
    assert one.replace("-", "") == ids["123456789"] and one != two and not {one, two} & {"123-45-6789", "123-45-6780"}
    kate, lowry = got[0].split(" for ")[1], got[1].split(" for ")[1]
    assert "Lowe" not in kate and kate.split()[0] == lowry.split()[0] and kate.split()[1] != lowry.split()[1]
    first, rest = got[5].split(" met ")
    assert first == kate and rest == f"{kate[0]}. {kate.split()[1]}, mail someone@example.com"
    assert "7946 0958" not in got[4] and got[4][:6] == "call (" and len(got[4]) == len(said[4])
    assert got[6:] == ["Team Dinner at 1 Example Street, AB1 2CD", "PLAIN WORDS only", "", None, "ab"]


def test_a_quote_that_a_third_of_all_lines_repeat(spark):
    lines = spark.range(30000).select(F.lit("A").alias("dataset_id"), F.lit("f").alias("source_file"), F.col("id").alias("line_number"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("line "), "id")).alias("text"))
    found = spark.createDataFrame([("A", 1, "f", 3, "same", "line 4", 4), ("A", 2, "f", 4, "same", "", None), ("A", 3, "f", 5, "line 5", "no line", 7)],
                                  "dataset_id string, finding long, source_file string, line_number long, evidence string, related_text string, related_line long")
    assert [(r["finding"], r["verified"], r["matched_n"]) for r in evidence.verify(found, lines).orderBy("finding").collect()] == [(1, True, 10001), (2, False, 10000), (3, False, 1)]
