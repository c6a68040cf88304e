import random

from conftest import BANK, PAYMENT, bank_line, payment

from payproof import schema as S
from payproof.operators import reconcile
from payproof.operators.reconcile import any_sum, pick_sum
from payproof.plans.audit import Files, run_area

L = S.LIMITS


def brute(bank, pays):
    """One pass over the whole statement at a time, every payment looked at for every line."""
    used, exact, near = set(), set(), set()

    def attempt(b, cents_list):
        d, ref = b[3], (b[7] + " " + b[4]).lower()
        for c in cents_list:
            open_ = [p for p in pays if p[2] not in used and round(p[12] * 100) == c and abs((p[5] - d).days) <= 5]
            if open_:
                best = min(open_, key=lambda p: (p[4].lower() not in ref, not (p[9] and p[9].lower() in ref), p[5], p[2]))
                used.add(best[2])
                return best[2]
    todo = sorted(bank, key=lambda b: (b[3], b[2]))
    left = []
    for b in todo:
        got = attempt(b, [round(-b[5] * 100)])
        exact.add((b[2], got)) if got else left.append(b)
    for b in left:
        k = round(-b[5] * 100)
        got = attempt(b, [k + s * n for n in range(1, 6) for s in (-1, 1)])
        if got:
            near.add((b[2], got))
    return exact, near


def test_passes_against_brute_force(spark):
    rng = random.Random(6)
    pays = [payment(2 + i, f"INV-{i}", rng.choice(["100.00", "100.03", "250.00", "77.10"]), pay=rng.randrange(60), supplier=f"Sup {i % 9}") for i in range(140)]
    bank = [bank_line(2 + i, "-" + rng.choice(["100.00", "100.01", "250.00", "77.10", "77.14"]), on=rng.randrange(60),
                      reference=rng.choice(["", f"P-{2 + rng.randrange(140)}", f"inv-{rng.randrange(140)}"])) for i in range(130)]
    r = reconcile.reconcile(spark.createDataFrame(bank, BANK).repartition(3), spark.createDataFrame(pays, PAYMENT).repartition(3), L)
    exact, near = brute(bank, pays)
    assert {(x["bank_line"], x["pay_line"]) for x in r.exact.collect()} == exact and len(exact) > 40
    assert {(x["bank_line"], x["pay_line"]) for x in r.near.collect()} == near and near


def test_two_equal_payments_both_match(spark):
    # paid on the 1st and 10th, bank lines on the 6th and 12th: the earliest open payment first lets both match
    pays = [payment(2, "A-1", 100, pay=0), payment(3, "A-2", 100, pay=9)]
    bank = [bank_line(2, -100, on=5), bank_line(3, -100, on=11)]
    r = reconcile.reconcile(spark.createDataFrame(bank, BANK), spark.createDataFrame(pays, PAYMENT), L)
    assert {(x["bank_line"], x["pay_line"]) for x in r.exact.collect()} == {(2, 2), (3, 3)}


def test_batch_fees_and_leftovers(spark):
    pays = [payment(2, "A-1", "100.10", pay=3), payment(3, "A-2", "200.20", pay=4), payment(4, "A-3", "55.00", pay=4, supplier="Calder"), payment(5, "A-4", "45.00", pay=4, supplier="Calder"),
            payment(6, "A-5", "999.00", pay=4)]
    bank = [bank_line(2, "-300.30", on=5, description="BACS batch"), bank_line(3, "-100.00", on=5, description="Calder Ltd"), bank_line(4, "-9.00", on=6, description="Bank charges"),
            bank_line(5, "-70.00", on=0, description="Transfer to J Smith"), bank_line(6, "-1.00", on=20, description="Overdraft")]
    r = reconcile.reconcile(spark.createDataFrame(bank, BANK), spark.createDataFrame(pays, PAYMENT), L)
    assert {(x["bank_line"], x["pay_line"]) for x in r.batch.collect()} == {(2, 2), (2, 3), (3, 4), (3, 5)}
    assert [x["line_number"] for x in reconcile.bank_without_record(r).findings.collect()] == [5]
    assert [x["line_number"] for x in reconcile.payment_not_on_statement(r, L).findings.collect()] == [6]


def test_batches_are_worked_off_in_order(spark):
    """Debits that want the same payments, day after day, against one debit after the other."""
    rng = random.Random(9)
    pays = [payment(2 + i, f"A-{i}", rng.randrange(1, 9) * 10, pay=rng.randrange(25), supplier=rng.choice(["Calder Works", "Brook", "Calder"])) for i in range(90)]
    bank = [bank_line(2 + i, -rng.randrange(3, 30) * 10 - 1000 * (i % 11 == 0), on=rng.randrange(28), description=rng.choice(["BACS batch", "To Calder Works Ltd", "Brook", "calder"])) for i in range(60)]
    limits = {"batch_pool": 12, "batch_max": 5, "named_pool": 6, "named_max": 3, "bank_days": 5}
    B, P = spark.createDataFrame(bank, BANK).repartition(3), spark.createDataFrame(pays, PAYMENT).repartition(3)
    _, todo, dated = reconcile.prepared(B, P)
    got = [tuple(r) for r in reconcile.batch_pass(todo, dated, 5, limits).select("bank_line", "pay_line", "note").collect()]
    used, want, cut = set(), set(), set()
    for b in sorted(bank, key=lambda b: (b[3], b[2])):
        kind = "batch" if "BACS" in b[4] else "named"
        said = f" {b[4].lower().removesuffix(' ltd')} "
        pool = [p for p in sorted(pays, key=lambda p: (p[5], p[2]), reverse=True) if p[2] not in used and 0 <= (b[3] - p[5]).days <= 5 and (kind == "batch" or f" {p[8].lower()} " in said)]
        room, most = limits[f"{kind}_pool"], limits[f"{kind}_max"]
        items = [(p[2], round(p[12] * 100)) for p in pool[:room]]
        sets = pick_sum(items, round(-b[5] * 100), most)
        used.update(sets or [])
        want |= {(b[2], x) for x in sets or []}
        if not sets and (len(pool) > room or pick_sum(items, round(-b[5] * 100), len(items))):
            cut.add(b[2])
    assert {(b, p) for b, p, _ in got if p is not None} == want and len(want) > 40
    assert {b for b, _, note in got if note} == cut and cut and not any(p for _, p, note in got if note)


def test_one_amount_repeated(spark):
    """200,000 equal payments and lines of one dataset in a few days: nothing holds them together."""
    n, days = 200_000, 40
    bank = spark.range(n).selectExpr("'A' AS dataset_id", "'bank_statement.csv' AS source_file", "id + 2 AS line_number", f"date_add(date'2026-09-01', cast((id * 7) % {days} as int)) AS date",
                                     "'Fee refund' AS description", "cast(-10 as decimal(18,4)) AS amount", "'-10' AS amount_text", "'' AS reference")
    pays = spark.range(n).selectExpr("'A' AS dataset_id", "id + 2 AS line_number", "concat('P-', id) AS payment_id", "'V' AS supplier", "concat('I-', id) AS invoice_no",
                                     f"date_add(date'2026-09-09', cast((id * id) % {days} as int)) AS pay_date", "cast(10 as decimal(18,4)) AS paid_amount")
    _, todo, dated = reconcile.prepared(bank, pays)
    got = {r.bank_line: r.pay_line for r in reconcile.exact_pass(todo, dated, 5).collect()}
    order = sorted((8 + (i * i) % days, i + 2) for i in range(n))
    want, at = {}, 0
    for day, line in sorted(((i * 7) % days, i + 2) for i in range(n)):
        while at < n and order[at][0] < day - 5:
            at += 1
        if at < n and order[at][0] <= day + 5:
            want[line] = order[at][1]
            at += 1
    assert got == want and 100_000 < len(got) < n


def test_pick_sum():
    assert sorted(pick_sum([(1, 5), (2, 7), (3, 9)], 16, 25)) == [2, 3]
    assert pick_sum([(1, 5)], 5, 25) is None and pick_sum([(1, 5), (2, 5)], 0, 25) is None
    assert pick_sum([(i, 1) for i in range(30)], 26, 25) is None


def test_pick_sum_takes_the_first_of_all_sets():
    from itertools import combinations
    rng = random.Random(3)
    for _ in range(150):
        pool = [(i, rng.randrange(1, 30)) for i in range(rng.randrange(2, 11))]
        target, most = rng.randrange(1, 90), rng.choice([2, 3, 6, 25])
        order = sorted(range(len(pool)), key=lambda i: pool[i][1])
        sets = [c for n in range(2, min(most, len(pool)) + 1) for c in combinations(range(len(pool)), n) if sum(pool[order[i]][1] for i in c) == target]
        assert pick_sum(pool, target, most) == ([pool[order[i]][0] for i in min(sets)] if sets else None)
    assert pick_sum([(i, 3 + i % 2) for i in range(40)], 2, 25) is None


def test_pools_meet_by_whole_names(spark):
    bank = spark.createDataFrame([("D", 1, 10, 500, "Paid Supplier 7 and Supplier 70 Ltd", "")], "dataset_id string, line_number long, day int, cents long, description string, reference string")
    pays = spark.createDataFrame([("D", n, 8, 100, f"Supplier {n}") for n in range(1, 80)] + [("D", 90, 3, 100, "Supplier 7"), ("D", 91, 8, 100, "Supplier"), ("D", 92, 8, 100, "")],
                                 "dataset_id string, line_number long, day int, cents long, supplier string")
    pools = reconcile._pools(bank, pays, 5, S.limits_with(None))
    assert {r["pay_line"] for r in pools.collect()} == {7, 70, 91}
    assert "contains" not in pools._jdf.queryExecution().executedPlan().toString().lower()


def test_clusters_without_and_with_many_lines(spark, monkeypatch):
    rng = random.Random(7)
    pays = [payment(2 + i, f"INV-{i % 40}", rng.choice(["100.00", "250.00"]), pay=rng.randrange(9)) for i in range(160)]
    bank = [bank_line(2 + i, "-" + rng.choice(["100.00", "250.00"]), on=rng.randrange(9), reference=rng.choice(["", f"xp-{2 + rng.randrange(160)}", f"inv-{rng.randrange(40)}y", f"P-{i} inv-{i % 40}"])) for i in range(120)]
    exact, _ = brute(bank, pays)
    _, todo, open_ = reconcile.prepared(spark.createDataFrame(bank, BANK), spark.createDataFrame(pays, PAYMENT))
    asked, with_names = [], reconcile._with_names
    monkeypatch.setattr(reconcile, "_with_names", lambda b, p, key: asked.append(b.count()) or with_names(b, p, key))
    for most, lines in ((10_000, 0), (3, 120)):              # only of large clusters is it asked by a join whether they have names
        monkeypatch.setattr(reconcile, "FOLDED", most)
        got = {(x["bank_line"], x["pay_line"]) for x in reconcile.exact_pass(todo, open_, L["bank_days"]).collect()}
        assert got == exact and asked.pop() == lines and len(exact) > 80


def test_any_sum_takes_the_first_of_all_sets():
    rng = random.Random(4)
    for _ in range(600):
        unit, top = rng.choice([1, 5]), rng.choice([6, 40, 4000])
        pool = [(i, rng.randrange(-1, top) * unit) for i in range(rng.randrange(1, 15))]
        target = rng.randrange(1, top * 4)
        assert sorted(any_sum(pool, target) or []) == sorted(pick_sum(pool, target, len(pool)) or [])
    large = [(i, rng.randrange(1_000, 1_000_000)) for i in range(150)]
    target = sum(c for _, c in large[::3])
    got = any_sum(large, target)
    assert sum(dict(large)[i] for i in got) == target and len(set(got)) == len(got)
    assert any_sum([(i, 30 + 30 * (i % 9)) for i in range(90)], 3_010) is None
    assert any_sum([(i, 4 + 4 * (i % 9)) for i in range(90)] + [(90, 997)], 1_200 + 999) is None


def test_batches_without_a_bound(spark):
    """A transfer that pays 60 payments, more than a pool or a set usually has, and one of nine to a supplier."""
    pays = [payment(2 + i, f"A-{i}", 1 + 2 * i, pay=3 + i % 3, supplier=f"Sup {i}") for i in range(60)] + [payment(100 + i, f"B-{i}", "7.50", pay=20, supplier="Calder") for i in range(9)]
    bank = [bank_line(2, -3600, on=6, description="BACS batch"), bank_line(3, "-67.50", on=22, description="Calder Ltd"), bank_line(4, "-1.23", on=40)]
    B, P = spark.createDataFrame(bank, BANK), spark.createDataFrame(pays, PAYMENT)
    bounded, whole = reconcile.reconcile(B, P, L), reconcile.reconcile(B, P, L | S.WHOLE)
    assert bounded.batch.isEmpty() and {r["bank_line"] for r in bounded.notes.collect()} == {2, 3}
    assert sorted((r["bank_line"], r["pay_line"]) for r in whole.batch.collect()) == [(2, 2 + i) for i in range(60)] + [(3, 100 + i) for i in range(9)] and whole.notes.isEmpty()
    found = [r for f in run_area("Payments", Files(payments=P, bank=B)) for r in f.findings.where("clause = '5.5'").collect()]
    assert [(r["source_file"], r["line_number"]) for r in found] == [("bank_statement.csv", 4)]
