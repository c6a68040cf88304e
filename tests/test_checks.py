import random
from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import APPROVAL, DAY0, EXPENSE, PAYMENT, approval, claim, lines_of, payment

from payproof import schema as S
from payproof.operators import approvals, expenses, payments
from payproof.plans.audit import Files, run_area

L = S.LIMITS


def pays(spark, rows):
    return spark.createDataFrame(rows, PAYMENT).repartition(3)


def apps(spark, rows):
    return spark.createDataFrame(rows, APPROVAL).repartition(3)


def claims(spark, rows):
    return spark.createDataFrame(rows, EXPENSE).repartition(3)


def test_paid_twice_counts_money(spark):
    rows = [payment(2, "INV-1", 60, pay=0), payment(3, "INV-1", 40, pay=1),                         # instalments
            payment(4, "INV-2", 100, pay=0), payment(5, "INV-2", -100, pay=1), payment(6, "INV-2", 100, pay=2),   # void and re-issue
            payment(7, "INV-3", 100, pay=5), payment(8, "inv 003", 100, pay=1),                      # the later date is the repeat
            payment(9, "INV-4", 100, pay=0), payment(10, "INV-4", 1, pay=1),                         # at the tolerance
            payment(11, "INV-5", 100, pay=0), payment(12, "INV-5", "1.01", pay=1),                   # just over it
            payment(13, "INV-6", 100, pay=None), payment(14, "INV-6", 100, pay=3)]                   # undated comes last
    found = payments.paid_twice(pays(spark, rows), L)
    assert lines_of(found) == [("5.2", 7), ("5.2", 12), ("5.2", 13)]
    assert sorted((r["line_number"], r["related_line"]) for r in found.links.collect()) == [(7, 8), (12, 11), (13, 14)]


def test_paid_twice_cites_the_latest_ten(spark):
    found = payments.paid_twice(pays(spark, [payment(n, "INV-1", 100, pay=n) for n in range(2, 16)]), L)
    assert len(lines_of(found)) == 13
    assert sorted(r["related_line"] for r in found.links.collect() if r["line_number"] == 15) == list(range(5, 15))


def test_payee_without_an_id_takes_the_only_one(spark):
    rows = [payment(2, "INV-1", 100, vendor="V-1"), payment(3, "INV-1", 100, pay=1, vendor="", supplier="ASHBY COMPONENTS LTD"),
            payment(4, "INV-2", 100, vendor="V-2", supplier="Two Ids"), payment(5, "INV-2", 100, vendor="V-3", supplier="Two Ids"), payment(6, "INV-2", 100, vendor="", supplier="Two Ids")]
    assert lines_of(payments.paid_twice(pays(spark, rows), L)) == [("5.2", 3)]


def test_overpaid_only_on_the_first_payment(spark):
    rows = [payment(2, "INV-1", "101.01"), payment(3, "INV-2", "101.00"), payment(4, "INV-3", 200, billed=""), payment(5, "INV-4", 150, billed="", pay=0),
            payment(6, "INV-4", 100, billed="100", pay=1), payment(7, "INV-5", 100, pay=0), payment(8, "INV-5", 300, pay=1)]
    assert lines_of(payments.overpaid(pays(spark, rows), L)) == [("5.1", 2), ("5.1", 5)]


def test_near_duplicates(spark):
    rows = [payment(2, "ASH-6100", 500, billed="500"), payment(3, "ASH-6100A", 500, billed="500", pay=3),
            payment(4, "B-7001", 600, billed="600"), payment(5, "B-7002", 600, billed="600"),                        # a series
            payment(6, "C-8100", 700, billed="1400"), payment(7, "C-8100A", 700, billed="1400"),                     # halves of one bill
            payment(8, "D-9100", 800, billed="800", inv_day=None, pay=0), payment(9, "D-9100A", 800, billed="800", inv_day=None, pay=7),
            payment(10, "E-9200", 900, billed="900", inv_day=None, pay=0), payment(11, "E-9200A", 900, billed="900", inv_day=None, pay=8),
            payment(12, "F-1000", 49, billed="49"), payment(13, "F-1000A", 49, billed="49")]                         # under materiality
    assert lines_of(payments.near_duplicates(pays(spark, rows), L)) == [("5.6", 3), ("5.6", 9)]


def test_a_twin_beyond_the_neighbours_is_noted_or_found(spark):
    """The same invoice keyed in again 60 places later: found with a wider bound, noted with the usual one."""
    rows = [payment(2 + i, f"X{i:03d}{'ABCDEFGH'[i % 8] * 4}{i * 7919 % 1000:03d}", "500", billed="500", pay=i // 5) for i in range(80)]
    rows[0] = payment(2, "QRS-44871", "500", billed="500", pay=0)
    rows[60] = payment(62, "QRS-44871A", "500", billed="500", pay=12)
    p = pays(spark, rows)
    assert ("5.6", 62) not in lines_of(payments.near_duplicates(p, L))
    assert [tuple(r) for r in payments.cut_searches(p, L).collect()] == [("A", "5.6", 2, 80)]
    wide = {**L, "near_neighbours": 100}
    assert ("5.6", 62) in lines_of(payments.near_duplicates(p, wide)) and payments.cut_searches(p, wide).isEmpty()


def test_equal_payments_without_a_bound(spark):
    """All with all by equal joins, against comparing every pair."""
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("OI01") for _ in range(rng.choice([3, 4, 5, 5, 6])))
    rows = [payment(2 + i, text(), rng.choice(["500", "600"]), billed=rng.choice(["500", "500", "999", ""]), pay=rng.choice([None, *range(30)]), inv_day=rng.choice([0, None])) for i in range(400)]
    p = pays(spark, rows)
    whole, wide = (payments.near_duplicates(p, L | limits) for limits in (S.WHOLE, {"near_neighbours": 1_000}))
    for part in ("findings", "links"):
        a, b = (sorted(map(tuple, getattr(f, part).collect()), key=str) for f in (whole, wide))
        assert a == b and len(a) > 50
    rows = [payment(2 + i, f"X{i:03d}{'ABCDEFGH'[i % 8] * 4}{i * 7919 % 1000:03d}", "500", billed="500", pay=i // 5) for i in range(80)]
    rows[0], rows[60] = payment(2, "QRS-44871", "500", billed="500", pay=0), payment(62, "QRS-44871A", "500", billed="500", pay=12)
    assert ("5.6", 62) in [x for f in run_area("Payments", Files(payments=pays(spark, rows))) for x in lines_of(f)]


def test_earlier_payments_shown(spark):
    p = pays(spark, [payment(2 + i, "INV-1", "100", pay=i) for i in range(14)])
    shown = lambda limits: sum(r["line_number"] == 15 for r in payments.paid_twice(p, limits).links.collect())
    assert shown(L) == 10 and shown({**L, "earlier_payments": 100}) == 13
    assert sorted(tuple(r) for r in payments.cut_searches(p, L).collect()) == [("A", "5.2", 2 + n, n) for n in (11, 12, 13)]


def test_order_coverage_against_brute_force(spark):
    rng = random.Random(3)
    rows = [approval(2 + i, 120_000 + 7_000 * i, kind="PO", doc=f"PO-{i}") for i in range(4)]
    rows += [approval(10 + i, rng.randrange(9_000, 30_000), po=f"po-{rng.randrange(4)}", on=i % 5) for i in range(120)]
    want, billed = set(), {}
    for r in rows:
        if r[5] != "INVOICE" or r[9] <= 10_000:
            continue
        po = int(r[13][3:])
        if billed.get(po, 0) + r[9] <= 120_000 + 7_000 * po + 1:
            billed[po] = billed.get(po, 0) + r[9]
            want.add((2 + po, r[2]))
    got = {(r["po_line"], r["line_number"]) for r in approvals.covered_by_order(apps(spark, rows), L).collect()}
    assert got == want and len(want) > 5


def test_split_orders_against_brute_force(spark):
    rng = random.Random(4)
    rows = [approval(2 + i, rng.choice([2_400, 3_900, 6_000, 9_999, 10_000, -500]), on=rng.randrange(40), by=rng.choice(["Kate Lowe", "Lowe, Kate", "klowe", "Raj Patel"]),
                     vendor=rng.choice(["Ashby", "Ashby Ltd", "Calder"])) for i in range(90)]
    groups = {}
    for r in rows:
        who = "raj" if "Raj" in r[10] else "kate"
        groups.setdefault((r[8].split()[0], who), []).append(r)
    want = set()
    for items in groups.values():
        items.sort(key=lambda r: r[7])
        i = 0
        while i < len(items):
            win = [x for x in items[i:] if x[7] <= items[i][7] + timedelta(days=3)]
            total = sum(x[9] for x in win)
            if len(win) >= 2 and total > 10_000:
                want.add((max(x[2] for x in win), total, tuple(sorted(x[2] for x in win))))
                i += len(win)
            else:
                i += 1
    found = approvals.split_orders(apps(spark, rows), L)
    links = {}
    for r in found.links.collect():
        links.setdefault(r["line_number"], set()).add(r["related_line"])
    got = {(r["line_number"], r["amount"], tuple(sorted(links[r["line_number"]] | {r["line_number"]}))) for r in found.findings.collect()}
    assert got == want and want


def test_short_names_join_one_person_only(spark):
    rows = [approval(2, 100, by="Kate Lowe"), approval(3, 100, by="K. Lowe"), approval(4, 100, by="Kim Hale"), approval(5, 100, by="Kay Hale"), approval(6, 100, by="K. Hale"),
            approval(7, 100, by="J. Ward"), approval(8, 100, by="jward"), approval(9, 100, by="wardj")]
    got = {r["form"]: r["person"] for r in approvals.resolve_people(approvals.split_candidates(apps(spark, rows), L)).collect()}
    assert got["k lowe"] == "kate lowe" and got["hale k"] == "hale k" and got["jward"] == got["wardj"] == got["j ward"] == "j ward"


def test_receipt_limit_runs_against_brute_force(spark):
    rng = random.Random(5)
    rows = [claim(2 + i, rng.choice(["22.49", "22.50", "24.00", "25.00", "25.01"]), on=rng.randrange(400), who=rng.choice(["Kate Lowe", "Lowe, Kate", "Raj Patel"])) for i in range(120)]
    want = set()
    for who in ("Lowe", "Raj"):
        items = sorted((r for r in rows if who in r[6] and Decimal("22.5") <= r[8] <= 25), key=lambda r: (r[5], r[2]))
        start = 0
        for i in range(len(items)):
            while (items[i][5] - items[start][5]).days > 30:
                start += 1
            if i - start + 1 >= 3:
                win = items[start:i + 1]
                want.add((max(x[2] for x in win), sum(x[8] for x in win)))
                start = i + 1
    got = {(r["line_number"], r["amount"]) for r in expenses.under_receipt_limit(claims(spark, rows), L).findings.collect()}
    assert got == want and len(want) > 5


def test_weekend_claims_near_a_trip(spark):
    sat = (5 - DAY0.weekday()) % 7
    rows = [claim(2, 30, on=sat, category="Taxi"), claim(3, 80, on=sat - 1, category="Hotel", notes="conference trip"), claim(4, 30, on=sat, category="Supplies"),
            claim(5, 30, on=sat, category="Hotel", who="Raj Patel")]
    assert lines_of(expenses.weekend_claim(claims(spark, rows), L)) == [("6.4", 4), ("6.4", 5)]


def test_limits_at_the_edge(spark):
    rows = [claim(2, "25.00"), claim(3, "25.01"), claim(4, "75.00", category="Meals", receipt="R1"), claim(5, "75.01", category="Meals", receipt="R2"),
            claim(6, "150.00", category="Meals", people="two", receipt="R3"), claim(7, "150.02", category="Meals", people="2", receipt="R4"), claim(8, 90, category="Mileage")]
    c = claims(spark, rows)
    assert lines_of(expenses.no_receipt(c, L)) == [("6.2", 3)]
    assert lines_of(expenses.meals(c, L)) == [("6.1", 5), ("6.1", 7)]
    a = apps(spark, [approval(2, 2500), approval(3, "2500.01"), approval(4, 9600, by="Raj Patel"), approval(5, "9599.99", by="Raj Patel", vendor="X"), approval(6, 10000, by="Raj Patel", vendor="Y")])
    assert ("1.1", 2) not in lines_of(approvals.no_purchase_order(a, L)) and ("1.1", 3) in lines_of(approvals.no_purchase_order(a, L))
    under = approvals.just_under_limit(a, L)
    assert lines_of(under) == [("1.6", 6)] and [r["related_line"] for r in under.links.collect()] == [4]
