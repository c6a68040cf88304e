from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from payproof.functions import csvtext, dates, money, screens, text


def one(spark, value, expr, *more):
    cols = ", ".join(f"c{i} string" for i in range(1 + len(more)))
    return spark.createDataFrame([(value, *more)], cols).select(expr(*[F.col(f"c{i}") for i in range(1 + len(more))])).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("1234.56", "1234.56"), ("$1,200.00", "1200"), ("(500.00)", "-500"), ("120.00-", "-120"), ("120.00 CR", "-120"), ("120.00 DR", "120"),
    ("1.234,56", "1234.56"), ("1'234.50", "1234.50"), ("1 234,56", "1234.56"), ("12,5", "12.5"), ("USD 99.10", "99.1"), ("1.200,00 EUR", "1200"),
    ("−5.00", "-5"), ("nan", "0"), ("1e400", "0"), ("10000000000000", "0"), ("9999999999999", "9999999999999"), ("", "0"), ("abc", "0"), ("R$ 10,00", "10")])
def test_amounts(spark, raw, want):
    assert one(spark, raw, money.parse_amount) == Decimal(want)


@pytest.mark.parametrize("raw, dayfirst, want", [
    ("2026-09-02", False, "2026-09-02"), ("2026-9-2", False, "2026-09-02"), ("2/9/2026", True, "2026-09-02"), ("2/9/2026", False, "2026-02-09"),
    ("02.09.2026", False, "2026-09-02"), ("2/9/2026 14:30", True, "2026-09-02"), ("02 Sep 2026", False, "2026-09-02"), ("2-Sept-2026", False, "2026-09-02"),
    ("Sep 2, 2026", False, "2026-09-02"), ("september 2 2026", False, "2026-09-02"), ("2026-02-30", False, None), ("9999-12-31", False, None), ("0001-01-01", False, None)])
def test_dates(spark, raw, dayfirst, want):
    got = one(spark, raw, lambda c: dates.parse_date(c, F.lit(dayfirst)))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("a, b", [
    ("CALDER LOGISTICS LTD.", "Calder Logistics"), ("The Calder & Sons Co", "calder and sons"), ("Müller GmbH", "Muller"), ("Straße AG", "strasse ag"), ("the company ltd", "")])
def test_company_keys(spark, a, b):
    assert one(spark, a, text.norm_name) == one(spark, b, text.norm_name) == text.plain_norm_name(a)


@pytest.mark.parametrize("a, b, want", [
    ("K. Lowe", "Kate Lowe", True), ("Lowe, Kate", "Kate Lowe", True), ("klowe", "Kate Lowe", True), ("kate.lowe", "Kate Lowe", True), ("lowek", "Kate Lowe", True),
    ("Kate Lowe", "Kim Lowe", False), ("K. Lowe", "K. Lowry", False), ("", "", False), ("García, José Jr.", "jose garcia", True), ("klowe", "klowe", True), ("klowe", "K. Lowry", False)])
def test_same_person(spark, a, b, want):
    assert one(spark, a, lambda x, y: text.same_person(text.person_parts(x), text.person_parts(y)), b) is want


@pytest.mark.parametrize("a, want", [("INV-001", "inv-1"), ("inv 1", "inv-1"), (" INV001 ", "inv-1"), ("000", "0"), ("2026/045", "2026-45"), ("", ""), ("A00B", "a-0-b")])
def test_invoice_keys(spark, a, want):
    assert one(spark, a, text.inv_key) == want


@pytest.mark.parametrize("a, b, want", [
    ("6100", "ASH-6100", True), ("ASH-6100", "ASH-6100A", True), ("ASH-6100", "ASH-6010", True), ("INV-1O01", "INV-1001", True), ("INV-1001", "INV-1002", False),
    ("SC-4101", "SC-4110", False), ("610", "A610", False), ("", "A610", False)])
def test_similar_invoices(spark, a, b, want):
    assert one(spark, a, lambda x, y: text.similar_invoice(text.inv_text(x), text.inv_text(y)), b) is want


@pytest.mark.parametrize("role, want", [
    ("Finance Director", True), ("Assistant to the CFO", False), ("PA to Director", False), ("Associate Director", False), ("Finance Director (reports to CEO)", True), ("Deputy Director", True)])
def test_directors(spark, role, want):
    assert one(spark, role, text.is_director) is want


@pytest.mark.parametrize("words, want", [
    ("Bank charges", True), ("Interest 4.10", True), ("interest partners ltd", False), ("Transfer to J Smith", False), ("Consulting fees - Smith", False), ("VAT payment services", False)])
def test_non_supplier_bank(spark, words, want):
    assert one(spark, words, lambda c: screens.non_supplier_bank(c, F.lit(""))) is want


@pytest.mark.parametrize("verdict, reason, want", [
    ("Doubtful", "This clearly breaches the clause", True), ("Confirmed", "It does not exceed the limit", True), ("Confirmed", "It must not exceed the limit", False)])
def test_contradictions(spark, verdict, reason, want):
    assert one(spark, verdict, screens.contradicts, reason) is want


@pytest.mark.parametrize("people, notes, want", [("4", "", 4), ("four", "", 4), ("200", "", 200), ("201", "", 0), ("team", "dinner - 5 people", 5), ("", "lunch (3)", 3), ("", "twelve guests", 12)])
def test_head_counts(spark, people, notes, want):
    assert one(spark, people, screens.people_of, notes) == want


def test_csv_cells(spark):
    assert one(spark, ',a,"b, c","say ""x""",5" pipe,', csvtext.cells) == ["", "a", "b, c", 'say "x"', '5" pipe', ""]


@pytest.mark.parametrize("cell, want", [("=SUM(A1)", "'=SUM(A1)"), ("-500.00", "-500.00"), ("+cmd", "'+cmd"), ("plain", "plain")])
def test_safe_cells(spark, cell, want):
    assert one(spark, cell, text.safe_cell) == want


def test_folding_asks_the_long_class_of_little_text(spark):
    import re

    from pyspark.sql import functions as F

    from payproof.functions import text
    many = text._fold_tables()[3]
    pattern = text._class_of("".join(many))
    assert len(pattern) < len(many) + 2
    assert all(bool(re.fullmatch(pattern, chr(p))) == (chr(p) in many) for p in range(0xFFFE) if not 0xD800 <= p <= 0xDFFF)
    words = ["S\u00f6hne", "\u00c5ngstr\u00f6m", "\ufb01n", "\u2460\u00bd", "\u0416\u044f", "plain"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold(F.col("w"))).collect()]
    assert got[:2] == ["sohne", "angstrom"] and got[2] == "fin" and got[5] == "plain"
