"""Amounts: reading the many ways exports write money, and writing it back."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payproof.functions.text import let, strip

MONEY = "decimal(18,4)"

# --- fixed values: what an amount may be dressed in ---------------------------
CODES = "USD|EUR|GBP|CAD|AUD|NZD|CHF|JPY|CNY|RMB|HKD|SGD|INR|SEK|NOK|DKK|PLN|CZK|HUF|ZAR|BRL|MXN|AED|SAR|kr|zł|Kč|Ft"
CURRENCY = rf"(?iu)^(?:{CODES}|US|NZ|HK|A|C|S|R)|(?:{CODES})$"
SYMBOLS = r"(?U)[$£€¥₹円元₩₪₺\s\u00a0\u2009\u202f'\u2019]"
PLAIN = r"^-?\d{1,13}(?:\.\d+)?$"
COMMA_DECIMALS = r"^-?\(?[$€£]?\d{1,3}(\.\d{3})*,\d{1,2}\)?$|^-?\(?\d+,\d{1,2}\)?$"
POINT_THOUSANDS = r"^-?\d{1,3}(\.\d{3})+$"
CENTS_AFTER = r"\d%s\d{2}(\s*[A-Za-z€£$)-]*)?$"


def _undress(t: Column) -> Column:
    """An amount with currency, spaces, credit marks or brackets around it; NULL when there is no number in it."""
    bare = F.regexp_replace(F.replace(t, F.lit("\u2212"), F.lit("-")), SYMBOLS, "")

    def no_currency(x: Column) -> Column:
        return F.when(x.rlike(r"[^\d.,()+-]"), F.regexp_replace(x, CURRENCY, "")).otherwise(x)

    def no_mark(x: Column) -> Column:
        """(text without CR/DR, whether it was a credit)"""
        mark = F.upper(F.right(x, F.lit(2)))
        return F.struct(F.when(mark.isin("CR", "DR"), F.left(x, F.length(x) - 2)).otherwise(x).alias("x"), (mark == "CR").alias("credit"))

    def no_trailing_minus(m: Column) -> Column:
        minus = m["x"].endswith("-") & ~m["x"].startswith("-")
        return F.struct(F.when(minus, F.left(m["x"], F.length(m["x"]) - 1)).otherwise(m["x"]).alias("x"),
                        (F.when(m["credit"], -1).otherwise(1) * F.when(minus, -1).otherwise(1)).alias("sign"))

    def point_decimals(m: Column) -> Column:
        european = F.replace(F.replace(m["x"], F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.struct(F.replace(F.when(m["x"].rlike(COMMA_DECIMALS), european).otherwise(m["x"]), F.lit(","), F.lit("")).alias("x"),
                        m["sign"].alias("sign"))

    def value(m: Column) -> Column:
        brackets = m["x"].startswith("(") & m["x"].endswith(")")
        v = F.when(m["x"].rlike(r"\d"), F.btrim(m["x"], F.lit("()")).try_cast(MONEY))
        return (v * m["sign"] * F.when(brackets, -1).otherwise(1)).cast(MONEY)
    steps = (no_currency, no_mark, no_trailing_minus, point_decimals, value)
    out = bare
    for step in steps:
        out = let(out, step)
    return out


def read_amount(c: Column) -> Column:
    """Money as DECIMAL(18,4), or NULL when the text is not an amount below ten trillion."""
    def small(v: Column) -> Column:
        return F.when(F.abs(v) < F.lit(10 ** 13), v)
    return let(strip(c), lambda t: F.when(t.rlike(PLAIN), t.try_cast(MONEY)).otherwise(let(_undress(t), small)))


def parse_amount(c: Column) -> Column:
    """Money as DECIMAL(18,4); text that is not an amount reads as zero."""
    return F.coalesce(read_amount(c), F.lit(0)).cast(MONEY)


def european_thousands(c: Column) -> Column:
    return strip(c).rlike(POINT_THOUSANDS)


def drop_thousands(c: Column, comma_file: Column) -> Column:
    """In a column that writes decimals with a comma, '1.234' is one thousand two hundred and thirty-four."""
    return F.when(comma_file & european_thousands(c), F.replace(strip(c), F.lit("."), F.lit(""))).otherwise(c)


def comma_cents(c: Column) -> Column:
    return strip(c).rlike(CENTS_AFTER % ",")


def point_cents(c: Column) -> Column:
    return strip(c).rlike(CENTS_AFTER % r"\.")


def cents(amount: Column) -> Column:
    return F.bround(amount * 100, 0).cast("bigint")


def fmt(amount: Column, places: int = 2) -> Column:
    """1,234.50"""
    return F.format_number(amount, places)


def dollars(amount: Column) -> Column:
    """$1,234.50, -$5.00, and a dash for something that is not a number."""
    return (F.when(amount.isNull() | F.isnan(amount.cast("double")), F.lit("-"))
            .when(amount < 0, F.concat(F.lit("-$"), fmt(-amount)))
            .otherwise(F.concat(F.lit("$"), fmt(amount))))


def first_digit(amount: Column) -> Column:
    """First significant digit of a positive amount: the first character of its scientific notation, which unlike a
    logarithm is right at powers of ten."""
    return F.when(amount > 0, F.left(F.format_string("%.10e", amount.cast("double")), F.lit(1)).cast("int"))
