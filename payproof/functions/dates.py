"""Dates: reading the forms exports use, in the day or month order of the file."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payproof.functions.text import let, strip

# --- fixed values: how a date may be written ----------------------------------
MONTH_WORD = (r"^(\d{1,2})[ -]([A-Za-z]{3,9})\.?[ -](\d{4})\b"
              r"|^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})\b")
SLASH_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:[ T]\d{1,2}:\d{2}.*)?$"


def _as(t: Column, shape: str, fmt: str) -> Column:
    return F.when(t.rlike(shape), F.try_to_date(t, fmt))


def parse_date(c: Column, dayfirst: Column) -> Column:
    """ISO, slashed, dotted, dashed or month-word dates; a time after the date is ignored. Years outside 1900-2200
    are placeholders, not dates."""
    def worded(t: Column) -> Column:
        def part(i: int, j: int) -> Column:
            return F.concat(F.regexp_extract(t, MONTH_WORD, i), F.regexp_extract(t, MONTH_WORD, j))
        return F.try_to_date(F.concat_ws(" ", part(1, 5), F.initcap(F.left(part(2, 4), F.lit(3))), part(3, 6)), "d MMM yyyy")

    def numeric(t: Column) -> Column:
        return F.coalesce(
            _as(t, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), _as(t, r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
            _as(t, r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
            F.when(dayfirst, F.coalesce(_as(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), _as(t, r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy")))
            .otherwise(F.coalesce(_as(t, r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), _as(t, r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"))))

    def read(t: Column) -> Column:
        head = F.left(F.regexp_replace(t, r"(?s)[ T].*$", ""), F.lit(10))
        return F.when(t.rlike(MONTH_WORD), worded(t)).otherwise(let(head, numeric))
    return let(let(strip(c), read), lambda d: F.when(F.year(d).between(1900, 2200), d))


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def day_number(d: Column) -> Column:
    """Days since 1970, for arithmetic that must stay an integer."""
    return F.unix_date(d)
