"""One line of a delimited file as cells, and cells as a line."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def cells(line: Column, sep: str = ",") -> Column:
    """Cells of a line: quoted ones lose their quotes, doubled quotes become one; a quote inside a cell is a character."""
    s = re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'(?s){s}("(?:[^"]|"")*"[^{s}]*|[^{s}]*)'), 1)

    def open_up(c: Column) -> Column:
        inner = F.regexp_replace(c, '(?s)^"((?:[^"]|"")*)"', "$1")
        return F.when(c.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, open_up)


def bare_cells(line: Column, sep: str) -> Column:
    """Cells of a line in which quotes are plain characters."""
    return F.split(line, re.escape(sep))


def to_line(values: Column) -> Column:
    """Cells as one comma-separated line; only what needs quotes gets them."""
    def quoted(c: Column) -> Column:
        return F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(values, quoted), ",")


def quote_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
