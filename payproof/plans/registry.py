"""Registered queries and, where SQL can say the same, the oracle for each."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof.operators.findings import Found
from payproof.plans import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PARTS: dict[str, tuple[list[str], str]] = {}         # an oracle's views and its own part


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def with_views(names: list[str], sql: str) -> str:
    """An oracle over payables views: their definitions, then the query (which may go on with more WITH clauses). Views
    and result are materialized, so that a caller's own LIMIT or count around it doesn't change how it is computed."""
    body = re.sub("^WITH (?!RECURSIVE)", "WITH RECURSIVE ", sql.strip())
    whole = _over(names, body)
    _PARTS[whole] = (names, body)
    return whole


def all_of(names: list[str], columns: str, *others: tuple[list[str], str]) -> tuple[list[str], str]:
    """The views that the oracles of several queries (and other parts) read, and the union of their rows: what with_views takes."""
    parts = [_PARTS[ORACLES[n]] for n in names] + [(views, re.sub("^WITH (?!RECURSIVE)", "WITH RECURSIVE ", body.strip())) for views, body in others]
    return sorted({v for views, _ in parts for v in views}), " UNION ALL ".join(f"SELECT {columns} FROM ({body})" for _, body in parts)


def _over(names: list[str], body: str) -> str:
    return f"WITH {bridge.oracle_ctes(*names)}, whole AS MATERIALIZED ({body}) SELECT * FROM whole"


def over_views(fn: Callable[..., DataFrame], names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that takes payables views, in order."""
    return lambda spark, folder: fn(*bridge.views(spark, folder, names))


def shown(found: Found) -> DataFrame:
    """Findings with plain types, for comparing values."""
    return found.findings.select("dataset_id", "clause", "severity", F.col("amount").cast("double").alias("amount"), "title",
                                 "source_file", "line_number", "anchor")


def check(name: str, fn: Callable[..., Found], names: list[str], limits: dict, sql: str | None = None,
          lines_sql: str | None = None) -> None:
    """A check as a query: its findings, and as `<name>_lines` the lines that support them. Oracle rows must give
    dataset_id, clause, severity, amount, title, source_file, line_number, anchor."""
    def run(spark: SparkSession, folder: str) -> Found:
        return fn(*bridge.views(spark, folder, names), limits=limits)
    register(name, lambda spark, folder: shown(run(spark, folder)), sql and with_views(names, sql))
    if lines_sql is not None:
        register(f"{name}_lines", lambda spark, folder: run(spark, folder).links, with_views(names, lines_sql) if lines_sql else None)


# ---- oracle spellings of the text functions, written with DuckDB's lists where Spark uses patterns
def o_norm(x: str) -> str:
    from payproof.schema import COMPANY_SUFFIXES
    words = (f"trim(regexp_replace(lower(strip_accents(replace({x}, '&', ' and '))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")
    cut = f"regexp_replace({words}, '(?:(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)}))+$', '')"
    return f"array_to_string(list_filter(string_split({cut}, ' '), lambda w: w <> 'the' AND w <> ''), ' ')"


def o_parts(x: str) -> str:
    from payproof.schema import PERSON_TITLES
    t = f"lower(strip_accents({x}))"
    turned = (f"CASE WHEN contains({t}, ',') THEN substr({t}, strpos({t}, ',') + 1) || ' ' || substr({t}, 1, strpos({t}, ',') - 1) "
              f"ELSE {t} END")
    titles = ", ".join(f"'{w}'" for w in PERSON_TITLES)
    return f"list_filter(regexp_extract_all({turned}, '\\p{{L}}+'), lambda w: w NOT IN ({titles}))"


def o_person(x: str) -> str:
    return f"array_to_string(list_sort({o_parts(x)}), ' ')"


def o_same(a: str, b: str) -> str:
    """Over two lists of parts."""
    def user(one: str, full: str) -> str:
        return (f"(len({full}) >= 2 AND {one}[1] IN ({full}[1][1] || {full}[-1], {full}[1] || {full}[-1], {full}[-1] || {full}[1][1]))")
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN false WHEN {a} = {b} THEN true WHEN len({a}) = 1 THEN {user(a, b)} "
            f"WHEN len({b}) = 1 THEN {user(b, a)} WHEN {a}[-1] <> {b}[-1] THEN false "
            f"ELSE {a}[1] = {b}[1] OR ((len({a}[1]) = 1 OR len({b}[1]) = 1) AND {a}[1][1] = {b}[1][1]) END")


def o_key(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[0-9]+'), "
            "lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN coalesce(nullif(ltrim(p, '0'), ''), '0') ELSE p END), '-')")


def o_fmt(x: str, places: int = 2) -> str:
    return f"format('{{:,.{places}f}}', CAST({x} AS DOUBLE))"


def o_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def o_finding(clause: str, severity: str, amount: str, title: str, file: str, line: str = "line_number", anchor: str = "0") -> str:
    sev = severity if severity.startswith("CASE") else f"'{severity}'"
    return (f"dataset_id, '{clause}' AS clause, {sev} AS severity, CAST({amount} AS DOUBLE) AS amount, {title} AS title, "
            f"'{file}' AS source_file, CAST({line} AS BIGINT) AS line_number, CAST({anchor} AS BIGINT) AS anchor")


def o_link(clause: str, file: str, line: str, related: str, anchor: str = "0") -> str:
    return (f"dataset_id, '{clause}' AS clause, '{file}' AS source_file, CAST({line} AS BIGINT) AS line_number, "
            f"CAST({anchor} AS BIGINT) AS anchor, '{file}' AS related_file, CAST({related} AS BIGINT) AS related_line")
