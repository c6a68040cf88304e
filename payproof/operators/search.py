"""Looking things up in a file: text, rows by condition, lines by number, repeated rows, numbered chunks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import dates, money, text

FILE = ["dataset_id", "source_file"]


def find_text(lines: DataFrame, words: str) -> DataFrame:
    return lines.where(F.contains(F.lower("text"), F.lit(words.lower()))) if words else lines.limit(0)


def test(cell: Column, op: str, value: str, dayfirst: Column | None = None) -> Column:
    """One row condition over a cell as text."""
    c = text.strip(cell)
    if op == "empty":
        return c == ""
    if op == "not_empty":
        return c != ""
    if op == "contains":
        return F.contains(F.lower(c), F.lit(value.lower()))
    if op == "weekend":
        return F.coalesce(dates.is_weekend(dates.parse_date(c, F.lit(False) if dayfirst is None else dayfirst)), F.lit(False))
    if op in ("gt", "lt"):
        try:
            number = float(value)
        except ValueError:
            return F.lit(False)
        amount = money.parse_amount(c).cast("double")
        return amount > number if op == "gt" else amount < number
    if op in ("eq", "ne"):
        same = F.lower(c) == value.lower()
        return same if op == "eq" else ~same
    raise ValueError(f"unknown condition {op!r}")


def page(rows: DataFrame, size: int = S.PAGE_ROWS) -> DataFrame:
    """The first rows of a result by dataset, file and line: what one screen shows. The overflow is `rows.count()`."""
    return rows.orderBy(*FILE, "line_number").limit(size)


def get_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    return lines.join(wanted.select(*FILE, "line_number").distinct(), [*FILE, "line_number"], "left_semi")


def describe(lines: DataFrame, shown: int = 5) -> DataFrame:
    """Per file: its lines, the first and last line number, and the texts of the first five (Spark keeps five of a file in each task)."""
    counts = lines.groupBy(*FILE).agg(F.count("*").alias("rows"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))
    top = lines.withColumn("place", F.row_number().over(Window.partitionBy(*FILE).orderBy("line_number"))).where(F.col("place") <= shown)
    texts = top.groupBy(*FILE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("first_rows"))
    return counts.join(texts, FILE)


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of rows equal on the columns, ignoring case, every value given: how many rows, the first and the last."""
    keys = [F.lower(text.strip(F.col(c))).alias(c) for c in columns]
    filled = [F.col(c) != "" for c in columns]
    g = rows.select("dataset_id", "line_number", *keys)
    for f in filled:
        g = g.where(f)
    return (g.groupBy("dataset_id", *columns).agg(F.count("*").alias("rows"), F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"))
            .where("rows > 1"))


def duplicate_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The lines of each group of equal rows."""
    groups = duplicates(rows, columns).select("dataset_id", *columns)
    keyed = rows.select("dataset_id", "line_number", *[F.lower(text.strip(F.col(c))).alias(c) for c in columns])
    return keyed.join(groups, ["dataset_id", *columns], "left_semi")


def chunks(lines: DataFrame, header: DataFrame, size: int = S.CHUNK_LINES) -> DataFrame:
    """Numbered pieces of a file for a reviewer, the header repeated: each piece holds at most `size` line numbers."""
    numbered = F.concat(F.col("line_number").cast("string"), F.lit("\t"), F.col("text"))
    body = (lines.withColumn("chunk", F.floor((F.col("line_number") - 1) / size)).groupBy(*FILE, "chunk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", numbered.alias("t")))), lambda x: x["t"]), "\n").alias("body"),
                 F.count("*").alias("lines")))
    return (body.join(header, FILE, "left")
            .withColumn("body", F.when((F.col("chunk") > 0) & F.col("header").isNotNull(),
                                       F.concat(F.lit("(file header) "), "header", F.lit("\n"), "body")).otherwise(F.col("body"))).drop("header"))
