"""Numbered lines of one kind to its typed table. How a file writes dates and decimals is decided on the whole file,
with one aggregate per file, and joined back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import csvtext, dates, money, text
from payproof.scale import checkpointed, facts
from payproof.sources.headers import FILE

DATE_COLUMNS = {"payments.csv": ["pay_date", "invoice_date"], "approvals.csv": ["date"], "expenses.csv": ["date"], "bank_statement.csv": ["date"]}
KEPT_DATES = {"vendors.csv": {"bank_changed_on": "bank_changed_date", "created_on": "created_date", "last_paid_on": "last_paid_date",
                              "status_changed_on": "status_changed_date"}}
AMOUNTS = {"payments.csv": ["invoice_amount", "paid_amount"], "approvals.csv": ["amount"], "vendors.csv": ["last_paid_amount"],
           "expenses.csv": ["amount"], "bank_statement.csv": ["amount"], "payment_run.csv": ["amount"]}
EXTRA = {"payments.csv": ["vendor_id"], "approvals.csv": ["type"], "vendors.csv": ["created_on", "status_changed_on", "bank_acct"], "expenses.csv": [],
         "bank_statement.csv": ["reference"], "payment_run.csv": ["vendor_id", "bank_last4"]}
KEPT_TEXT = {"bank_statement.csv": {"amount": "amount_text"}, "payment_run.csv": {"amount": "amount_text"}}


def with_cells(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Data lines with their cells and the header of their file; blank lines go, their numbers stay used."""
    return (lines.join(facts(heads.select(*FILE, "header_line", "header")), FILE).where((F.col("line_number") > F.col("header_line")) & ~text.is_blank(F.col("text")))
            .withColumn("cells", csvtext.cells(F.col("text"))))


def value(column: str) -> Column:
    """A cell by column name; a column the file lacks, or a short row, reads blank."""
    place = F.array_position("header", F.lit(column)).cast("int")
    return F.when(place > 0, F.coalesce(F.try_element_at("cells", place), F.lit(""))).otherwise(F.lit(""))


def date_order(rows: DataFrame) -> DataFrame:
    """Per file: whether its slash dates are day first, month first, absent (iso) or cannot be told apart."""
    cell = (rows.select(*FILE, F.explode("cells").alias("c")).withColumn("c", text.strip(F.col("c"))).where(F.col("c").rlike(dates.SLASH_DATE))
            .select(*FILE, F.regexp_extract("c", dates.SLASH_DATE, 1).cast("int").alias("a"), F.regexp_extract("c", dates.SLASH_DATE, 2).cast("int").alias("b")))
    seen = cell.groupBy(*FILE).agg(F.count_if(F.col("a") > 12).alias("days_first"), F.count_if(F.col("b") > 12).alias("days_second"))
    order = (F.when((F.col("days_first") > 0) & (F.col("days_second") == 0), "day-first")
             .when((F.col("days_second") > 0) & (F.col("days_first") == 0), "month-first").otherwise("ambiguous"))
    files = rows.select(*FILE).distinct()
    return files.join(seen.select(*FILE, order.alias("order")), FILE, "left").select(*FILE, F.coalesce("order", F.lit("iso")).alias("date_order"))


def decimal_style(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per file: for each amount column, whether it writes decimals with a comma and never with a point."""
    return rows.groupBy(*FILE).agg(*[
        (F.bool_or(money.comma_cents(value(c))) & ~F.bool_or(money.point_cents(value(c)))).alias(f"{c}_comma") for c in columns])


def typed(lines: DataFrame, heads: DataFrame, kind: str, chosen_order: DataFrame | None = None) -> DataFrame:
    """The typed table of a kind. `chosen_order` (dataset_id, source_file, date_order) is what a person chose on the
    data check, and wins over what the file suggests."""
    rows = checkpointed(with_cells(lines, heads))          # read three times: two whole-file aggregates, then the parse
    order = date_order(rows)
    if chosen_order is not None:
        order = (order.join(chosen_order.withColumnRenamed("date_order", "chosen"), FILE, "left")
                 .select(*FILE, F.coalesce("chosen", "date_order").alias("date_order")))
    amounts = AMOUNTS[kind]
    x = rows.join(facts(order.join(decimal_style(rows, amounts), FILE, "left")), FILE, "left")
    dayfirst = F.col("date_order") == "day-first"
    out = []
    for c in [*S.REQUIRED[kind], *EXTRA[kind]]:
        v = value(c)
        if c in amounts:
            out.append(money.parse_amount(money.drop_thousands(v, F.col(f"{c}_comma"))).alias(c))
            if c in KEPT_TEXT.get(kind, {}):
                out.append(text.strip(v).alias(KEPT_TEXT[kind][c]))
        elif c in DATE_COLUMNS.get(kind, []):
            out.append(dates.parse_date(v, dayfirst).alias(c))
        else:
            out.append(v.alias(c))
            if c in KEPT_DATES.get(kind, {}):
                out.append(dates.parse_date(v, dayfirst).alias(KEPT_DATES[kind][c]))
    if kind == "payments.csv":
        out.append(text.is_blank(value("invoice_amount")).alias("invoice_amount_blank"))
    return x.select("dataset_id", "source_file", "line_number", "text", *out)


def empty(spark: SparkSession, kind: str) -> DataFrame:
    """The typed table of a kind nobody sent."""
    lines = spark.createDataFrame([], "dataset_id string, source_file string, line_number long, text string")
    heads = spark.createDataFrame([], "dataset_id string, source_file string, header_line long, header array<string>")
    return typed(lines, heads, kind)


# ---------------------------------------------------------------- data check before a run
def profile(rows: DataFrame, kind: str) -> DataFrame:
    """What was believed about each file of a kind: rows, date order, unreadable amounts and dates (with the first
    lines), three-decimal values, currencies, reversals. One aggregate per file."""
    order = date_order(rows).withColumnRenamed("date_order", "order_seen")
    zero = r"^[\s$€£(]*-?0+([.,]0+)?\)?$"
    skip = ["N/A", "NA", "-", ""]
    x = rows.join(facts(order), FILE, "left")
    dayfirst = F.col("order_seen") == "day-first"
    aggs = [F.count("*").alias("rows"), F.min("order_seen").alias("date_order"),
            F.bool_or(F.col("text").rlike(r"\d\.\d{3},\d{2}\b")).alias("decimal_commas"),
            F.concat_ws(" ", *[F.when(F.bool_or(F.contains("text", F.lit(c))), c) for c in "$£€"]).alias("currencies")]
    for c in S.REQUIRED[kind]:
        asked = ~text.upper_strip(value(c)).isin(skip)
        if "amount" in c:
            bad = asked & (money.parse_amount(value(c)) == 0) & ~value(c).rlike(zero)
            aggs.append(F.count_if(money.european_thousands(value(c))).alias(f"{c}_three_decimals"))
        elif c.endswith("date") or c.endswith("_on"):
            bad = asked & dates.parse_date(value(c), dayfirst).isNull()
        else:
            continue
        aggs += [F.count_if(bad).alias(f"{c}_unreadable"), F.min(F.when(bad, F.col("line_number"))).alias(f"{c}_first_unreadable")]
    if kind == "payments.csv":
        aggs.append(F.count_if(money.parse_amount(value("paid_amount")) < 0).alias("reversals"))
    return x.groupBy(*FILE).agg(*aggs)
