"""Amount statistics: first digits, round amounts, amounts just under a limit."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.functions import money


def amounts(payments: DataFrame, approvals: DataFrame, expenses: DataFrame) -> DataFrame:
    """Positive amounts of the three files as (dataset_id, source_file, amount)."""
    parts = [payments.select("dataset_id", "source_file", F.col("paid_amount").alias("amount")),
             approvals.select("dataset_id", "source_file", "amount"), expenses.select("dataset_id", "source_file", "amount")]
    return parts[0].union(parts[1]).union(parts[2]).where("amount > 0")


def benford(amount_rows: DataFrame, keys: list[str]) -> DataFrame:
    """First-digit shares of each group against the expected ones: mean absolute deviation, its band, and whether the
    group is large and wide enough to say anything. One aggregate; nine counters per group."""
    rows = amount_rows.where("amount >= 1").withColumn("digit", money.first_digit(F.col("amount")))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"),
                                *[F.count_if(F.col("digit") == d).alias(f"d{d}") for d in range(1, 10)])
    mad = sum((F.abs(F.col(f"d{d}") / F.col("n") - F.lit(math.log10(1 + 1 / d))) for d in range(1, 10)), F.lit(0.0)) / 9
    band = F.lit(S.BENFORD_LAST_BAND)
    for limit, words in reversed(S.BENFORD_BANDS):
        band = F.when(F.col("mad") < limit, words).otherwise(band)
    span = F.log10(F.col("high").cast("double") / F.col("low").cast("double"))
    return (g.withColumn("mad", mad).withColumn("span", span).withColumn("verdict", band)
            .withColumn("usable", (F.col("n") >= S.BENFORD_MIN_ROWS) & (F.col("span") >= 2))
            .withColumn("mad", F.round("mad", 4)).withColumn("span", F.round("span", 1)).drop("low", "high"))


def round_share(amount_rows: DataFrame, keys: list[str], unit: int = 100, floor: int = 500) -> DataFrame:
    """Share of larger amounts that are whole multiples of the unit."""
    big = amount_rows.where(F.col("amount") >= floor)
    return (big.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("amount") % unit == 0).alias("round_n"))
            .withColumn("share", F.col("round_n") / F.col("n")))


def bunching(amount_rows: DataFrame, limits: dict, keys: list[str]) -> DataFrame:
    """Amounts within 4% under each limit against those within 4% over it."""
    tests = [("purchase-order limit", "approvals.csv", limits["po_limit"]), ("director limit", "approvals.csv", limits["director_limit"]),
             ("receipt limit", "expenses.csv", limits["receipt_limit"])]
    counts = []
    for i, (_, file, lim) in enumerate(tests):
        here = F.col("source_file") == file
        counts += [F.count_if(here & F.col("amount").between(lim * 96 / 100, lim)).alias(f"below{i}"),
                   F.count_if(here & (F.col("amount") > lim) & (F.col("amount") <= lim * 104 / 100)).alias(f"above{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(float(lim)).alias("limit_amount"), F.col(f"below{i}").alias("below"),
                                        F.col(f"above{i}").alias("above")) for i, (n, _, lim) in enumerate(tests)])).alias("t")
    return (amount_rows.groupBy(*keys).agg(*counts).select(*keys, each).select(*keys, "t.*")
            .withColumn("flag", (F.col("below") >= 3) & (F.col("below") >= 3 * F.greatest(F.col("above"), F.lit(1)))))


def recovery(claims: DataFrame) -> DataFrame:
    """Claims summed by supplier and overall."""
    return claims.rollup("supplier").agg(F.sum("claim").alias("claim"), F.count("*").alias("claims"))


def subscriptions(tools: DataFrame) -> DataFrame:
    """Idle licences and savings: a cancelled tool saves its whole cost, a reduced one the idle share."""
    idle = F.col("licences") - F.col("active_90d")
    saving = F.when(F.col("proposed_action") == "Cancel", F.col("annual_cost")).when(F.col("proposed_action") == "Reduce", F.col("saving")).otherwise(0)
    return tools.groupBy("proposed_action").agg(
        F.count("*").alias("tools"), F.sum("licences").alias("licences"), F.sum(idle).alias("idle"),
        F.bround(F.lit(100.0) * F.sum("active_90d") / F.sum("licences"), 0).alias("active_pct"), F.sum(saving).alias("saving"))

