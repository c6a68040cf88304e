"""Connected components by alternating large-star and small-star."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.llm.steps import Steps


def _contents(edges: DataFrame) -> tuple:
    wide = "decimal(38,0)"
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast(wide)), F.sum(F.xxhash64("v", F.lit(1), "u").cast(wide))).first())


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), the component named by its smallest node; loops are fine, nulls are not.

    Large star: every node hands its larger neighbours to its smallest one. Small star: every node and its smaller
    neighbours point at the smallest of them. Each round is written as a table; it ends when a round changes nothing, and
    rounds grow with the logarithm of the longest chain. A hub's edges meet its minimum in a plain join, whose large
    partitions Spark can split; all else is combined before it is moved."""
    now = steps.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = steps.write(now.select(F.col("u").alias("node")).union(now.select("v")).distinct())
    seen, state = None, _contents(now)
    while seen != state:
        both = now.where("u <> v").union(now.where("u <> v").select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = steps.write(large, tidy=False)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = steps.write(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct(), tidy=False)
        steps.drop(now, large)
        now, seen, state = small, state, _contents(small)
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
