"""Steps that stay bounded however the data is distributed.

A window over a vendor, a person or a whole dataset puts that group into one task. The helpers here cut a group into
pieces by columns that follow the wanted order (a day, then a block of line numbers), add up each piece with a
map-side combined aggregate, and only then number or sum the rows inside their small piece.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_BLOCK = 1 << 16          # rows a piece can hold: line numbers are unique within a file


def line_block(line: Column) -> Column:
    return F.floor(line / LINE_BLOCK)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the one the cluster names, or in a local session one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="payproof-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and go on from that table: what is needed again is computed once, a lost
    executor costs a read and not a rerun, and Spark knows the size of what it joins next. The table goes when the
    session ends."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


FEW_ROWS = 10_000             # a table that every task of a join may hold


def facts(df: DataFrame) -> DataFrame:
    """A table that is mostly short (a row per file) to be joined to the lines it tells of. Written and counted first: a
    short one goes to every task and the lines stay where they are, instead of being moved and sorted by the few files
    they come from; a longer one is joined by sorting, however small it looks on disk."""
    known = checkpointed(df)
    return F.broadcast(known) if known.count() <= FEW_ROWS else known.hint("merge")


def running(df: DataFrame, keys: list[str], levels: list[tuple[str, Column]], order: list[Column],
            sums: dict[str, Column], settle: bool = True) -> DataFrame:
    """Add, for each name in `sums`, the total of its expression over the rows of the same keys that come earlier in
    order (the row itself not included). `levels` cut a group from coarse to fine, each following the order, so that
    the rows of one piece are few; no task ever orders a whole group. Keys must not be null.

    The rows are read twice, so by default they are materialised first: callers pass the few rows that matter. With
    `settle=False` a whole table is read twice instead."""
    names = [n for n, _ in levels]
    parts = df.select("*", *[e.alias(n) for n, e in levels], *[e.alias(f"_v_{s}") for s, e in sums.items()])
    if settle:
        parts = checkpointed(parts)
    pieces = parts.groupBy(*keys, *names).agg(*[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
    offsets = pieces
    for depth, here in enumerate(names):
        # totals of this depth's pieces, then of everything before each piece within the piece one level up
        level = (pieces if depth == len(names) - 1 else
                 pieces.groupBy(*keys, *names[:depth + 1]).agg(*[F.sum(f"_t_{s}").alias(f"_t_{s}") for s in sums]))
        w = (Window.partitionBy(*keys, *names[:depth]).orderBy(here)
             .rowsBetween(Window.unboundedPreceding, -1))
        before = level.select(*keys, *names[:depth + 1],
                              *[F.coalesce(F.sum(f"_t_{s}").over(w), F.lit(0)).alias(f"_b{depth}_{s}") for s in sums])
        offsets = before if depth == 0 else before.join(offsets, [*keys, *names[:depth]])
    joined = parts.join(offsets, [*keys, *names])
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = {s: sum((F.col(f"_b{d}_{s}") for d in range(len(names))), F.coalesce(F.sum(f"_v_{s}").over(inside), F.lit(0)))
          for s in sums}
    return joined.select(*df.columns, *[e.alias(s) for s, e in at.items()])


def _contents(edges: DataFrame) -> tuple:
    """A count and two hash sums: equal for equal edge sets whatever their order, and one combined aggregate to get."""
    wide = "decimal(38,0)"
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast(wide)), F.sum(F.xxhash64("v", F.lit(1), "u").cast(wide))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph as (node, component), the component named by its smallest node.

    The alternating large-star / small-star method: each round is one or two groupBys, rounds grow with the logarithm
    of the longest chain, and every round is cut by a checkpoint. Only minima are taken over a node's neighbours, so a
    node with a third of all edges is combined before its shuffle."""
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    state = _contents(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: a node hands its larger neighbours to its smallest neighbour (or itself)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: a node and its smaller neighbours point at the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        new = checkpointed(small)
        seen, state = state, _contents(new)
        e = new
        if state == seen:
            break
    return (nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))

