"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight that changes in a straight line over the run, from `start` to `end` at progress 0 to 1. Its share is the
integral of that line, so its demand up to progress t is target * (start * t + (end - start) * t**2 / 2) / mean. Documents
of a source stand in a shuffled order, up to three times over; the word at which a document's pass begins is turned
back into the progress at which the source's demand gets there: the pass's position. Passes are range-sorted by it.

Everything is a DataFrame function. No task holds a source: starts are prefix sums over slices of the shuffled order, of which
a source has 4096, combined before they are moved.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payproof.llm.steps import Steps
from payproof.scale import running

PASSES = 3           # a document is taken as often at most
WEIGHTS = (1, 2, 3)


def words_in(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with weight, rising, target.

    Sources take the weights in turn, by code point with null last. They share the sum of all sizes by weight; a target stops at PASSES
    times its source's size and the rest is shared again among the others, until none is above. (The sources in order of
    size over weight: the first ones are full, and those from the first that is not full on share what is left.)
    One row per source is all that the windows here see."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("rank", order - 1).withColumn("cap", PASSES * F.col("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")),
                                       F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    return s.select("source", "source_size", "weight", (F.col("rank") % 2 == 0).alias("rising"), target.alias("target"))


def position(share: Column, rising: Column) -> Column:
    """The progress at which a source has given `share` of its target: its weight rises from 1/2 to 3/2 of its mean, or falls
    from 3/2 to 1/2."""
    start, slope = F.when(rising, 0.5).otherwise(1.5), F.when(rising, 1.0).otherwise(-1.0)
    return (F.sqrt(start * start + 2 * slope * share) - start) / slope


def plan(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of docs: the columns `keep`, size, source_size, target, taken and passes (an array of pass, taken and
    position, of the passes of which words are taken).

    The documents of a source are ordered by the md5 of doc_id, doc_id being its text. A pass is taken whole as long as the source's demand
    lasts; the pass in which it ends is taken up to that word. So a source's taken words differ from its target by less than
    one word. Reruns agree: rows with equal doc_id and size can change places, which changes no result. A null text has
    size 0; a source without a word has target 0 and nothing is taken of it; null sources are a source of their own; a null doc_id comes first in its source. An empty table gives an empty
    result."""
    steps = Steps(docs.sparkSession)
    turn = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = steps.write(docs.select(*keep, "source", words_in(F.col("text")).alias("size"), turn.alias("turn"),
                                   F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("in_source")))
    shares = steps.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    placed = running(rows, ["no_source", "in_source"], [("slice", F.substring("turn", 1, 3))], [F.col("turn"), F.col("size")], {"begin": F.col("size")}, settle=False)
    shares = shares.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("in_source"), "source_size", "target", "rising")
    begin = lambda p: p * F.col("source_size") + F.col("begin")
    demand = F.round("target").cast("long")
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), lambda p: F.struct(
        p.alias("pass"), F.greatest(F.lit(0), F.least(F.col("size"), demand - begin(p))).alias("taken"),
        position(F.least(F.try_divide(begin(p), F.col("target")), F.lit(1.0)), F.col("rising")).alias("position"))), lambda x: x["taken"] > 0)
    return (placed.join(shares, ["no_source", "in_source"]).withColumn("passes", passes)
            .select(*keep, "size", "source_size", "target", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["taken"]).alias("taken"), "passes"))


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.concat_ws("", F.slice(ends, F.lit(1), n.cast("int")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs (doc_id, text, source and others) in training order: a row for each pass that the plan takes, range-sorted by position. The
    pass in which its source's demand ends has the words up to there (and n_chars, if there is such a column, counts
    them). Rows that agree in doc_id, source and text are one document here, taken as often as all of them."""
    docs = docs.withColumn("__key", F.xxhash64("doc_id", "source", "text"))
    taken = (plan(docs, ["__key"], weights).where("taken > 0").select("__key", "size", F.explode("passes").alias("__pass")))
    taken = taken.select("__key", F.col("__pass.position").alias("__at"), F.col("__pass.taken").alias("__taken"), (F.col("__pass.taken") < F.col("size")).alias("__cut"))
    out = docs.dropDuplicates(["__key"]).join(taken, "__key")
    cut = F.when(F.col("__cut"), _first_words(F.col("text"), F.col("__taken"))).otherwise(F.col("text"))
    out = out.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.repartitionByRange("__at", "__key").sortWithinPartitions("__at", "__key").drop("__key", "__at", "__taken", "__cut")
