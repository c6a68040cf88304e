"""Grading runs against an answer key of planted problems and look-alike traps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.scale import checkpointed

RUN = ["dataset_id", "engine"]


def key_lines(key: DataFrame) -> DataFrame:
    """(dataset_id, id, position, expect, source_file, line): every line a key row stands on; `position` is the row's place in the key."""
    return key.select("dataset_id", "id", "position", "expect", "source_file",
                      F.explode(F.array_distinct(F.array_compact(F.array("line_number", "related_line")))).alias("line"))


def matches(runs: DataFrame, key: DataFrame) -> DataFrame:
    """(run, finding, key id, its position, expect, own): findings and key rows of one file with a line in common; `own` when it is
    the finding's own line."""
    cited = runs.select(*RUN, "finding", "source_file", "verdict", "reason", F.explode(F.array_compact(F.array(
        F.struct(F.col("line_number").alias("line"), F.lit(True).alias("own")),
        F.when(F.col("related_line").isNotNull(), F.struct(F.col("related_line").alias("line"), F.lit(False).alias("own")))))).alias("c"))
    return (cited.select(*RUN, "finding", "source_file", "verdict", F.col("c.line").alias("line"), F.col("c.own").alias("own"))
            .join(key_lines(key), ["dataset_id", "source_file", "line"])
            .groupBy(*RUN, "finding", "id", "position", "expect").agg(F.bool_or("own").alias("own"), F.first("verdict").alias("verdict")))


def credit(pairs: DataFrame) -> DataFrame:
    """(run, finding, id): each finding is credited to at most one key row, its own line's first, else the first not
    yet found in the key's order, findings taken in order.

    Findings propose to the row they like best, a row keeps the earliest finding, and refused findings go on to their
    next: with rows that all prefer earlier findings this ends in exactly the one-by-one result, while every round is
    a grouped minimum over the whole cluster."""
    open_ = checkpointed(pairs.select(*RUN, "finding", "id", "position", (~F.col("own")).alias("far")))
    while True:
        wish = open_.groupBy(*RUN, "finding").agg(F.min(F.struct("far", "position", "id")).getField("id").alias("id"))
        winner = wish.groupBy(*RUN, "id").agg(F.min("finding").alias("winner"))
        refused = checkpointed(wish.join(winner, [*RUN, "id"]).where("finding <> winner").select(*RUN, "finding", "id"))
        if refused.isEmpty():
            return wish
        open_ = checkpointed(open_.join(refused, [*RUN, "finding", "id"], "left_anti"))


def scores(runs: DataFrame, key: DataFrame) -> DataFrame:
    """Recall, precision and traps flagged per run."""
    pairs = checkpointed(matches(runs, key))
    real = pairs.where("expect <> 'trap'")
    found = credit(real).groupBy(*RUN).agg(F.count_distinct("id").alias("found"))
    true = real.groupBy(*RUN).agg(F.count_distinct("finding").alias("true_pos"))
    traps = pairs.where("expect = 'trap'").groupBy(*RUN).agg(F.count_distinct("id").alias("traps_flagged"))
    planted = key.groupBy("dataset_id").agg(F.count_if(F.col("expect") != "trap").alias("planted"), F.count_if(F.col("expect") == "trap").alias("traps"))
    out = (runs.groupBy(*RUN).agg(F.count("*").alias("proposed")).join(planted, "dataset_id").join(found, RUN, "left").join(true, RUN, "left")
           .join(traps, RUN, "left").fillna(0, ["found", "true_pos", "traps_flagged"]))
    share = F.when(F.col("planted") > 0, F.col("found") / F.col("planted")).otherwise(0.0)
    return (out.withColumn("false_alarms", F.col("proposed") - F.col("true_pos")).withColumn("recall", share)
            .withColumn("precision", F.col("true_pos") / F.col("proposed")))


def trap_kinds(pairs: DataFrame, key: DataFrame) -> DataFrame:
    """Kinds of trap each run fell for, read from 'TRAP (kind) ...'."""
    hit = pairs.where("expect = 'trap'").select(*RUN, "id").distinct().join(key.select("dataset_id", "id", "description"), ["dataset_id", "id"])
    return hit.select(*RUN, F.replace(F.substring_index("description", ")", 1), F.lit("TRAP ("), F.lit("")).alias("kind")).distinct()


def skeptic_scores(runs: DataFrame, key: DataFrame) -> DataFrame:
    """How a second opinion did, for runs whose verdicts are not all the rules' own."""
    pairs = checkpointed(matches(runs, key).where("expect <> 'trap'"))
    hit = pairs.select(*RUN, "finding").distinct().withColumn("hit", F.lit(True))
    judged = (runs.where("verdict IN ('Confirmed', 'Doubtful')").join(hit, [*RUN, "finding"], "left")
              .withColumn("hit", F.coalesce("hit", F.lit(False))))
    yes = F.col("verdict") == "Confirmed"
    planted = key.where("expect <> 'trap'").groupBy("dataset_id").agg(F.count("*").alias("planted"))
    confirmed = pairs.where("verdict = 'Confirmed'").groupBy(*RUN).agg(F.count_distinct("id").alias("confirmed_rows"))
    g = judged.groupBy(*RUN).agg(
        F.count_if(yes).alias("confirmed"), F.count_if(yes & F.col("hit")).alias("confirmed_hits"),
        F.count_if(~yes & F.col("hit")).alias("real_doubted"), F.count_if(~yes & ~F.col("hit")).alias("false_alarms_caught"),
        F.bool_or(~F.contains(F.lower("reason"), F.lit("rule check"))).alias("second_opinion")).where("second_opinion")
    return (g.join(planted, "dataset_id").join(confirmed, RUN, "left")
            .select(*RUN, "confirmed", F.when(F.col("confirmed") > 0, F.col("confirmed_hits") / F.col("confirmed")).otherwise(0.0).alias("precision_confirmed"),
                    (F.coalesce("confirmed_rows", F.lit(0)) / F.col("planted")).alias("recall_confirmed"), "real_doubted", "false_alarms_caught"))


def per_issue(runs: DataFrame, key: DataFrame, engines: list[str]) -> DataFrame:
    """One row per key row, a column per run with what the run did about it."""
    pairs = matches(runs, key)
    said = pairs.groupBy("dataset_id", "id").pivot("engine", engines).agg(F.min_by("verdict", "finding"))
    trap = F.col("expect") == "trap"

    def outcome(e: str):
        v = F.col(e)
        return F.when(trap, F.when(v.isNull(), "Left alone").otherwise("FALSE ALARM")) \
            .otherwise(F.when(v.isNull(), "Missed").when(v == "Doubtful", "Found (doubted)").otherwise("Found")).alias(e)
    return (key.join(said, ["dataset_id", "id"], "left")
            .select("dataset_id", "id", F.when(trap, "Trap (legitimate)").otherwise("Problem").alias("kind"), "clause", "source_file",
                    F.least("line_number", "related_line").alias("line"), *[outcome(e) for e in engines]))


def summary(scored: DataFrame) -> DataFrame:
    """Means over the runs of each engine."""
    return scored.groupBy("engine").agg(
        F.count("*").alias("runs"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"),
        F.avg("false_alarms").alias("false_alarms"), F.sum("traps_flagged").alias("traps_flagged"), F.sum("traps").alias("traps"))
