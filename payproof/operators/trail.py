"""The decision log: chained, sealed, checked, and replayed."""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payproof import schema as S
from payproof.scale import checkpointed, running

FIELDS = ["time", "actor", "action", "finding", "detail"]
BATCH = 50_000                # entries of one dataset a task chains at a time
CHAINED = "dataset_id string, seq bigint, time string, actor string, action string, finding string, detail string, prev string, hash string"


def body() -> Column:
    """An entry as one string; the separator cannot occur in it."""
    return F.array_join(F.transform(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in FIELDS]),
                                    lambda x: F.replace(x, F.lit("\u001f"), F.lit(" "))), "\u001f")


def entry_hash(prev: Column, words: Column) -> Column:
    return F.sha2(F.concat(prev, words), 256)


def _chain(batches):
    for batch in batches:
        out = []
        for dataset_id, head, entries in zip(batch["dataset_id"], batch["head"], batch["entries"]):
            prev = head
            for e in entries:
                now = hashlib.sha256((prev + e["words"]).encode()).hexdigest()
                out.append((dataset_id, e["seq"], *[e[f] for f in FIELDS], prev, now))
                prev = now
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAINED.split(", ")])


def positions(log: DataFrame) -> DataFrame:
    """Position of each entry in its dataset's log, from 0."""
    return running(log, ["dataset_id"], [("_blk", F.floor(F.col("seq") / (1 << 16)))], [F.col("seq")], {"pos": F.lit(1)})


def append(entries: DataFrame, heads: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """Chain new entries onto the logs whose last hashes are `heads` (dataset_id, head). A chain is one after the other
    by nature, so a long one is taken a batch at a time: every dataset's next batch in parallel, then the next."""
    placed = positions(entries.select("dataset_id", "seq", *FIELDS)).withColumn("batch", F.floor(F.col("pos") / batch)).withColumn("words", body())
    last = placed.agg(F.max("batch")).first()[0] or 0
    done = None
    for b in range(int(last) + 1):
        now = (placed.where(F.col("batch") == b).groupBy("dataset_id")
               .agg(F.array_sort(F.collect_list(F.struct("seq", *FIELDS, "words"))).alias("entries")))
        now = (now.join(heads, "dataset_id", "left") if heads is not None else now.withColumn("head", F.lit(None).cast("string")))
        got = checkpointed(now.select("dataset_id", F.coalesce("head", F.lit(S.GENESIS)).alias("head"), "entries").mapInPandas(_chain, CHAINED))
        heads = got.groupBy("dataset_id").agg(F.max_by("hash", "seq").alias("head"))
        done = got if done is None else done.union(got)
    return done


def seal(count: Column, head: Column, key: bytes) -> Column:
    """HMAC-SHA256 over the number of entries and the last hash. Spark has no HMAC, but it is two hashes around the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)
    message = F.encode(F.concat_ws("|", count.cast("string"), head), "UTF-8")
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner.hex())), message), 256))), 256)


def seals(log: DataFrame, key: bytes) -> DataFrame:
    return (log.groupBy("dataset_id").agg(F.count("*").alias("entries"), F.max_by("hash", "seq").alias("head"))
            .select("dataset_id", seal(F.col("entries"), F.col("head"), key).alias("seal")))


def verify(log: DataFrame, key: bytes, sealed: DataFrame) -> DataFrame:
    """(dataset_id, intact, broken_at): the first entry that does not follow from the one before it; the log's length
    when only its seal fails (entries cut off the end, or another log)."""
    placed = positions(log)
    before = placed.select("dataset_id", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("due"))
    x = placed.join(before, ["dataset_id", "pos"], "left")
    good = (F.col("prev") == F.coalesce("due", F.lit(S.GENESIS))) & (F.col("hash") == entry_hash(F.col("prev"), body()))
    state = x.groupBy("dataset_id").agg(F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("pos"))).alias("first_bad"),
                                        F.count("*").alias("entries"), F.max_by("hash", "seq").alias("head"))
    s = state.join(sealed, "dataset_id", "left")
    fits = F.coalesce(F.col("seal") == seal(F.col("entries"), F.col("head"), key), F.lit(False))
    return s.select("dataset_id", F.coalesce("first_bad", F.when(~fits, F.col("entries"))).alias("broken_at")) \
        .withColumn("intact", F.col("broken_at").isNull())


def replay(log: DataFrame) -> DataFrame:
    """(dataset_id, finding, status): the last decision of each finding since the last new run; a reset removes it."""
    start = log.where(F.col("action") == S.NEW_RUN).groupBy("dataset_id").agg(F.max("seq").alias("started"))
    acts = log.where(F.col("action").isin("Approved", "Rejected", "Reset to pending")).join(start, "dataset_id", "left")
    return (acts.where("started IS NULL OR seq > started").groupBy("dataset_id", "finding").agg(F.max_by("action", "seq").alias("status"))
            .where("status <> 'Reset to pending'"))


def mismatches(log: DataFrame, recorded: DataFrame) -> DataFrame:
    """Findings whose recorded decision differs from what the log says."""
    want, have = replay(log).withColumnRenamed("status", "logged"), recorded.withColumnRenamed("status", "recorded")
    return want.join(have, ["dataset_id", "finding"], "full_outer").where(~F.col("logged").eqNullSafe(F.col("recorded")))


def own_run_decisions(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions taken by the person who started the dataset's last run."""
    user = F.regexp_extract("actor", r"\((.*)\)", 1)
    last = log.where(F.col("action") == S.NEW_RUN).groupBy("dataset_id").agg(F.max_by(user, "seq").alias("started_by"))
    return decisions.join(last, "dataset_id").where("decided_by = started_by")


def agent_entries(findings: DataFrame) -> DataFrame:
    """The agents' part of the trail: each proposal, then its verdict."""
    return findings.select("dataset_id", F.col("finding").cast("string").alias("finding"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat("area", F.lit(" agent")).alias("actor"), F.lit("Proposed").alias("action"), F.col("title").alias("detail")),
        F.struct(F.lit(1).alias("part"), F.lit("Skeptic").alias("actor"), F.concat(F.lit("Verdict: "), "verdict").alias("action"), F.col("reason").alias("detail")),
    )).alias("e")).select("dataset_id", "e.part", "e.actor", "e.action", "finding", "e.detail")


def full_trail(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Agent entries (parts 0 and 1), then people's (part 2, in log order)."""
    people = log.select("dataset_id", F.lit(2).alias("part"), "actor", "action", "finding", "detail")
    return agent_entries(findings).unionByName(people)
