"""The recurring folder check: new files in, a report of new findings and held payments out.

A micro-batch brings the files that are new since the last run. Duplicates, reversals and date order are judged on whole
files, so each dataset a batch touches is checked again from the files of its folder, and only those folders are read.
What was reported before is told apart by fingerprint. Fingerprints are remembered per dataset, as of the dataset's last
report, and written after the alert under the batch's id: a batch that failed half way is repeated, one that is repeated
overwrites itself.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from payproof import schema as S
from payproof.functions import money, text
from payproof.operators import review
from payproof.operators.findings import union
from payproof.plans.audit import Files, files_from_lines, hold_or_release, run_area
from payproof.scale import checkpointed
from payproof.sources import lines as L

STATE = "dataset_id string, fingerprint string, bucket int, batch long"
FILES = "path string, modificationTime timestamp, length long, content binary"
FINDINGS = "dataset_id string, area string, clause string, severity string, amount decimal(18,4), title string, source_file string, line_number long, anchor long"
HOLDS = "dataset_id string, line string, supplier string, invoice string, amount decimal(18,4), decision string, reason string"
STATE_BUCKETS = 64                                           # datasets share the folders of the state; a batch reads and writes those it touches
ALERT_FINDINGS, ALERT_PROBLEMS = 10, 5                       # how many an alert lists


def dataset_of(path: Column) -> Column:
    """A dataset is the folder its files lie in; of a name written as column=value the value."""
    return F.regexp_extract(L.file_of(path), r"([^/=]+)/[^/]*$", 1)


def slots(files: DataFrame) -> DataFrame:
    """One row per file: its dataset, its kind (null for none of ours), and whether it is the one kept of its kind."""
    listed = files.select(L.file_of(F.col("path")).alias("path")).distinct().select("path", dataset_of(F.col("path")).alias("dataset_id"), L.kind_of(F.col("path")).alias("kind"))
    named = L.one_per_slot(listed.where("kind IS NOT NULL").withColumn("named", F.lit(True)))
    return named.select("dataset_id", "kind", "path", "kept", "kept_path").unionByName(listed.where("kind IS NULL").select("dataset_id", "kind", "path", F.lit(False).alias("kept"), F.lit(None).cast("string").alias("kept_path")))


def raw_lines(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Numbered lines of the audit files, one file per dataset and kind."""
    mine = kept.where("kept").select(F.col("path").alias("file"), "dataset_id", "kind")
    parts = files.withColumn("file", L.file_of(F.col("path"))).join(mine.select("file"), "file", "left_semi")
    body = L.decode_files(parts).withColumn("file", L.file_of(F.col("path")))
    numbered = L.parts_joined(checkpointed(L.split_lines(body, "file", "path")))
    return numbered.join(mine, "file").select("dataset_id", F.col("kind").alias("source_file"), "line_number", "text")


def fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", text.fingerprint(F.col("clause"), F.col("source_file"), F.col("title")))


def bucket_of(dataset: Column) -> Column:
    return F.pmod(F.xxhash64(dataset), F.lit(STATE_BUCKETS)).cast("int")


def state_before(spark: SparkSession, state: str, touched: DataFrame, batch_id: int) -> DataFrame:
    """The state's buckets that hold the touched datasets, as the last batch before this one left them. A repeated batch
    does not meet its own. At most STATE_BUCKETS numbers reach the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STATE)
    asked = [r["bucket"] for r in touched.select(bucket_of(F.col("dataset_id")).alias("bucket")).distinct().collect()]
    table = spark.read.schema(STATE).parquet(state).where(F.col("bucket").isin(asked) & (F.col("batch") < batch_id))
    newest = table.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()       # reads partition values only
    here = F.lit(False)
    for r in newest:
        here = here | ((F.col("bucket") == r["bucket"]) & (F.col("batch") == r["batch"]))
    return table.where(here)


def remember(touched: DataFrame, reported: DataFrame, before: DataFrame, state: str, batch_id: int) -> None:
    """Write the touched buckets anew: their other datasets as they were, the touched ones with what was reported now. A
    dataset without findings keeps a row, so that its old ones are forgotten."""
    kept = before.join(touched, "dataset_id", "left_anti").select("dataset_id", "fingerprint")
    now = touched.select("dataset_id").join(reported.select("dataset_id", "fingerprint").distinct(), "dataset_id", "left")
    rows = kept.unionByName(now).select("dataset_id", "fingerprint", bucket_of(F.col("dataset_id")).alias("bucket"), F.lit(batch_id).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(state)


def report_rows(findings: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """Findings as the report lists them: new ones marked, text that a spreadsheet would run made safe."""
    old = known.distinct().withColumn("old", F.lit(True))
    quote = evidence.select("dataset_id", "source_file", "line_number", F.col("text").alias("evidence"))
    return (fingerprints(findings).join(old, ["dataset_id", "fingerprint"], "left")
            .join(quote, ["dataset_id", "source_file", "line_number"], "left")
            .select("dataset_id", F.when(F.col("old").isNull(), "yes").otherwise("").alias("new"), "severity", "area", "clause",
                    F.col("amount").cast("decimal(18,2)").alias("amount"), text.safe_cell(F.col("title")).alias("title"), "source_file", "line_number",
                    text.safe_cell(F.coalesce("evidence", F.lit(""))).alias("evidence"), "fingerprint"))


def hold_rows(decisions: DataFrame) -> DataFrame:
    """Payment run lines on hold as the report lists them."""
    return decisions.where("decision = 'HOLD'").select("dataset_id", *[text.safe_cell(F.col(c)).alias(c) for c in ("line", "supplier", "invoice")],
                                                      F.col("amount").cast("decimal(18,2)").alias("amount"), text.safe_cell(F.col("reason")).alias("reason"))


def alert_feed(report: DataFrame, problems: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """One row per dataset with something new, held or not checked: counts for a notifier to word."""
    new = report.where("new = 'yes'").groupBy("dataset_id").agg(F.count("*").alias("new_findings"), F.count_if(F.col("severity") == "High").alias("high"),
                                                                 money.dollars(F.sum("amount")).alias("flagged"))
    bad = problems.groupBy("dataset_id").agg(F.count("*").alias("problems"))
    feed = new.join(bad, "dataset_id", "full_outer")
    feed = feed.withColumn("held", F.lit(0).cast("long")) if holds is None else feed.join(holds.groupBy("dataset_id").agg(F.count("*").alias("held")), "dataset_id", "full_outer")
    return feed.fillna(0, ["new_findings", "high", "problems", "held"])


def first_new(report: DataFrame, most: int) -> DataFrame:
    """The new findings an alert lists: the first `most` of each dataset, the most severe before the others."""
    order = Window.partitionBy("dataset_id").orderBy(review.rank_in(F.col("severity"), S.SEVERITIES), "source_file", "line_number", "clause")
    return report.where("new = 'yes'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def first_problems(problems: DataFrame, most: int) -> DataFrame:
    """The data problems an alert lists: the first `most` of each dataset, in the order in which files are read and checked."""
    order = Window.partitionBy("dataset_id").orderBy("place", "source_file", "note")
    return problems.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def alert_lines(report: DataFrame, problems: DataFrame) -> DataFrame:
    """What an alert lists below its counts: (dataset_id, nth, line), findings before problems."""
    found = first_new(report, ALERT_FINDINGS).select("dataset_id", F.col("place").alias("nth"), F.format_string("[%s] %s", "severity", "title").alias("line"))
    bad = first_problems(problems, ALERT_PROBLEMS).select("dataset_id", (F.col("nth") + ALERT_FINDINGS).alias("nth"), F.concat(F.lit("NOT CHECKED: "), "note").alias("line"))
    return found.unionByName(bad)


def data_problems(headers: DataFrame) -> DataFrame:
    """Files that were not checked, and why: never an all-clear."""
    return headers.where("NOT checked").select("dataset_id", "source_file", F.concat("source_file", F.lit(" is missing columns: "), F.array_join("lacking", ", "),
                                                                                     F.lit(" - it was not checked")).alias("note"), F.lit(2).alias("place"))


def slot_problems(kept: DataFrame) -> DataFrame:
    """Second files of a kind, and datasets without a file of any kind."""
    base = lambda c: F.regexp_extract(c, r"([^/=]*)$", 1)
    second = kept.where("kind IS NOT NULL AND NOT kept").select("dataset_id", F.col("kind").alias("source_file"), F.concat(
        F.lit("Two files are read as "), "kind", F.lit(": kept "), base(F.col("kept_path")), F.lit(", skipped "), base(F.col("path"))).alias("note"), F.lit(1).alias("place"))
    none = kept.groupBy("dataset_id").agg(F.bool_or("kept").alias("any")).where("NOT any").select(
        "dataset_id", F.lit("").alias("source_file"), F.lit("No audit files were found in the folder").alias("note"), F.lit(4).alias("place"))
    return second.unionByName(none)


def run_problems(kept: DataFrame, decisions: DataFrame) -> DataFrame:
    """Payment runs of which no line could be checked."""
    runs = kept.where("kept AND kind = 'payment_run.csv'").select("dataset_id")
    return runs.join(decisions.select("dataset_id").distinct(), "dataset_id", "left_anti").select("dataset_id", F.lit("payment_run.csv").alias("source_file"), F.lit(
        f"payment_run.csv could not be checked (columns {', '.join(S.REQUIRED['payment_run.csv'][:-1])} and {S.REQUIRED['payment_run.csv'][-1]} are needed)").alias("note"), F.lit(3).alias("place"))


def publish(touched: DataFrame, found: DataFrame, evidence: DataFrame, holds: DataFrame, problems: DataFrame, out: str, batch_id: int,
            alert: Callable[[DataFrame], None]) -> None:
    """Write a batch's report, holds, problems and alert, send the alert, and only then remember: if the alert failed, the
    batch is repeated and alerts again."""
    before = state_before(found.sparkSession, f"{out}/state", touched, batch_id)
    report = checkpointed(report_rows(found, evidence, before.where("fingerprint IS NOT NULL").select("dataset_id", "fingerprint")))
    report.drop("fingerprint").write.mode("overwrite").option("header", True).csv(f"{out}/findings/batch={batch_id}")
    holds.write.mode("overwrite").option("header", True).csv(f"{out}/holds/batch={batch_id}")
    problems.write.mode("overwrite").parquet(f"{out}/problems/batch={batch_id}")
    alert_lines(report, problems).write.mode("overwrite").parquet(f"{out}/alert_lines/batch={batch_id}")
    feed = checkpointed(alert_feed(report, problems, holds))
    feed.write.mode("overwrite").parquet(f"{out}/alerts/batch={batch_id}")
    alert(feed)
    remember(touched, report, before, f"{out}/state", batch_id)


def touched_folders(batch: DataFrame) -> list[str]:
    """The folders of a batch's files, as patterns that mean just them. Like the stream's own listing this is a list on the driver."""
    folder = F.regexp_extract(L.file_of(F.col("path")), r"^(.*)/[^/]*$", 1)
    return [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["folder"]) for r in batch.select(folder.alias("folder")).distinct().collect()]


def findings_of(spark: SparkSession, files: Files, areas: list[str]) -> DataFrame:
    found = [f for area in areas for f in run_area(area, files)]
    return union([f.findings for f in found]) if found else spark.createDataFrame([], FINDINGS)


def write_batch(spark: SparkSession, out: str, kinds: list[str], areas: list[str], alert: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        touched = checkpointed(batch.select(dataset_of(F.col("path")).alias("dataset_id")).distinct())
        folders = touched_folders(batch)
        if not folders:
            return
        # the datasets a batch touches, in full
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
        mine = whole.withColumn("dataset_id", dataset_of(F.col("path"))).join(touched, "dataset_id", "left_semi")
        kept = checkpointed(slots(mine))
        lines = checkpointed(raw_lines(mine.select("path", "content"), kept))
        there = {r["kind"] for r in kept.where("kept").select("kind").distinct().collect()}
        files, headers = files_from_lines(lines, [k for k in kinds if k in there])
        decisions = hold_or_release(files)
        decisions = checkpointed(decisions) if decisions is not None else spark.createDataFrame([], HOLDS)
        problems = slot_problems(kept).unionByName(run_problems(kept, decisions))
        if headers is not None:
            problems = problems.unionByName(data_problems(headers))
        publish(touched, checkpointed(findings_of(spark, files, areas)), lines, hold_rows(decisions), checkpointed(problems), out, batch_id, alert)
    return run


def watch(spark: SparkSession, folder: str, out: str, kinds: list[str], alert: Callable[[DataFrame], None], areas: list[str] = S.AREAS) -> StreamingQuery:
    """Check whatever is new in the folder and stop, as a scheduled job does."""
    new = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return (new.select("path").writeStream.foreachBatch(write_batch(spark, out, kinds, areas, alert))
            .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start())
