"""Files to exact numbered lines."""
from __future__ import annotations

import codecs
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payproof import schema as S

# --- fixed values: what ends a line, and which characters read as Japanese ----
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
JAPANESE = re.compile("[　-ヿ一-鿿＀-￯]{2,}")
WESTERN = re.compile("[À-ÖØ-öø-ÿ]{1,2}")
FOREIGN_RUN = re.compile("[^\x00-\x7f]+")
STEMS = {"payments": "payments.csv", "approvals": "approvals.csv", "vendors": "vendors.csv", "contracts": "contracts.txt",
         "expenses": "expenses.csv", "invoices": "invoices.txt", "payment_run": "payment_run.csv", "bank_statement": "bank_statement.csv"}


def _zeros_at(first: int) -> Callable[[bytes], float]:
    """Western text in UTF-16 has a zero in nearly every second byte, from the first or from the second on."""
    def score(raw: bytes) -> float:
        zeros, others = raw[first::2], raw[1 - first::2]
        return 4 if len(raw) >= 8 and zeros.count(0) > 0.4 * len(zeros) and 10 * others.count(0) < zeros.count(0) else 0
    return score


def _decodes(codec: str, raw: bytes) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def _all_runs(pattern: re.Pattern, content: str | None) -> bool:
    runs = FOREIGN_RUN.findall(content or "")
    return bool(runs) and all(pattern.fullmatch(run) for run in runs)


#: Codecs a file may have, and how well all of its bytes speak for each.
CODECS: dict[str, Callable[[bytes], float]] = {
    "utf-16": lambda raw: 5 if raw.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)) else 0,
    "utf-16-le": _zeros_at(1),
    "utf-16-be": _zeros_at(0),
    "utf-8-sig": lambda raw: 3 if _decodes("utf-8-sig", raw) is not None else 0,
    "cp1252": lambda raw: 2 if _all_runs(WESTERN, raw.decode("cp1252", "replace")) else 0.5,
    "cp932": lambda raw: 1 if _all_runs(JAPANESE, _decodes("cp932", raw)) else 0,
}


def decode_bytes(raw: bytes) -> str:
    """Text of one file, by the codec that its content speaks for most; the first of equals."""
    best, most = "cp1252", 0.0
    for codec, score in CODECS.items():          # the scores fall from codec to codec, so most files are judged early
        got = score(raw)
        if got > most:
            best, most = codec, got
        if most >= 2:
            break
    return raw.decode(best, "replace")


def _decode_batches(batches):
    for batch in batches:
        batch["content"] = [decode_bytes(bytes(raw)).replace("\x00", "") for raw in batch["content"]]
        yield batch.rename(columns={"content": "text"})


def decode_files(files: DataFrame) -> DataFrame:
    """(path, content) to (path, text). Python's codecs, as Spark's decode knows no Windows or Japanese ones."""
    return files.select("path", "content").mapInPandas(_decode_batches, "path string, text string")


def split_lines(files: DataFrame, *keys: str) -> DataFrame:
    """One row per line, numbered from 1; a break at the very end starts no line."""
    body = F.regexp_replace("text", f"(?:{LINE_BREAK})\\z", "")
    rows = files.where(F.col("text") != "").select(*keys, F.posexplode(F.split(body, LINE_BREAK)).alias("n", "text"))
    return rows.select(*keys, (F.col("n") + 1).cast("bigint").alias("line_number"), "text")


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of large UTF-8 files, read in blocks by many tasks: each block counts its lines, and the counts of
    the blocks before it place them in the file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                       F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    sizes = raw.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    # ids grow by one within a block, which one task reads from start to end
    return raw.join(starts, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_number"), "text")


def file_of(path: Column) -> Column:
    """The file a path belongs to. One that Spark or Hadoop saved in parts is a folder of parts, and is one file."""
    return F.regexp_replace(path, r"/part-[^/]*$", "")


def parts_joined(lines: DataFrame) -> DataFrame:
    """Numbered lines of parts (file, path, line_number, text) numbered through each file: parts follow by name, and the
    lines of those before place a part. What is put in order is one row per part."""
    sizes = lines.groupBy("file", "path").agg(F.max("line_number").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(starts, "path").withColumn("line_number", F.col("line_number") + F.col("before")).drop("path", "before")


def kind_of(path: Column) -> Column:
    """The kind a file's name says: its stem is the kind, starts with it or ends with it; NULL when it says nothing. Of
    a name written as column=value the value counts."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/=]*)$", 1), r"\.[^.]*$", ""))
    return F.coalesce(*[F.when((stem == k) | stem.startswith(k + "_") | stem.endswith("_" + k), F.lit(STEMS[k])) for k in STEMS])


def one_per_slot(files: DataFrame) -> DataFrame:
    """Mark the file kept for each dataset and kind (`kept`): properly named before recognised, then by path."""
    key = ["dataset_id", "kind"]
    best = files.groupBy(*key).agg(F.min(F.struct((~F.col("named")).alias("guessed"), "path")).getField("path").alias("kept_path"))
    return files.join(best, key).withColumn("kept", F.col("path") == F.col("kept_path"))


def long_line_notes(lines: DataFrame, *keys: str) -> DataFrame:
    """Per file: how many lines are longer than the reader of a report expects, and the first of them. They are checked whole."""
    return (lines.where(F.length("text") > S.LONG_LINE_CHARS).groupBy(*keys)
            .agg(F.count("*").alias("cut_lines"), F.min("line_number").alias("first_cut")))


def dataset_digest(lines: DataFrame) -> DataFrame:
    """One digest per upload, the same whatever order its lines are read in: a count and two sums of line hashes."""
    h = F.xxhash64("source_file", "line_number", "text")
    g = F.xxhash64(F.lit(7), "text", "line_number", "source_file")
    wide = "decimal(38,0)"
    return lines.groupBy("dataset_id", "upload").agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum(h.cast(wide)), F.sum(g.cast(wide))), 256).alias("digest"))


def labelled_uploads(digests: DataFrame) -> DataFrame:
    """Name for each upload: equal content under one name is one dataset; different content gets 'name (2)' and on."""
    first = digests.groupBy("dataset_id", "digest").agg(F.min("upload").alias("upload"))
    place = F.row_number().over(Window.partitionBy("dataset_id").orderBy("upload"))
    named = first.withColumn("n", place).select("dataset_id", "digest", F.when(F.col("n") == 1, F.col("dataset_id"))
                                                .otherwise(F.concat("dataset_id", F.lit(" ("), "n", F.lit(")"))).alias("label"))
    return digests.join(named, ["dataset_id", "digest"]).select("dataset_id", "upload", "label")

