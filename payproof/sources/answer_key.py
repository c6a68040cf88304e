"""Answer keys: from a key file, or from findings already reviewed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payproof.functions.text import strip


def from_rows(rows: DataFrame) -> DataFrame:
    """Key rows given as text columns: the main line and the related ones ('5;7,9') as one sorted list; a row planted
    twice counts once, the first id stays."""
    related = F.filter(F.split("related_lines", "[;,]"), lambda x: strip(x).rlike("^[0-9]+$"))
    lines = F.array_sort(F.array_distinct(F.concat(F.array(F.col("line_text").try_cast("bigint")), F.transform(related, lambda x: strip(x).cast("bigint")))))
    said = F.lower(strip(F.col("expect")))
    k = (rows.where(F.col("line_text").try_cast("bigint").isNotNull()).withColumn("lines", lines).withColumn("source_file", strip(F.col("source_file")))
         .withColumn("expect", F.when(said == "", "problem").otherwise(said)))
    return (k.groupBy("dataset_id", "source_file", "lines", "expect")
            .agg(F.min(F.struct("id", "clause", "area", "description")).alias("kept_row"))
            .select("dataset_id", "source_file", "lines", "expect", "kept_row.*"))


def from_findings(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(dataset_id, finding, line): the lines of each finding, related quotes found by their text."""
    key = ["dataset_id", "source_file"]
    quoted = findings.where("related_text <> ''").select(*key, "finding", F.explode(F.split("related_text", r" \|\| ")).alias("text"))
    own = findings.select("dataset_id", "finding", F.col("line_number").alias("line"))
    found = quoted.join(lines, [*key, "text"]).select("dataset_id", "finding", F.col("line_number").alias("line"))
    return own.union(found).distinct()
