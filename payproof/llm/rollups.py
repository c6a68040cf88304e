"""Token counts as rollups that are maintained by signed changes.

A batch of events (insert, delete, revised count) is turned into signed changes of totals by source, language and tokenizer
version, and committed under its number. Totals are the sum of the committed changes: they are additive, so a batch is
read and combined once, and no total is computed again from the documents.

A commit is one folder for each batch with two tables, written in full before a marker that makes it count. A batch whose
marker is there is not applied again; one that broke off before it is written anew. So a replay changes nothing, whichever step failed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
EVENT = "doc_id long, source string, lang string, version string, kind string, tokens long"


def written(rollup: Rollup, name: str, df: DataFrame) -> DataFrame:
    """A table beside the rollup that several batches are made from."""
    df.write.mode("overwrite").parquet(f"{rollup.folder}/{name}")
    return rollup.spark.read.schema(df.schema).parquet(f"{rollup.folder}/{name}")


class Rollup:
    """Totals kept under a folder that every executor can read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        path, store = self._path("done")
        return sorted(int(f.getPath().getName()) for f in store.listStatus(path)) if store.exists(path) else []

    def _tables(self, name: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.folder}/batch-{b}/{name}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """What the rollup holds of each document and version: its last committed count, and under which source and language."""
        rows = self._tables("ledger", f"{EVENT}, batch long", self.committed())
        last = rows.groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "kind", "tokens"), "batch").alias("e"))
        return last.select("doc_id", "version", "e.*").where("kind <> 'delete'").drop("kind")

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Apply events (doc_id, source, lang, version, kind, tokens) of a batch; False if it had been applied. Batches are numbered
        in the order in which they hold.

        insert and revise give a document's count under a version: what stood there goes out with a minus, under the
        source and language it came in with. delete takes it out; of an unknown document it does nothing. Of several
        events of one document and version in a batch a delete comes last, and of the others the largest count holds.
        Null sources and languages are groups of their own; a null count is 0; events without doc_id or version, or of
        another kind, are none. Repeated events are one."""
        done, store = self._path(f"done/{batch}")
        if store.exists(done):
            return False
        if any(b > batch for b in self.committed()):
            raise ValueError(f"a later batch than {batch} is committed")
        rank = F.struct((F.col("kind") == "delete").alias("d"), F.coalesce("tokens", F.lit(0)).alias("n"), "source", "lang")
        events = events.where(F.col("doc_id").isNotNull() & F.col("version").isNotNull() & F.col("kind").isin("insert", "revise", "delete"))
        new = events.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max_by(F.struct("source", "lang", "kind", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), rank).alias("e"))
        new = new.select("doc_id", "e.source", "e.lang", "version", "e.kind", "e.tokens", F.lit(batch).cast("long").alias("batch"))
        where = f"{self.folder}/batch-{batch}"
        new.write.mode("overwrite").parquet(f"{where}/ledger")
        new = self.spark.read.schema(f"{EVENT}, batch long").parquet(f"{where}/ledger")
        old = self.ledger().join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
        signed = new.where("kind <> 'delete'").select(*KEYS, F.lit(1).alias("docs"), "tokens").union(old.select(*KEYS, F.lit(-1), -F.col("tokens")))
        changes = signed.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        changes.write.mode("overwrite").parquet(f"{where}/changes")
        store.create(done, True).close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of the groups that hold a document."""
        rows = self._tables("changes", "source string, lang string, version string, docs long, tokens long", self.committed())
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")
