"""Tables written between the steps of one operator."""
from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from payproof.scale import shared_folder


class Steps:
    """Tables of an operator's finished steps, in the folder that spark.checkpoint.dir names (a local session without
    one gets a folder of its own). A lost executor costs a read of the table, not a rerun of the steps before it.

    `drop` removes tables that later steps don't read; the others go when the session ends. After each write the
    driver is asked to collect garbage: Spark deletes the shuffle files of a finished step only when the driver's
    objects for them are gone, and the next step needs the room on the executors' disks. (Not with tidy=False, for small steps.)"""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def _path(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, tidy: bool = True) -> DataFrame:
        where = f"{shared_folder(self.spark)}/llm-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(where)
        path, store = self._path(where)
        store.deleteOnExit(path)
        table = self.spark.read.schema(df.schema).parquet(where)
        self.paths[id(table)] = (table, where)
        if tidy:
            gc.collect()
            self.spark._jvm.System.gc()
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, store = self._path(self.paths.pop(id(table))[1])
            store.delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these: what is returned reads no others."""
        kept = {id(t) for t in tables}
        self.drop(*[table for at, (table, _) in list(self.paths.items()) if at not in kept])
