"""Tables that a query writes once and reads several times, below the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it a query's shuffle files go when the query ends, and not when the driver happens to collect its garbage (Spark 4.1).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that spark.checkpoint.dir names, or the context's checkpoint folder. Where neither exists a
    temporary folder is made and set in local mode, as in tests; on a cluster, whose machines would not share it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = there.get() if there.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written below the shared folder: they cut lineage and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode(mode).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all when the program ends."""
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            return
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once: whatever is built on it reads the table and does not compute it anew."""
    return Scratch(df.sparkSession, name).save(df, "table")
