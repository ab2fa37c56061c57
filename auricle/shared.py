"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, without a slash at the end.

    Where none is set, a local session gets a temporary folder; on a cluster that is an error, as
    machines would not see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="auricle-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts lineage, so it outlives lost executors, and is read column by
    column. ``drop`` deletes one early; all are deleted when Python exits.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """``df`` as a written table. Spark removes the shuffle files of the job that writes it when it is done."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, the path as it takes it)."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def finished_batches(spark: SparkSession, path: str) -> dict[int, str]:
    """Number to folder of the batches ``batch=<number>`` under ``path`` that were written to their end."""
    fs, pattern = file_system(spark, f"{path}/batch=*/_SUCCESS")
    folders = [f.getPath().getParent() for f in fs.globStatus(pattern) or []]
    return {int(f.getName().removeprefix("batch=")): f.toString() for f in folders}
