"""Tables in the folder that all executors share, so that rounds of a job don't depend on lost executors' shuffle files."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a session on one machine names none (tests), a local folder is set; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path; a leftover costs space, nothing else."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def until_exit(spark: SparkSession, path: str) -> str:
    """A new folder that goes when the driver's JVM ends, whatever is left in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


class Rounds:
    """Tables of one job's rounds: each is written and read again, and goes when it is dropped or the session's program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, until_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, table: DataFrame) -> None:
        if path := self._paths.pop(id(table), None):
            delete(self.spark, path)
