"""What the operators of this subpackage share: shared-folder tables, Arrow slices, column checks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Bytes of text that a Python step works on at once.
SLICE_BYTES = 2_000_000
#: Rows of whole texts or sets that travel between Spark and Python at once.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where a session on one machine names none (tests), a local one is set; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, where the session has Spark's default: its 10,000 rows of whole texts fill both sides' memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return what a finished step no longer uses to the system; workers live on and serve other steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Workspace:
    """Tables written under the shared folder, so that no later step depends on an executor's lineage. The folder goes when the driver's JVM ends, as results are read from it until then."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        modest_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Write df and read it again."""
        return self.noted(df, name, narrow)[0]

    def noted(self, df: DataFrame, name: str, narrow: bool = False, **notes: Column) -> tuple[DataFrame, dict]:
        """Write df and read it again; also some aggregates of it, gathered while it is written.

        narrow: rows of a few numbers, so that four shuffle partitions make a task's file.
        """
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:6]}"
        schema, seen = df.schema, {}
        if narrow:
            df = df.coalesce(max(12, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4))
        if notes:
            watch = Observation()
            df = df.observe(watch, *(c.alias(k) for k, c in notes.items()))
        df.write.parquet(path)
        if notes:
            seen = watch.get
        return self.spark.read.schema(schema).parquet(path), seen

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing needs any more."""
        for table in tables:
            paths = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
            for path in paths:
                if self.root.split(":", 1)[-1].lstrip("/") not in path:
                    raise ValueError(f"{path} is not a table of this workspace")
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                with contextlib.suppress(Exception):  # a leftover costs space, nothing else
                    where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())), 0).to_numpy()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)
    give_back()


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and `more`) of df, by name; other columns play no part."""
    from pyspark.sql import functions as F

    missing = [c for c in ("doc_id", "text", *more) if c not in df.columns]
    if missing:
        raise ValueError(f"documents lack {missing}")
    modest_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
