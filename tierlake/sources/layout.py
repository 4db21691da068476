"""Tables of tokens or points laid out by chain: bucketed by the keys of a chain, sorted by time, in folders of stretches of time.

Windows over chains, joins of two such tables by chain and aggregates by chain then need no
exchange, as each bucket holds whole chains; a range of time reads the folders that it touches only.
The layout is Spark's own (partitionBy, bucketBy, sortBy), described in a file beside the data, so that any session can open it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.errors import QueryError

_SLAB, _FILE = "slab", "_layout.json"


@dataclass(frozen=True)
class Arranged:
    """A table laid out by chain."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    time: str
    buckets: int
    width: float

    @property
    def name(self) -> str:
        return f"arranged_{sha256(self.path.encode()).hexdigest()[:24]}"

    def frame(self) -> DataFrame:
        return self.spark.table(self.name).drop(_SLAB)

    def between(self, begin: float, end: float) -> DataFrame:
        """The rows whose time is in a range, both ends included; only folders of that range are read."""
        table, time = self.spark.table(self.name), F.col(self.time)
        low, high = (int(t // self.width) for t in (begin, end))
        return table.where(F.col(_SLAB).between(low, high) & time.between(begin, end)).drop(_SLAB)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Arranged:
        """A table that arrange() wrote, in this session's catalog."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_FILE}")
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
        try:
            told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        out = cls(spark, path, tuple(told["keys"]), told["time"], told["buckets"], told["width"])
        if not spark.catalog.tableExists(out.name):
            quoted = ", ".join(f"`{k}`" for k in out.keys)
            spark.sql(
                f"CREATE TABLE {out.name} ({told['columns']}, {_SLAB} BIGINT) USING parquet PARTITIONED BY ({_SLAB}) "
                f"CLUSTERED BY ({quoted}) SORTED BY (`{out.time}`) INTO {out.buckets} BUCKETS LOCATION '{path}'"
            )
            spark.catalog.recoverPartitions(out.name)
        return out


def arrange(df: DataFrame, path: str, keys: Sequence[str], time: str, buckets: int | None = None, width: float = 3600.0) -> Arranged:
    """Write df laid out by chain under a new path. buckets: as many as the session has shuffle partitions, unless given; tables that are joined by chain need the same number. width: of a folder's stretch of time; a null time has a folder of its own.

    The one exchange that this needs deals rows as the buckets do, so that a task writes a file for each stretch.
    """
    spark = df.sparkSession
    if _SLAB in df.columns:
        raise QueryError(f"a column {_SLAB} is in the way")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = Arranged(spark, path, tuple(keys), time, buckets, width)
    dealt = df.withColumn(_SLAB, F.floor(F.col(time).cast("double") / width)).repartition(buckets, *keys)
    dealt.write.partitionBy(_SLAB).bucketBy(buckets, *keys).sortBy(time).option("path", path).format("parquet").saveAsTable(out.name)
    columns = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_FILE}")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    stream.write(bytearray(json.dumps({"keys": list(keys), "time": time, "buckets": buckets, "width": width, "columns": columns}), "utf-8"))
    stream.close()
    return out
