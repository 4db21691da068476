"""Sharding by size-tiered compaction: small immutable shards are appended, similar ones are merged into target-sized files, and manifests make each version visible at once.

A store is a folder with data/<run>/*.parquet and manifest/<version>.json. A manifest lists the
live files with their sizes. A version is committed by renaming a finished manifest to its
number, which fails if that number is taken (on HDFS and local file systems; where rename
replaces its target, as in some object stores, one writer at a time is needed); readers use the
highest number, so they see the files of exactly one version. Files are never changed; those of older versions stay until vacuum().
Compaction neither shuffles nor looks into rows: Spark packs the files of a tier into read
partitions of the target size, and each is written as one file.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm.runtime import Workspace, shared_dir


@dataclass(frozen=True)
class Policy:
    """Bytes of a full shard; files of a tier differ in size by less than `ratio`, and are merged once there are `fan_in` of them."""

    target: int = 128 << 20
    ratio: int = 4
    fan_in: int = 4

    def tier(self, size: int) -> int:
        """0 for full shards (three quarters of the target or more), then 1, 2, ... for ever smaller ones."""
        tier, upper = 0, self.target * 3 // 4
        while size < upper:
            tier, upper = tier + 1, upper // self.ratio
        return tier


class Conflict(RuntimeError):
    """Another writer committed first."""


class ShardStore:
    """A versioned set of Parquet shards in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy = Policy()):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[tuple[str, int]]:
        at = self._path(path)
        return sorted((f"{path}/{s.getPath().getName()}", s.getLen()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The number of the newest manifest, 0 for a new store."""
        return max((int(p.rsplit("/", 1)[1].split(".")[0]) for p, _ in self._list(f"{self.root}/manifest") if p.endswith(".json") and not p.rsplit("/", 1)[1].startswith("_")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "files": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, schema: str, files: dict[str, int]) -> int:
        """Make `files` the version after `base`, or raise Conflict and leave nothing visible."""
        version = base + 1
        final = self._path(f"{self.root}/manifest/{version:012d}.json")
        draft = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "schema": schema, "files": files}, sort_keys=True), "utf-8"))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.root} is taken")
        return version

    def _files(self, run: str) -> dict[str, int]:
        """The shards of a run, by their names within the store."""
        return {p.removeprefix(f"{self.root}/"): size for p, size in self._list(run) if p.endswith(".parquet")}

    def _write(self, df: DataFrame) -> dict[str, int]:
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(run)
        return self._files(run)

    def append(self, arrivals: DataFrame) -> int:
        """Add rows as they come, one small shard for each of their partitions; a table of another schema is refused."""
        now, schema = self.manifest(), json.dumps(arrivals.schema.jsonValue())
        plain = lambda s: [(f["name"], f["type"]) for f in json.loads(s)["fields"]]
        if now["schema"] and plain(now["schema"]) != plain(schema):
            raise ValueError("arrivals have other columns than the store")
        made = self._write(arrivals)
        return self._kept(made, lambda: self.commit(now["version"], now["schema"] or schema, now["files"] | made))

    def append_each(self, rows: DataFrame, arrival: Column, arrivals: int) -> list[int]:
        """Add rows as several arrivals, numbered 0 to arrivals - 1, in one pass over them; a version for each that has rows. Nulls arrive first."""
        now, schema = self.manifest(), json.dumps(rows.schema.jsonValue())
        if now["version"]:
            raise ValueError("several arrivals begin a store")
        name = "_arrival"
        while name in rows.columns:
            name += "_"
        # an open file for each arrival instead of a sort of whole rows
        own = rows.sparkSession.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        rows.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(arrivals))
        try:
            run = f"{self.root}/data/{uuid.uuid4().hex}"
            rows.withColumn(name, F.coalesce(arrival, F.lit(0))).write.partitionBy(name).parquet(run)
        finally:
            rows.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", own)
        versions = []
        for i in range(arrivals):
            if made := self._files(f"{run}/{name}={i}"):
                now = self.manifest()
                versions.append(self.commit(now["version"], now["schema"] or schema, now["files"] | made))
        return versions or [self.commit(0, schema, {})]

    def _kept(self, made: dict[str, int], commit) -> int:
        """commit(), and none of the files made for it if it is refused."""
        try:
            return commit()
        except Conflict:
            for name in made:
                self._fs.delete(self._path(f"{self.root}/{name}"), False)
            raise

    def due(self, files: dict[str, int] | None = None) -> list[int]:
        """Tiers with fan_in files or more, the smallest files first; full shards are never due."""
        tiers: dict[int, int] = {}
        for size in (self.manifest()["files"] if files is None else files).values():
            tiers[self.policy.tier(size)] = tiers.get(self.policy.tier(size), 0) + 1
        return sorted((t for t, n in tiers.items() if t and n >= self.policy.fan_in), reverse=True)

    def compact(self) -> int:
        """Merge every tier that is due, smallest files first, until none is left that gets fewer files by it; returns the version."""
        stuck: set[frozenset] = set()
        while True:
            now = self.manifest()
            for tier in self.due(now["files"]):
                merge = sorted(n for n, size in now["files"].items() if self.policy.tier(size) == tier)
                if frozenset(merge) not in stuck:
                    break
            else:
                return now["version"]
            # a session of its own: packing is a matter of these three settings, and the caller's stay as they are
            own = self.spark.newSession()
            for key, value in (("maxPartitionBytes", self.policy.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
                own.conf.set(f"spark.sql.files.{key}", str(value))
            made = self._write(own.read.schema(self._schema(now)).parquet(*(f"{self.root}/{n}" for n in merge)))
            if len(made) >= len(merge):
                stuck.add(frozenset(merge))
                for name in made:
                    self._fs.delete(self._path(f"{self.root}/{name}"), False)
                continue
            files = {n: s for n, s in now["files"].items() if n not in set(merge)} | made
            self._kept(made, lambda: self.commit(now["version"], now["schema"], files))  # noqa: B023

    @staticmethod
    def _schema(manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the newest by default), each once."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        schema = self._schema(now)
        if not now["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in sorted(now["files"])))

    def vacuum(self) -> int:
        """Delete files that the newest version doesn't list; returns how many. No other writer may be at work."""
        live, gone = set(self.manifest()["files"]), 0
        for run, _ in self._list(f"{self.root}/data"):
            for folder in [run, *(p for p, _ in self._list(run) if "=" in p.rsplit("/", 1)[1])]:
                for path, _ in self._list(folder):
                    if path.endswith(".parquet") and path.removeprefix(f"{self.root}/") not in live:
                        gone += bool(self._fs.delete(self._path(path), False))
        return gone


#: Batches that documents arrive in; twice a policy's fan_in makes some tier due, however small the table.
ARRIVALS = 8


def shard(docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, policy: Policy = Policy()) -> ShardStore:
    """A store of docs: rows arrive in batches of about equal size, dealt by a hash of doc_id, each one version of small shards, and are then compacted.

    The table is read once. Rows are stored as they are: nulls, empty and very long texts, repeated rows and further
    columns included. An empty table gives a store without shards; a batch without rows makes no version.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:12]}", policy)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int"), arrivals)
    store.compact()
    store.vacuum()
    return store


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents as the compacted store holds them, with a digest of each text; whether a row's file fits the target (and a tenth) and is listed with its true size, whether no tier is due any more, whether compaction made versions after those of the arrivals and left fewer files than had arrived."""
    store = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{Workspace(spark, 'shards').root}/store")
    files, steps = store.manifest()["files"], [store.manifest(v)["files"] for v in range(1, store.version() + 1)]
    # an arrival only adds files, a merge takes some away
    merges = sum(not set(a) <= set(b) for a, b in zip(steps, steps[1:]))
    fewer = len(files) < max(len(step) for step in steps)
    # a row for each file: as many as the store has shards
    sizes = spark.createDataFrame([(n.rsplit("/", 1)[1], s) for n, s in files.items()], "_file string, _size long")
    # texts end here: what is joined are digests
    rows = store.read().select(
        "doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_size").alias("_bytes"),
    )
    return rows.join(sizes, "_file", "left").select(
        "doc_id", "lang", "source", "n_bytes", "text_sha256",
        (F.col("_bytes") <= int(store.policy.target * 1.1)).alias("fits"), F.col("_bytes").eqNullSafe(F.col("_size")).alias("listed"), F.lit(not store.due(files)).alias("settled"), F.lit(merges > 0 and fewer).alias("compacted"),
    )


ORACLE_SQL = "SELECT doc_id, lang, source, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256, true AS fits, true AS listed, true AS settled, true AS compacted FROM documents"
