"""Exact duplicates by a tree of merges of sorted digest runs.

Every read partition sorts its rows by digest and folds equal ones into one entry: a run. In each
round FAN_IN neighbouring runs are merged into one, digest segment by digest segment, so that a
text meets at most FAN_IN of its own entries at once, however many copies it has, and no task
ever holds more than a segment of a few runs. After about log(partitions) rounds each segment
is one run, whose entries carry the identifier that stays and the size of the group. Decisions go
back by (run, digest), so copies are dealt out over the runs that they came from.

An entry's identity is the SHA-256 of the text together with its length and a second, independent
64-bit hash; all three are compared at every level, so a collision of one of them merges nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.llm.runtime import Workspace, documents

#: Runs merged into one in a round.
FAN_IN = 8
#: Segments of a run for each shuffle partition, so that hashing deals them out evenly.
SEGMENTS_A_PARTITION = 32

_IDENTITY = ["digest", "check", "n_bytes"]


def _order(keep: str) -> list[Column]:
    """What comes first within a group: the identifier that stays; a null one only if there is no other; of rows with the same id the last read."""
    if keep == "largest":
        return [F.desc_nulls_last("keep_id"), F.desc("keep_row")]
    if keep == "smallest":
        return [F.asc_nulls_last("keep_id"), F.desc("keep_row")]
    raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")


def _best(keep: str) -> Column:
    """The same choice as an aggregate of entries."""
    entry = F.struct("keep_id", "keep_row")
    if keep == "largest":
        return F.max(entry)  # a null id is less than any
    return F.min_by(entry, F.struct(F.col("keep_id").isNull(), "keep_id", -F.col("keep_row")))


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Whether a row of the batch differs from the one before it in run or identity."""
    digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(batch.num_rows, 4)
    rest = np.stack([batch.column(c).to_numpy() for c in ("run", "check", "n_bytes")], 1)
    new = np.ones(batch.num_rows, bool)
    new[1:] = (digests[1:] != digests[:-1]).any(1) | (rest[1:] != rest[:-1]).any(1)
    return new


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run and identity, the one that stays first, as one entry for each; only the last entry waits for the next batch."""
    waiting: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([waiting.column(c), batch.column(c)]) for c in batch.schema.names], batch.schema.names)
        first = np.flatnonzero(_starts(batch))
        counts = np.add.reduceat(batch.column("n").to_numpy(), first)
        columns = [pa.array(counts, pa.int64()) if c == "n" else batch.column(c).take(pa.array(first)) for c in batch.schema.names]
        out = pa.RecordBatch.from_arrays(columns, batch.schema.names)
        yield out.slice(0, out.num_rows - 1)
        waiting = out.slice(out.num_rows - 1)
    if waiting is not None:
        yield waiting


def _digests(docs: DataFrame, space: Workspace) -> DataFrame:
    """One narrow row for each document: row (a number of its own), run (its read partition), doc_id and the identity of its text."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("row", "doc_id", text.alias("text")).select(
        "row", F.spark_partition_id().cast("long").alias("run"), "doc_id",
        F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text", F.lit("second")).alias("check"), F.octet_length("text").cast("long").alias("n_bytes"),
    )
    return space.keep(rows, "rows")


def _local_runs(rows: DataFrame, keep: str) -> DataFrame:
    """Sorted runs of the entries of each read partition; no shuffle."""
    entries = rows.select("run", *_IDENTITY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"))
    kinds = "run long, digest binary, check long, n_bytes long, keep_id long, keep_row long, n long"
    return entries.sortWithinPartitions("run", *_IDENTITY, *_order(keep)).mapInArrow(_fold, kinds)


def _merged(runs: DataFrame, fan_in: int, segments: int, keep: str) -> DataFrame:
    """A round: each segment of fan_in neighbouring runs in one task, sorted, equal entries folded.

    The aggregate asks for the distribution and order that the two lines before it made, so the
    plan has one exchange and one sort, which spills if it must.
    """
    dealt = runs.withColumn("run", F.floor(F.col("run") / fan_in)).withColumn("segment", F.pmod("check", F.lit(segments)))
    dealt = dealt.repartition("segment", "run").sortWithinPartitions("segment", "run", *_IDENTITY)
    best = dealt.groupBy("segment", "run", *_IDENTITY).agg(_best(keep).alias("best"), F.sum("n").alias("n"))
    return best.select("run", *_IDENTITY, "best.keep_id", "best.keep_row", "n")


def groups(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """Each document with its group of identical texts: doc_id, keep_id, group_size, kept, text_sha256 and n_bytes.

    keep_id is the 'largest' or 'smallest' doc_id of the group, whose row is kept; a row without
    doc_id stays only if no row of its group has one (keep_id is null then), and of rows that
    share that doc_id too one is kept. A null text counts as empty, and empty texts are one group like any
    other. Texts are compared whole, as bytes, however long. An empty table gives no rows; further
    columns of docs, whatever their names, play no part.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    return _decided(documents(docs).withColumn("row", F.monotonically_increasing_id()), space, keep, fan_in).drop("row")


def deduplicated(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that stay, with all their columns; what is null, empty or repeated counts as in groups()."""
    space, row = Workspace(docs.sparkSession, "exact-dedup"), "_row"
    while row in docs.columns:
        row += "_"
    docs = space.keep(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    stay = _decided(documents(docs, row).withColumnRenamed(row, "row"), space, keep, fan_in).where("kept").select(F.col("row").alias(row))
    return docs.join(stay, row, "left_semi").drop(row)


def _decided(docs: DataFrame, space: Workspace, keep: str, fan_in: int) -> DataFrame:
    """What groups() returns and row, which numbers docs."""
    if fan_in < 2:
        raise ValueError("a round merges two runs at least")
    _order(keep)
    spark = docs.sparkSession
    rows = _digests(docs, space)
    segments = SEGMENTS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs, seen = space.noted(_local_runs(rows, keep), "runs", last=F.max("run"))
    merged, last = runs, seen["last"] or 0
    while True:  # one round at least, as several tasks may have read a run
        before, merged = merged, space.keep(_merged(merged, fan_in, segments, keep), "merged")
        if before is not runs:
            space.drop(before)
        last //= fan_in
        if not last:
            break
    repeated = merged.where("n > 1").select(*_IDENTITY, "keep_id", "keep_row", F.col("n").alias("group_size"))
    # a text has few entries for each run, and a run its own rows only: no key of these joins is hot
    back = space.keep(runs.select("run", *_IDENTITY).join(repeated, _IDENTITY).distinct(), "back", narrow=True)
    alone = F.col("group_size").isNull()
    return rows.join(back, ["run", *_IDENTITY], "left").select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every document with its group of identical texts, of which the row with the largest doc_id stays."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


ORACLE_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256, strlen(text)::BIGINT AS n_bytes FROM t"""
