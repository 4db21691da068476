"""Token counts by a digest cache: only contents that no earlier run counted are encoded, each once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import bpe
from tierlake.llm.bpe_codec import default_vocabulary
from tierlake.llm.runtime import Workspace, documents, shared_dir, slices

_CACHE = "content string, n_tokens long, tokenizer string"
#: Rows (an id and a digest) that are broadcast to tell the texts to encode from the others; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 200_000


def _sentencepiece(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: np.array([len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)


def _counter(path: str):
    """texts -> token counts, by the file's kind."""
    if path.endswith(".model"):
        return _sentencepiece(path)
    codec = bpe.load(path)
    return lambda texts: np.diff(codec.encode(texts)[1])


def _version(path: str) -> str:
    """The digest of a vocabulary file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content, n_tokens of the counts that a cache holds for a tokenizer; only that tokenizer's folder is read."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], "content string, n_tokens long")
    return spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count(docs: DataFrame, cache: str | None = None, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row.

    The content digest is SHA-256 of the text after its only normalisation that can't change a
    count: null becomes empty. Stored counts at `cache` (a folder of Parquet with a partition for
    each tokenizer that grows by one append a run; a fresh one in the shared folder if none is
    given) are joined by content and tokenizer digest; of the contents without a count one row
    each is encoded, and the new counts are appended before anything is returned. A very long
    text is encoded whole. Repeated rows stay repeated, a null doc_id stays null and is counted
    like others, other columns are ignored, an empty table gives no rows. Two runs that append
    the same content at once do no harm: counts are read distinct.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    version = _version(path)
    space = Workspace(spark, "token-counts")
    cache = cache or f"{shared_dir(spark)}/token-cache-{space.root.rsplit('-', 1)[-1]}"
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs).select("doc_id", text.alias("text")).withColumn("content", F.sha2(F.col("text").cast("binary"), 256))
    keys, total = space.noted(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "keys", rows=F.count(F.lit(1)))
    # one row of each missing content; where it has only null doc_ids, all of those rows stand in, and their equal counts are merged below
    wanted = keys.select("doc_id", "content").join(_stored(spark, cache, version), "content", "left_anti")
    misses, missed = space.noted(wanted.groupBy("content").agg(F.min("doc_id").alias("first")), "misses", narrow=True, rows=F.count(F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counter(batch.column("text")))], ["content", "n_tokens"])

    if missed["rows"]:
        this = lambda side: F.col("doc_id").eqNullSafe(side["first"]) & (F.col("content") == side["miss"])
        some = misses.withColumnRenamed("content", "miss")
        if missed["rows"] > BROADCAST_ROWS >= total["rows"] - missed["rows"]:
            # few rows are copies or counted already: these are left out
            rest = keys.join(some, this(some), "left_anti").select(F.col("doc_id").alias("first"), F.col("content").alias("miss")).distinct()
            todo = rows.join(F.broadcast(rest), this(rest), "left_anti")
        else:
            todo = rows.join(F.broadcast(some) if missed["rows"] <= BROADCAST_ROWS else some, this(some), "left_semi")
        new = todo.select("content", "text").mapInArrow(run, "content string, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # a table of its own, so that the join deals out both sides and the copies of a hot content can be split
    counts = space.keep(_stored(spark, cache, version), "counts", narrow=True)
    return keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: token counts of all documents; a first run fills a cache, and the counts are those that a second run finds there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cache = f"{Workspace(spark, 'token-cache').root}/counts"
    count(docs, cache)
    return count(docs, cache)
