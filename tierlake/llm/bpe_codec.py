"""BPE encoding and decoding of whole texts (see bpe.py for the method)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm import bpe
from tierlake.llm.runtime import documents, slices


def default_vocabulary() -> str:
    """The 50k byte-level vocabulary of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = True) -> DataFrame:
    """Tokens of each whole text, and the text that they decode to.

    Columns: doc_id, ids (binary: the ids as little-endian unsigned 32-bit integers), n_tokens,
    and decoded if asked for. A null text counts as empty and has no tokens; repeated rows stay
    repeated; a null doc_id stays null; other columns are ignored. A very long text is encoded
    whole, alone in its slice. `vocabulary` must be readable at the same path on every executor.
    """
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, ids binary, n_tokens long" + (", decoded string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(path)
        for batch in slices(batches):  # the pieces met are remembered for a task
            ids, bounds = codec.encode(batch.column("text"))
            ids = ids.astype("<u4")
            columns = [
                batch.column("doc_id"),
                pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids)]).cast(pa.binary()),
                pa.array(np.diff(bounds)),
            ]
            if decoded:
                columns.append(pa.array([codec.decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "decoded"][: len(columns)])
        codec.forget()

    return documents(docs).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: per document the token count and digests of the ids and of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
