"""The labelled sample that classifiers learn from, and the split that holds rows out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.llm.runtime import documents

#: Most labelled rows that a model is fitted on. The sample is gathered on the driver.
SAMPLE_ROWS = 6000
#: Labels that are looked at for each row of the sample, as some may have no document.
CANDIDATES = 4
#: Most bytes of features that the sample gathers, for each of its rows.
ROW_BYTES = 16_000


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row may not be learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, y of at most `rows` labelled rows that aren't held out, picked by a hash of the id.

    Labels that are null, or whose id is null or has no document, teach nothing; rows of one id
    with the same text count once. Where ids repeat with other texts, the rows by a hash of id
    and text that come first are taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    order = [F.xxhash64("doc_id", F.lit(5)), "doc_id", "y"]
    # labels without a document are left out before the sample is drawn; CANDIDATES * rows labels at most are looked at, whatever the input
    known = known.distinct().orderBy(*order).limit(CANDIDATES * rows)
    known = documents(docs).select("doc_id").join(F.broadcast(known), "doc_id").distinct().orderBy(*order).limit(rows)
    found = documents(docs).join(F.broadcast(known), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    digest = F.xxhash64("text")
    return found.groupBy("doc_id", "y", digest.alias("_d")).agg(F.any_value("text").alias("text")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "y", "_d").limit(rows).select("doc_id", "text", "y")


def gathered(examples: DataFrame, features: str, rows: int) -> pa.Table:
    """The sample's examples on the driver: at most rows * ROW_BYTES bytes of features, in the sample's order; an example that is larger by itself is left out, and it is an error if all are."""
    most = rows * ROW_BYTES
    size = F.octet_length(features)
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "y", features)
    # `rows` rows at most are in this window; a row that alone is too large doesn't push the others out
    kept = examples.where(size <= most).withColumn("_upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = kept.where(F.col("_upto") <= most).drop("_upto").toArrow()
    if not found.num_rows and examples.limit(1).count():
        raise ValueError(f"every labelled example has more than {most} bytes of features")
    return found
