"""The time windows of batch queries on streams: buckets and gap-based utterances, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_means(stream: DataFrame, measure: str, width: str, late: str, by: str, time: str = "ts", slide: str | None = None) -> DataFrame:
    """by, begin, end, mean, n of a measure in tumbling (or sliding) windows; rows later than `late` are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    found = stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.avg(measure).alias("mean"), F.count("*").alias("n"))
    return found.select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "mean", "n")


def utterances(stream: DataFrame, gap: str, late: str, by: str, time: str = "ts") -> DataFrame:
    """by, begin, last, n of stretches without a gap of `gap` or more; the session's end is the gap after its last row."""
    found = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return found.select(by, F.col("w.start").alias("begin"), "last", "n")
