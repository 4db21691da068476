"""Time series beside the tokens: labelling, slices, statistics, buckets, interpolation and relative values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.operators.measures import statistic
from tierlake.operators.rangejoin import asof, containing


def label_points(track: DataFrame, tokens: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str = "time", begin: str = "begin") -> DataFrame:
    """Points with columns of the last token that begins at or before them; points before the first are dropped."""
    return asof(track, tokens, keys, time, begin, columns, inner=True)


def slices(track: DataFrame, tokens: DataFrame, keys: Sequence[str], token_id: str = "id", time: str = "time", begin: str = "begin", end: str = "end") -> DataFrame:
    """The points of each token, both ends included; a point that several tokens hold has a row for each."""
    return containing(track, tokens, keys, time, begin, end, [token_id])


def token_statistics(track: DataFrame, tokens: DataFrame, keys: Sequence[str], measure: str, token_id: str = "id", **columns: str) -> DataFrame:
    """min, max, mean, median and stdev of a measure over each token's points; nulls for tokens without points."""
    points = slices(track, tokens, keys, token_id, **columns)
    stats = points.groupBy(token_id).agg(*(statistic(s, measure).alias(f"{s}_{measure}") for s in ("min", "max", "mean", "median", "stdev")))
    return tokens.select(token_id).join(stats, token_id, "left")


def collected(track: DataFrame, token_id: str, measures: Sequence[str], time: str = "time", tokens: DataFrame | None = None) -> DataFrame:
    """One row for each token with its points in order of time; with the tokens' begin and end also each point's relative_time (0 at the begin, 1 at the end)."""
    points = F.array_sort(F.collect_list(F.struct(time, *measures)))
    found = track.groupBy(token_id).agg(points.alias("track"))
    if tokens is None:
        return found
    found = found.join(tokens.select(token_id, F.col("begin").cast("double").alias("_b"), F.col("end").cast("double").alias("_e")), token_id)
    relative = lambda p: F.try_divide(p[time].cast("double") - F.col("_b"), F.col("_e") - F.col("_b"))
    return found.select(token_id, F.transform("track", lambda p: F.struct(*(p[c].alias(c) for c in (time, *measures)), relative(p).alias("relative_time"))).alias("track"))


def relativise(track: DataFrame, measure: str, by: Sequence[str]) -> DataFrame:
    """Adds <measure>_relativized: the z-score within the groups of `by` (sample deviation); null where that is null or zero."""
    stats = track.groupBy(*by).agg(F.avg(measure).alias("_mean"), F.stddev_samp(measure).alias("_sd"))
    z = (F.col(measure) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return track.join(stats, [*by], "left").withColumn(f"{measure}_relativized", z).drop("_mean", "_sd")


def buckets(track: DataFrame, tokens: DataFrame, keys: Sequence[str], measure: str, points: int, token_id: str = "id", time: str = "time", begin: str = "begin", end: str = "end") -> DataFrame:
    """The mean of a measure in `points` equal buckets of each token's time; empty buckets are null. Columns: id, bucket (from 0), mean."""
    inside = containing(track, tokens, keys, time, begin, end, [token_id, begin, end])
    width = (F.col(end).cast("double") - F.col(begin).cast("double")) / points
    at = F.when(width > 0, F.least(F.floor((F.col(time).cast("double") - F.col(begin).cast("double")) / width), F.lit(points - 1))).otherwise(0).cast("int")
    means = inside.groupBy(token_id, at.alias("bucket")).agg(F.avg(measure).alias("mean"))
    every = tokens.select(token_id, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("bucket"))
    return every.join(means, [token_id, "bucket"], "left")


def speaker_range(track: DataFrame, measure: str, by: Sequence[str], octaves: float = 1.0, floor: float = 55, ceiling: float = 2000) -> DataFrame:
    """The range of a second pass: mean / 2**octaves to mean * 2**octaves in whole numbers, within floor and ceiling.

    The mean counts to nine places, so that the order in which values are added doesn't decide on which side of a whole number it is.
    """
    mean = F.round(F.avg(measure), 9)
    return track.groupBy(*by).agg(F.greatest(F.floor(mean / 2**octaves), F.lit(floor)).cast("int").alias("least"), F.least(F.floor(mean * 2**octaves), F.lit(ceiling)).cast("int").alias("most"))


def interpolated(track: DataFrame, tokens: DataFrame, keys: Sequence[str], measure: str, points: int = 10, padding: float = 0.01, hole: float = 0.015, token_id: str = "id", time: str = "time", begin: str = "begin", end: str = "end") -> DataFrame:
    """`points` equally spaced values of each token by linear interpolation: id, place (from 0), time, value.

    Points of at most `padding` outside the token help at its ends; a stretch longer than `hole`
    without points is undefined, as are times outside all points; values of 0 or less are ignored,
    and points at one time count as their mean. Tokens without points give no rows.
    """
    a, b = (F.col(c).cast("double") for c in (begin, end))
    wide = tokens.select(*keys, F.col(token_id), a.alias("_a"), b.alias("_b"), (a - padding).alias("_from"), (b + padding).alias("_to"))
    heard = track.select(*keys, F.col(time).cast("double").alias("_t"), F.col(measure).cast("double").alias("_v")).where("_v > 0")
    near = containing(heard, wide, keys, "_t", "_from", "_to", [token_id, "_a", "_b"])
    near = near.groupBy(token_id, "_a", "_b", "_t").agg(F.avg("_v").alias("_v"))
    # the places asked for stand among the points of their token; each looks for the last point before and the first after it
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("place"), F.when(k == points - 1, F.col("_b")).otherwise(F.col("_a") + k * ((F.col("_b") - F.col("_a")) / max(points - 1, 1))).alias("time")))
    asked = near.select(token_id, "_a", "_b").distinct().select(token_id, F.explode(places).alias("_p")).select(token_id, "_p.place", F.col("_p.time").alias("_t"), F.lit(None).cast("struct<t:double,v:double>").alias("_point"))
    both = asked.unionByName(near.select(token_id, F.lit(None).cast("int").alias("place"), "_t", F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")).alias("_point")))
    upto, on = (Window.partitionBy(token_id).orderBy("_t").rangeBetween(*r) for r in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    both = both.withColumns({"_l": F.last("_point", ignorenulls=True).over(upto), "_r": F.first("_point", ignorenulls=True).over(on)}).where("place is not null")
    line = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col("_t") - F.col("_l.t")) / (F.col("_r.t") - F.col("_l.t"))
    value = F.when(F.col("_r.t") - F.col("_l.t") > hole, None).when(F.col("_r.t") == F.col("_l.t"), F.col("_l.v")).otherwise(line)
    return both.select(token_id, "place", F.col("_t").alias("time"), value.alias("value"))


def replace_range(track: DataFrame, edited: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """The track with the points between the first and last edited time of each key replaced by the edited ones."""
    span = edited.groupBy(*keys).agg(F.min(time).alias("_from"), F.max(time).alias("_to"))
    kept = track.join(span, [*keys], "left").where(F.col("_from").isNull() | (F.col(time) < F.col("_from")) | (F.col(time) > F.col("_to"))).drop("_from", "_to")
    return kept.unionByName(edited, allowMissingColumns=True)


def analyse(segments: DataFrame, function, schema: str) -> DataFrame:
    """A user's analysis: function(pandas frame of segments) -> pandas frame, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return segments.mapInPandas(run, schema)


def segments(tokens: DataFrame, subset: Column | None = None, shortest: float = 0.0, file_end: str | None = None) -> DataFrame:
    """The tokens to analyse: of a subset, longer than `shortest`, not of zero length, ends bounded by the file's."""
    out = tokens if subset is None else tokens.where(subset)
    if file_end:
        out = out.withColumn("end", F.least("end", file_end))
    return out.where((F.col("end") - F.col("begin") > 0) & (F.col("end") - F.col("begin") >= shortest))
