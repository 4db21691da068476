"""As-of and interval joins without a cartesian step: both sides are dealt by the equality keys and merged by time in one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins are 2 ** this wide at least (of the unit of time), so that their numbers stay exact.
_FINEST = -20

#: Chains of more points than this are no window's business in containing().
BUSY = 1_000_000


def asof(points: DataFrame, marks: DataFrame, keys: Sequence[str], time: str, begin: str, columns: Sequence[str], inner: bool = False) -> DataFrame:
    """points with `columns` of the last mark of the same keys that begins at or before the point's time.

    Marks of equal keys and begin should be unique; otherwise the greatest of them (by columns)
    counts. Points before the first mark get nulls, or are dropped if inner. A null key or time
    finds nothing.
    """
    own = [c for c in points.columns]
    a = points.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_p"), F.lit(None).cast(marks.select(F.struct(*columns)).schema[0].dataType).alias("_m"))
    b = marks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(begin).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), F.struct(*columns).alias("_m")).where("_t is not null")
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side", "_m").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("_t").isNotNull()
    for i in range(len(keys)):
        known = known & F.col(f"_k{i}").isNotNull()
    both = a.unionByName(b).withColumn("_m", F.when(known, F.last("_m", ignorenulls=True).over(w))).where("_side = 1")
    if inner:
        both = both.where("_m is not null")
    return both.select(*[F.col("_p")[c].alias(c) for c in own], *[F.col("_m")[c].alias(c) for c in columns])


def sides(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, begin: str, end: str, columns: Sequence[str]) -> DataFrame:
    """Points (_side 1, _p) and begins of spans (_side 0, _m) under one another: _k0, ..., _t. The greatest _m is the span that ends last."""
    keyed = lambda df, *more: df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *more)
    span = F.struct(F.col(end).cast("double").alias("_end"), F.col(begin).cast("double").alias("_begin"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(dict.fromkeys(columns))))
    b = keyed(spans.where(F.col(begin).isNotNull() & F.col(end).isNotNull()), F.col(begin).cast("double").alias("_t"), F.lit(0).alias("_side"), span.alias("_m"))
    a = keyed(points, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_p"))
    return b.unionByName(a, allowMissingColumns=True)


def held(both: DataFrame, own: Sequence[str], n_keys: int, columns: Sequence[str], inner: bool, closed: bool) -> DataFrame:
    """The points of sides(), with columns of _m where that span holds their time."""
    names, known = [*dict.fromkeys(columns)], F.col("_t").isNotNull()
    for i in range(n_keys):
        known = known & F.col(f"_k{i}").isNotNull()
    ok = F.coalesce(known & (F.col("_t") <= F.col("_m._end") if closed else F.col("_t") < F.col("_m._end")), F.lit(False))
    both = both.where("_side = 1")
    both = both.where(ok) if inner else both
    # own columns that the span's replace are dropped, as in a join that overwrites
    kept = [c for c in own if c not in names]
    return both.select(*[F.col("_p")[c].alias(c) for c in kept], *[F.when(ok, F.col("_m")[f"_c{names.index(c)}"]).alias(c) for c in columns])


def within(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, begin: str, end: str, columns: Sequence[str], inner: bool = True, closed: bool = True) -> DataFrame:
    """points with `columns` of one span of the same keys that contains their time (end included if closed).

    Of several such spans the one that ends last counts, of those the one that begins last, then the
    greatest by columns; so a point on a border that two spans share belongs to the later one. Spans without
    begin or end contain nothing. containing() gives all spans of a point.
    """
    both = sides(points, spans, keys, time, begin, end, columns)
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    # of all spans begun so far, the one that ends last holds the time if any does
    return held(both.withColumn("_m", F.max("_m").over(w)), points.columns, len(keys), columns, inner, closed)


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, begin: str, end: str, columns: Sequence[str], closed: bool = True, pieces: int = 32, busy: int = BUSY) -> DataFrame:
    """points with `columns` of every span of the same keys that contains their time (end included if closed): a row for each pair.

    Spans may overlap in any way. Those that lie apart (see apart()) meet their points in one window by keys, without a
    copy of either; the others, and all of chains with more than `busy` points, are dealt into bins (see binned()). A null key, time,
    begin or end finds nothing, and a span that ends before it begins contains nothing.
    """
    own, names = [*points.columns], [*dict.fromkeys(columns)]
    chain = [f"_k{i}" for i in range(len(keys))]
    keyed = lambda df, *more: df.select(*[F.col(k).alias(n) for k, n in zip(keys, chain)], *more).dropna(subset=chain)
    if not chain:
        raise ValueError("spans hold points of the same keys, one at least")
    b = keyed(spans, F.col(begin).cast("double").alias("_b"), F.col(end).cast("double").alias("_e"), F.struct(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(names))).alias("_m")).where("_b <= _e")
    a = keyed(points, F.col(time).cast("double").alias("_t"), F.struct(*own).alias("_p")).where("_t is not null")
    loud = a.groupBy(*chain).count().where(F.col("count") > busy).select(*chain, F.lit(True).alias("_loud"))
    b = apart(b.join(loud, chain, "left"), chain)
    # free spans and points under one another: a point sees the last free span begun so far and the one before it, which it holds only on a border
    free = b.where("_free").select(*chain, F.col("_b").alias("_t"), F.lit(0).alias("_side"), F.struct("_b", "_e", "_m").alias("_s"), F.col("_touched").alias("_q"))
    both = free.unionByName(a.join(loud, chain, "left_anti").withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*chain).orderBy("_t", "_side", F.col("_s._e")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_s", "_q")), ignorenulls=True).over(order)
    inside = lambda t, s: (t >= s["_b"]) & ((t <= s["_e"]) if closed else (t < s["_e"]))
    seen = both.withColumn("_l", last).where("_side = 1 and _l is not null").withColumn("_s", F.explode(F.array("_l._s", "_l._q")))
    near = seen.where(F.col("_s").isNotNull() & inside(F.col("_t"), F.col("_s"))).select("_p", F.col("_s._m").alias("_m"))
    met = near.unionByName(binned(a, b.where("not _free"), chain, closed, pieces))
    kept = [c for c in own if c not in names]
    return met.select(*[F.col("_p")[c].alias(c) for c in kept], *[F.col("_m")[f"_c{names.index(c)}"].alias(c) for c in columns])


def apart(spans: DataFrame, chain: Sequence[str]) -> DataFrame:
    """Spans (chain, _b, _e, _m, _loud) with _free and, for free ones, _touched: the free span before it, if that ends where it begins.

    A span is free if it begins after all spans before it of its chain have ended, or just then and lasts, so
    that a time is held by two free spans at most. None is free where _loud is true.
    """
    upto = Window.partitionBy(*chain).orderBy("_b", "_e", "_m").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max("_e").over(upto)
    alone = ended.isNull() | (F.col("_b") > ended) | ((F.col("_b") == ended) & (F.col("_e") > F.col("_b")))
    found = spans.withColumns({"_free": F.col("_loud").isNull() & alone, "_s": F.struct("_b", "_e", "_m")})
    before = F.last(F.when(F.col("_free"), F.col("_s")), ignorenulls=True).over(upto)
    return found.withColumn("_before", before).withColumn("_touched", F.when(F.col("_before._e") == F.col("_b"), F.col("_before"))).drop("_s", "_before")


def binned(a: DataFrame, b: DataFrame, chain: Sequence[str], closed: bool, pieces: int) -> DataFrame:
    """_p and _m of points (chain, _t, _p) and the spans (chain, _b, _e, _m) that contain them, by bins.

    Time is cut into bins at several widths, powers of four: a span goes
    to the width that cuts it into `pieces` bins at most, a copy into each of them, and a point into its bin of each
    width that a span uses. Both meet by equality of keys, width and bin, and the time itself is tested then. So
    neither a long span nor one chain that holds most points makes one bin hot: the points that
    meet a span come in a quarter of `pieces` groups at least.
    """
    length = F.col("_e") - F.col("_b")
    width = F.when(length > 0, 2 * F.ceil(F.log2(length / pieces) / 2)).otherwise(0).cast("int")  # _w; a bin is 2 ** _w wide
    b = b.select(*chain, "_b", "_e", "_m", F.greatest(width, F.lit(_FINEST)).alias("_w"))
    place = lambda t: F.floor(F.col(t) / F.pow(F.lit(2.0), F.col("_w")))
    widths = b.agg(F.collect_set("_w")).scalar()  # a few whole numbers: logarithms of lengths
    a = a.withColumn("_w", F.explode(widths)).withColumn("_bin", place("_t"))
    b = b.withColumn("_bin", F.explode(F.sequence(place("_b"), place("_e"))))
    inside = (F.col("_t") >= F.col("_b")) & ((F.col("_t") <= F.col("_e")) if closed else (F.col("_t") < F.col("_e")))
    # the copies aren't in Spark's guess of a side's size: neither is to be sent to the driver
    return a.join(b.hint("merge"), [*chain, "_w", "_bin"]).where(inside).select("_p", "_m")
