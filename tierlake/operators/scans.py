"""Windows over chains too long for one task: the same results as operators.windows and operators.rangejoin.asof, by segments.

A chain is cut into segments of time at shares of all rows, so that a segment holds about a
`pieces`-th of the busiest chain's rows. Each segment is scanned by itself; what it hands to the next one (its
last rows, a sum, a maximum) is one row, the few such rows of a chain are scanned in turn, and each segment
takes what comes in from there in a second local step. Every exchange is by chain and segment; only the
rows that stand for whole segments meet by chain.

Rows of equal time are in one segment. Short chains need none of this: operators.windows plans fewer steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tierlake.operators import rangejoin

_SEGMENT = "_segment"


def segmented(df: DataFrame, time: str, pieces: int = 64) -> DataFrame:
    """df with _segment, 0 to pieces - 1: how many of pieces - 1 cuts, at equal shares of all rows, its time has reached; 0 for a null time.

    The cuts are a scalar of the plan, approximate by a fraction of a segment.
    """
    if pieces < 1:
        raise ValueError("a chain has one segment at least")
    t = F.col(time).cast("double")
    cuts = df.agg(F.percentile_approx(t, [i / pieces for i in range(1, pieces)], 20 * pieces)).scalar() if pieces > 1 else F.array()
    # binary search: the largest step that stays below the time, again and again
    steps = F.array(*(F.lit(1 << i) for i in range(max(pieces - 1, 1).bit_length() - 1, -1, -1)))
    reached = lambda at, s: F.coalesce(F.get("_cuts", at + s - 1) <= t, F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(reached(at, s), at + s).otherwise(at))
    return df.withColumn("_cuts", cuts).withColumn(_SEGMENT, found).drop("_cuts")


def _local(keys: Sequence[str], order: Sequence) -> WindowSpec:
    return Window.partitionBy(*keys, _SEGMENT).orderBy(*order)


def _earlier(keys: Sequence[str], back: bool = False) -> WindowSpec:
    """The segments of a chain before one (after it, if back), the nearest last."""
    return Window.partitionBy(*keys).orderBy(F.desc(_SEGMENT) if back else F.asc(_SEGMENT))


def _carried(df: DataFrame, keys: Sequence[str], states: Sequence[Column], comes_in: dict[str, Column]) -> DataFrame:
    """df with what comes into each row's segment: comes_in over a table of one row for each segment, which holds the states."""
    small = df.groupBy(*keys, _SEGMENT).agg(*states).select(*keys, _SEGMENT, *(c.alias(n) for n, c in comes_in.items()))
    on = [df[k].eqNullSafe(small[k]) for k in (*keys, _SEGMENT)]
    return df.join(small, on).select(df["*"], *(small[n] for n in comes_in))


def _sums(df: DataFrame, keys: Sequence[str], order: Sequence, flag: str, name: str) -> DataFrame:
    """df with the running sum of a flag along each chain."""
    df = _carried(df, keys, [F.sum(flag).alias("_sum")], {"_before": F.sum("_sum").over(_earlier(keys).rowsBetween(Window.unboundedPreceding, -1))})
    own = F.sum(flag).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_before")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], before: int = 1, after: int = 1, pieces: int = 64) -> DataFrame:
    """As windows.neighbours; order begins with the time."""
    row = F.struct(*columns)
    out, names = segmented(df, order[0], pieces), [*df.columns]
    for step, most, back in (("previous", before, False), ("following", after, True)):
        if not most:
            continue
        way = [F.desc(c) if back else F.asc(c) for c in order]
        local = _local(keys, way)
        place, rows = f"_place_{step}", f"_rows_{step}"
        out = out.withColumn(place, F.row_number().over(local)).withColumns({f"_{step}_{k}": F.lag(row, k).over(local) for k in range(1, most + 1)})
        # a segment's last rows, of which the nearest `most` segments have enough: none is empty
        ends = out.withColumn("_from_end", F.row_number().over(_local(keys, [c.desc() if not back else c.asc() for c in map(F.col, order)]))).where(F.col("_from_end") <= most)
        state = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_from_end"), row.alias("_row")))), lambda x: x["_row"])
        last = ends.groupBy(*keys, _SEGMENT).agg(state.alias("_last"))
        every = out.groupBy(*keys, _SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
        small = every.join(last, [every[k].eqNullSafe(last[k]) for k in (*keys, _SEGMENT)]).select(*(every[k] for k in (*keys, _SEGMENT)), last["_last"])
        small = small.select(*keys, _SEGMENT, F.flatten(F.collect_list("_last").over(_earlier(keys, back).rowsBetween(-most, -1))).alias(rows))
        out = out.join(small, [out[k].eqNullSafe(small[k]) for k in (*keys, _SEGMENT)]).select(out["*"], small[rows])
        # the k-th row before a row at place p of its segment stands k - p from the end of what came in
        incoming = lambda k: F.try_element_at(rows, (F.col(place) - k - 1).cast("int"))  # noqa: B023, E731
        for k in range(1, most + 1):
            found = F.when(F.col(place) > k, F.col(f"_{step}_{k}")).otherwise(incoming(k))
            out = out.withColumn(f"_{step}_{k}", found)
            for c in columns:
                name = f"{step}_{c}" if k == 1 else f"{step}_{k}_{c}"
                out = out.withColumn(name, F.col(f"_{step}_{k}")[c])
                names.append(name)
    return out.select(*names)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, pieces: int = 64) -> DataFrame:
    """As windows.runs: a number that grows where the flag changes within a chain."""
    out = neighbours(df, keys, order, [flag], 1, 0, pieces)
    change = F.when(F.col(flag) != F.coalesce(f"previous_{flag}", ~F.col(flag)), 1).otherwise(0)
    out = segmented(out.withColumn("_change", change), order[0], pieces)
    return _sums(out, keys, order, "_change", "run").select(*df.columns, "run")


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: str, end: str, gap: float, pieces: int = 64) -> DataFrame:
    """As windows.sessions: 1, 2, ... in each chain; a new one starts where a row begins `gap` or more after the latest end before it."""
    out = segmented(df, order[0], pieces)
    out = _carried(out, keys, [F.max(end).alias("_latest")], {"_came": F.max("_latest").over(_earlier(keys).rowsBetween(Window.unboundedPreceding, -1))})
    latest = F.greatest(F.max(end).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1)), "_came")
    new = F.when(latest.isNull() | (F.col(begin) - latest >= gap), 1).otherwise(0)
    return _sums(out.withColumn("_new", new).drop("_came"), keys, order, "_new", "session").select(*df.columns, "session")


def asof(points: DataFrame, marks: DataFrame, keys: Sequence[str], time: str, begin: str, columns: Sequence[str], inner: bool = False, pieces: int = 64) -> DataFrame:
    """As rangejoin.asof: points with `columns` of the last mark of the same keys that begins at or before their time."""
    own, chain = [*points.columns], [f"_k{i}" for i in range(len(keys))]
    keyed = lambda df, *more: df.select(*[F.col(k).alias(n) for k, n in zip(keys, chain)], *more)
    a = keyed(points, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_p"))
    b = keyed(marks, F.col(begin).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_m")).where("_t is not null")
    both = segmented(a.unionByName(b, allowMissingColumns=True), "_t", pieces)
    mark = F.when(F.col("_m").isNotNull(), F.struct("_t", "_m"))
    both = _carried(both, chain, [F.max(mark).alias("_last")], {"_came": F.last("_last", ignorenulls=True).over(_earlier(chain).rowsBetween(Window.unboundedPreceding, -1))})
    local = F.last("_m", ignorenulls=True).over(_local(chain, ["_t", "_side", "_m"]).rowsBetween(Window.unboundedPreceding, 0))
    known = F.col("_t").isNotNull()
    for k in chain:
        known = known & F.col(k).isNotNull()
    both = both.withColumn("_m", F.when(known, F.coalesce(local, F.col("_came._m")))).where("_side = 1")
    if inner:
        both = both.where("_m is not null")
    return both.select(*[F.col("_p")[c].alias(c) for c in own], *[F.col("_m")[c].alias(c) for c in columns])


def within(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, begin: str, end: str, columns: Sequence[str], inner: bool = True, closed: bool = True, pieces: int = 64) -> DataFrame:
    """As rangejoin.within: points with `columns` of the span that holds their time, of several the one that ends last."""
    chain = [f"_k{i}" for i in range(len(keys))]
    both = segmented(rangejoin.sides(points, spans, keys, time, begin, end, columns), "_t", pieces)
    both = _carried(both, chain, [F.max("_m").alias("_last")], {"_came": F.max("_last").over(_earlier(chain).rowsBetween(Window.unboundedPreceding, -1))})
    local = F.max("_m").over(_local(chain, ["_t", "_side"]).rowsBetween(Window.unboundedPreceding, 0))
    return rangejoin.held(both.withColumn("_m", F.greatest(local, "_came")), points.columns, len(keys), columns, inner, closed)
