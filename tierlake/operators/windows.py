"""Chains of tokens as windows: neighbours, positions, alignment, pause runs and sessions.

Every function takes the columns that separate chains (`keys`) and the columns that order one
(`order`, unique within a chain), and plans one exchange on the keys that later steps reuse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def chain(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], before: int = 1, after: int = 1) -> DataFrame:
    """previous_<c>, previous_2_<c>, ..., following_<c>, ... for each column; null beyond the chain's ends."""
    w = chain(keys, order)
    new = {}
    for step, most, shift in (("previous", before, F.lag), ("following", after, F.lead)):
        for k in range(1, most + 1):
            for c in columns:
                new[f"{step}_{c}" if k == 1 else f"{step}_{k}_{c}"] = shift(c, k).over(w)
    return df.withColumns(new)


def position(container: Sequence[str], begin: str, flag: Column | None = None) -> Column:
    """1 + the number of members of the container (of those with the flag) that begin earlier."""
    if flag is None:
        return F.rank().over(Window.partitionBy(*container).orderBy(begin))
    hit = F.when(flag, 1).otherwise(0)
    upto = F.sum(hit).over(Window.partitionBy(*container).orderBy(begin).rangeBetween(Window.unboundedPreceding, 0))
    return upto - F.sum(hit).over(Window.partitionBy(*container, begin)) + 1


def aligned(df: DataFrame, container: Sequence[str], order: Sequence[str], side: str = "left", negate: bool = False) -> DataFrame:
    """Rows that are the first (left) or last (right) of their container, or all others."""
    keys = [F.asc(c) if side == "left" else F.desc(c) for c in order]
    first = F.row_number().over(Window.partitionBy(*container).orderBy(*keys)) == 1
    return df.withColumn("_first", first).where(~F.col("_first") if negate else F.col("_first")).drop("_first")


def next_to(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, side: str = "after") -> Column:
    """Whether the row stands right after (before) a flagged row of its chain; false at the chain's end."""
    shift = F.lag if side == "after" else F.lead
    return F.coalesce(shift(F.col(flag)).over(chain(keys, order)), F.lit(False))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Adds run: a number that grows where the flag changes within a chain (gaps and islands)."""
    w = chain(keys, order)
    change = F.when(F.col(flag) != F.coalesce(F.lag(flag).over(w), ~F.col(flag)), 1).otherwise(0)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def flagged_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, begin: str, end: str, label: str, numbered: DataFrame | None = None) -> DataFrame:
    """One row for each run of flagged rows: keys, run, run_begin, run_end, run_duration, size, labels in order. numbered: df with its runs, where they are known."""
    marked = (runs(df, keys, order, flag) if numbered is None else numbered).where(flag)
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(label).alias("_l"))))
    found = marked.groupBy(*keys, "run").agg(F.min(begin).alias("run_begin"), F.max(end).alias("run_end"), F.count("*").alias("size"), F.transform(items, lambda x: x["_l"]).alias("labels"))
    return found.withColumn("run_duration", F.col("run_end") - F.col("run_begin"))


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: str, end: str, gap: float) -> DataFrame:
    """Adds session: 1, 2, ... in each chain; a new one starts where a row begins `gap` or more after the latest end before it."""
    w = chain(keys, order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(begin) - before >= gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")
