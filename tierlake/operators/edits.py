"""A log of edits merged into a table: rows set, put and deleted by key, as one aggregate of the log and joins by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.errors import QueryError

#: What an edit may do: change a row that is there, change or add a row, remove a row.
OPS = ("set", "put", "delete")


def latest(edits: DataFrame, key: str = "id", op: str = "op", at: str = "at", cleared: str = "cleared") -> DataFrame:
    """A row for each key of a log: _gone and _put (when it was last deleted and put) and, for each other column, when it was last touched and its value then.

    Everything is a maximum, so a key with most of the edits is combined before it is shuffled.
    """
    if missing := [c for c in (key, op) if c not in edits.columns]:
        raise QueryError(f"edits without {', '.join(missing)}")
    if at not in edits.columns:
        edits = edits.withColumn(at, F.lit(0))
    own = [c for c in edits.columns if c not in (key, op, at, cleared)]
    known = F.when(F.col(op).isin(*OPS), F.col(op)).otherwise(F.raise_error(F.concat(F.lit("no such edit: "), F.coalesce(F.col(op), F.lit("null")))))

    def touched(c: str) -> Column:
        by = F.col(c).isNotNull()
        if cleared in edits.columns:
            by = by | F.coalesce(F.array_contains(cleared, c), F.lit(False))
        return F.max(F.when(by & (F.col("_op") != "delete"), F.struct(F.col(at).alias("at"), F.col(c).isNotNull().alias("some"), F.col(c).alias("value")))).alias(c)

    last = lambda name: F.max(F.when(F.col("_op") == name, F.struct(F.col(at).alias("at"))))
    log = edits.where(F.col(key).isNotNull()).withColumn("_op", known)
    return log.groupBy(key).agg(last("delete").alias("_gone"), last("put").alias("_put"), *(touched(c) for c in own))


def applied(table: DataFrame, edits: DataFrame, key: str = "id", op: str = "op", at: str = "at", cleared: str = "cleared", span: Sequence[str] = ()) -> DataFrame:
    """The table after a log of edits: key, op ("set", "put" or "delete"), at (their order), columns with new values, cleared (names of columns that lose theirs).

    Of a row's edits those after its last delete count, of these the last that touches a column. A row
    is there if it was and was never deleted, or if it was put after its last delete; then it
    holds what was put and set since, nothing of before. A null leaves a column as it is, unless
    `cleared` names it. At equal times a delete comes last, a value beats clearing and the greatest
    value counts; edits without `at` all are of one time. Edits of keys that
    no row has do nothing unless they put; edits without key do nothing; rows without key stay; rows
    that share a key are all changed. Columns that only edits have are added. Where `span` names two
    columns, the lesser of both comes first in rows that were edited. An unknown op is an error.

    The log is aggregated before it meets the table, so the table isn't shuffled while what is left of
    the log fits a broadcast; the rows to add meet the table's keys alone.
    """
    own = [c for c in edits.columns if c not in (key, op, at, cleared)]
    clash = [f"_e_{c}" for c in own]
    log = latest(edits, key, op, at, cleared).select(F.col(key).alias("_key"), "_gone", "_put", *(F.col(c).alias(n) for c, n in zip(own, clash)))
    back = F.col("_put").isNotNull() & (F.col("_gone").isNull() | (F.col("_put") > F.col("_gone")))

    def new(c: str, old: Column) -> Column:
        e = F.col(f"_e_{c}")
        counts = e.isNotNull() & (F.col("_gone").isNull() | (e["at"] > F.col("_gone.at")))
        return F.when(counts, e["value"]).when(F.col("_gone").isNotNull(), None).otherwise(old)

    def row(names: Sequence[str], old) -> list[Column]:
        out = {c: new(c, old(c)) if c in own else old(c) for c in names}
        if span:
            a, b = (out[c] for c in span)
            out |= {c: F.when(F.col("_key").isNotNull() & (a > b), y).otherwise(x) for c, x, y in zip(span, (a, b), (b, a))}
        return [v.alias(c) for c, v in out.items()]

    # of columns that edits don't name a row that was deleted and put again keeps nothing but its key
    kept = lambda c: F.col(c) if c == key else F.when(F.col("_gone").isNull(), F.col(c))
    types = dict(table.dtypes) | {c: k for c, k in edits.dtypes if c in own and c not in table.columns}
    names = [*types]
    wide = table.select("*", *(F.lit(None).cast(types[c]).alias(c) for c in names if c not in table.columns))
    changed = wide.join(log, F.col(key) == F.col("_key"), "left").where(F.col("_gone").isNull() | back).select(*row(names, kept))
    held = table.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    added = log.where(back).join(held, "_key", "left_anti")
    added = added.select(*row(names, lambda c: F.col("_key") if c == key else F.lit(None).cast(types[c])))
    return changed.unionByName(added.select(*(F.col(c).cast(types[c]).alias(c) for c in names)))
