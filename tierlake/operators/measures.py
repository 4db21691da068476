"""Statistics of a numeric property by type and speaker, baselines and relative values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.operators.enrich import equal_join


def percentile_disc(column: str, share: float) -> Column:
    """The smallest value whose cumulative share reaches `share`."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{column}`)")


def statistic(name: str, column: str) -> Column:
    """An aggregate by name: mean, stdev, median (interpolated), median_disc, sum, count, min, max, iqr_disc, mode (the smallest of equals)."""
    return {
        "mean": lambda: F.avg(column),
        "stdev": lambda: F.stddev_samp(column),
        "median": lambda: F.median(column),
        "median_disc": lambda: percentile_disc(column, 0.5),
        "iqr_disc": lambda: percentile_disc(column, 0.75) - percentile_disc(column, 0.25),
        "sum": lambda: F.sum(column),
        "count": lambda: F.count(column),
        "min": lambda: F.min(column),
        "max": lambda: F.max(column),
        "mode": lambda: F.mode(column, True),
    }[name]()


#: Groups of up to so many values are ordered by one task each.
GATHERED = 1_000_000


def quantiles(table: DataFrame, column: str, by: Sequence[str], shares: Sequence[float], cuts: int = 32, gathered: int = GATHERED) -> DataFrame:
    """by and q0, q1, ...: the discrete percentile of each share, exact for groups of any size.

    percentile_disc keeps a group's distinct values in one task, so it is used only if a first count finds no
    group of more than `gathered` values. Beyond that, approximate cut points deal each
    group's values into buckets, the buckets' counts tell which one holds a rank, and only that
    bucket's distinct values are shuffled and ordered: a `cuts`-th of a group for each share.
    Nulls don't count; a group without values has no row. Null group values are a group.
    """
    rows = table.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_v"))
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= gathered:
        # one map of a group's values for all shares
        every = F.expr(f"percentile_disc(array({', '.join(map(repr, map(float, shares)))})) WITHIN GROUP (ORDER BY _v)")
        found = rows.groupBy(*by).agg(every.alias("_q")).where("_q IS NOT NULL")
        return found.select(*by, *(F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(shares))))
    bounds = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 1000)).alias("_cuts"))
    dealt = equal_join(rows, bounds, by, ["_cuts"]).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    # at most `cuts` rows a group from here on
    sums = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_s"))
    order = Window.partitionBy(*by).orderBy("_b")
    sums = sums.withColumns({"_upto": F.sum("_s").over(order), "_n": F.sum("_s").over(Window.partitionBy(*by))})
    asked = sums.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)))).alias("_q"))
    asked = asked.withColumn("_rank", F.greatest(F.ceil(F.col("_q.p") * F.col("_n")), F.lit(1))).where("_rank <= _upto AND _rank > _upto - _s")
    asked = asked.groupBy(*by, "_b").agg(F.collect_list(F.struct(F.col("_q.i").alias("i"), (F.col("_rank") - (F.col("_upto") - F.col("_s"))).alias("left"))).alias("_asked"))
    inside = equal_join(dealt, asked.select(*by, "_b", "_asked"), [*by, "_b"], ["_asked"]).groupBy(*by, "_b", "_v").agg(F.count("*").alias("_c"), F.first("_asked").alias("_asked"))
    inside = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v")))
    found = inside.select(*by, "_v", "_upto", F.explode("_asked").alias("_a")).where("_upto >= _a.left")
    return found.groupBy(*by).agg(*(F.min(F.when(F.col("_a.i") == i, F.col("_v"))).alias(f"q{i}") for i in range(len(shares))))


def measure(tokens: DataFrame, column: str, by: Sequence[str], prefix: str | None = None) -> DataFrame:
    """mean_<prefix> and sd_<prefix> of a numeric column for each combination of `by`."""
    prefix = prefix or column
    return tokens.groupBy(*by).agg(F.avg(column).alias(f"mean_{prefix}"), F.stddev_samp(column).alias(f"sd_{prefix}"))


def baseline(tokens: DataFrame, column: str, type_key: Sequence[str], parent: Sequence[str], name: str = "baseline") -> DataFrame:
    """For each parent the sum of its tokens' type means."""
    means = measure(tokens, column, type_key, "own")
    return tokens.join(means, [*type_key]).groupBy(*parent).agg(F.sum("mean_own").alias(name))


def relativised(tokens: DataFrame, column: str, type_key: Sequence[str], name: str = "relativised") -> DataFrame:
    """tokens with the z-score of the column within its type; 0 where the type has no spread. The types' statistics are small and are joined, so that a frequent type is not gathered in one task."""
    stats = measure(tokens, column, type_key, "own")
    z = F.when(F.col("sd_own") > 0, (F.col(column) - F.col("mean_own")) / F.col("sd_own")).otherwise(F.lit(0.0))
    return tokens.join(stats, [*type_key]).withColumn(name, z).drop("mean_own", "sd_own")


def relativised_parent(tokens: DataFrame, column: str, type_key: Sequence[str], parent: Sequence[str], name: str = "relativised") -> DataFrame:
    """For each parent the mean z-score of its tokens."""
    return relativised(tokens, column, type_key, "_z").groupBy(*parent).agg(F.avg("_z").alias(name))
