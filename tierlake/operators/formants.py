"""Choosing among candidate measurements by their distance from prototypes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tierlake.operators.enrich import equal_join
from tierlake.shared import Rounds

#: With fewer tokens than this a group's covariance says little, and the default candidate is taken.
LEAST_TOKENS = 6


def prototypes(measures: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, mean (array) and covariance (array, row by row; sample) of the columns."""
    means = F.array(*(F.avg(c) for c in columns))
    pairs = F.array(*(F.covar_samp(a, b) for a in columns for b in columns))
    return measures.groupBy(*by).agg(means.alias("mean"), pairs.alias("covariance"), F.count("*").alias("n"))


def inverted(prototypes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, mean and inverse (array, row by row): the pseudo-inverse of each group's covariance. A row is a group, so batches of rows are what a task holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = [np.asarray(c, float) for c in batch["covariance"]]
            batch["inverse"] = [np.linalg.pinv(c.reshape(int(len(c) ** 0.5), -1)).ravel().tolist() if np.isfinite(c).all() else None for c in flat]
            yield batch

    table = prototypes.select(*by, "mean", "covariance")
    return table.mapInPandas(run, StructType([*table.schema, StructField("inverse", ArrayType(DoubleType()))]))


def distance(columns: Sequence[str], mean: str = "mean", inverse: str = "inverse") -> Column:
    """The squared Mahalanobis distance of the columns, given arrays of a mean and of an inverse covariance row by row."""
    away = [F.col(c) - F.get(mean, F.lit(i)) for i, c in enumerate(columns)]
    terms = [away[i] * F.get(inverse, F.lit(i * len(columns) + j)) * away[j] for i in range(len(columns)) for j in range(len(columns))]
    return reduce(lambda a, b: a + b, terms)


def refined(candidates: DataFrame, columns: Sequence[str], by: Sequence[str], token: str = "id", candidate: str = "candidate", default: int = 5, rounds: int = 20, prototypes_of: dict[tuple, tuple[Sequence[float], Sequence[Sequence[float]]]] | None = None) -> DataFrame:
    """One candidate a token: that nearest to its group's prototype, which is estimated anew from the choice until it stays.

    Groups (such as speaker and vowel) begin with given prototypes, or with their default
    candidates; groups of fewer than LEAST_TOKENS tokens keep the default, or the first candidate
    where a token has no default. Every round is a grouped mean and covariance of the choice, a distance for each candidate
    and the least of them for each token, for all groups at once and whatever their size; it is written to the
    shared folder and ends the work if no token chose anew. Of equal distances the smaller candidate counts, null
    ones last. Null group values are a group, and a null measure makes a candidate the last choice.
    """
    spark = candidates.sparkSession
    names = [*by, token, candidate, *columns]
    space = Rounds(spark, "refinement")
    rows = space.keep(candidates.select(*names))
    key = [*by, token]
    choose = lambda table, *order: table.groupBy(*key).agg(F.min_by(F.struct(candidate, *columns), F.struct(*order)).alias("_c")).select(*key, "_c.*")
    # the groups' sizes are asked once; small groups have their choice already
    first = choose(rows, ~F.coalesce(F.col(candidate) == default, F.lit(False)), F.col(candidate).isNull(), F.col(candidate))
    sizes = first.groupBy(*by).agg(F.count("*").alias("_n"))
    still = F.lit(False).alias("_moved")
    choice = space.keep(equal_join(first, sizes, by, ["_n"]).select(*names, (F.col("_n") >= LEAST_TOKENS).alias("_open"), still))
    open_rows = equal_join(rows, sizes, by, ["_n"]).where(F.col("_n") >= LEAST_TOKENS).select(*names)
    shape = StructType([*candidates.select(*by).schema, StructField("mean", ArrayType(DoubleType())), StructField("covariance", ArrayType(DoubleType()))])
    given = spark.createDataFrame([(*g, [float(v) for v in m], [float(v) for row in c for v in row]) for g, (m, c) in (prototypes_of or {}).items()], shape)
    for turn in range(rounds):
        found = prototypes(choice.where("_open"), columns, by).select(*by, "mean", "covariance")
        if prototypes_of and not turn:
            own = F.col("_own").isNotNull()
            found = equal_join(found, given.select(*by, F.struct("mean", "covariance").alias("_own")), by, ["_own"], "left")
            found = found.select(*by, F.when(own, F.col("_own.mean")).otherwise(F.col("mean")).alias("mean"), F.when(own, F.col("_own.covariance")).otherwise(F.col("covariance")).alias("covariance"))
        near = equal_join(open_rows, inverted(found, by), by, ["mean", "inverse"]).withColumn("_d", distance(columns))
        new = choose(near, F.col("_d").isNull(), F.col("_d"), F.col(candidate).isNull(), F.col(candidate))
        old = choice.where("_open").select(*key, F.col(candidate).alias("_before"))
        new = equal_join(new, old, key, ["_before"]).select(*names, F.lit(True).alias("_open"), (~F.col(candidate).eqNullSafe(F.col("_before"))).alias("_moved"))
        before, choice = choice, space.keep(choice.where("not _open").select(*names, "_open", still).unionByName(new))
        space.drop(before)
        if not choice.where("_moved").limit(1).count():
            break
    return choice.select(*names)
