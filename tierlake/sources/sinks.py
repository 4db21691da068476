"""CSV and JSON out of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by slashes, nulls as nothing, all as strings."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "/")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def with_track(df: DataFrame, track: str) -> DataFrame:
    """One row for each point of a track column (an array of structs with time), the time rounded to four places."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if arrays != [track]:
        raise ValueError("a result can have one track when it is written point by point")
    names = df.schema[track].dataType.elementType.names
    points = df.withColumn("_p", F.explode_outer(track)).drop(track)
    return points.select(*(c for c in points.columns if c != "_p"), *((F.round(F.col("_p")[n].cast("double"), 4) if n == "time" else F.col("_p")[n]).alias(n) for n in names))


def write_csv(df: DataFrame, path: str, track: str | None = None, one_file: bool = False) -> None:
    """A folder of CSV with headers; one file only if asked for, as one task then writes it."""
    out = flat(with_track(df, track) if track else df)
    (out.coalesce(1) if one_file else out).write.option("header", True).mode("overwrite").csv(path)
