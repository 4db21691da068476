"""What a table's columns hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def factors(table: DataFrame) -> list[str]:
    """Columns of strings."""
    return [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]


def numerics(table: DataFrame) -> list[str]:
    """Columns of whole or floating-point numbers."""
    return [f.name for f in table.schema if isinstance(f.dataType, T.NumericType)]


def levels(table: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that aren't null."""
    return table.select(column).where(F.col(column).isNotNull()).distinct()


def value_range(table: DataFrame, column: str) -> DataFrame:
    """least, most."""
    return table.agg(F.min(column).alias("least"), F.max(column).alias("most"))


def grouping_factors(table: DataFrame) -> list[str]:
    """Columns of strings with more than one value, but fewer than there are rows."""
    names = factors(table)
    if not names:
        return []
    row = table.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in names)).first()
    return [c for c in names if 1 < row[c] < row["_n"]]
