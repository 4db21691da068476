"""Properties by key from tables and CSV, subsets, updates and deletes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.errors import EngineError

_TRUE, _FALSE, _NONE = ("true", "t"), ("false", "f"), ("", "none", "null", "na")


def clean_name(name: str) -> str:
    """A column name from a header: stripped, spaces as underscores, lower case; a dot is refused."""
    name = re.sub(r"\s+", "_", name.strip()).lower()
    if "." in name:
        raise EngineError(f"a property name must not contain a dot: {name}")
    return name


def read_properties(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV with a header: the first column is the key (string), the others get the type that most of their values have.

    true/false are booleans, none/null/na and nothing are nulls, numbers with a dot doubles,
    others integers; what doesn't fit the column's type becomes null. Of repeated keys the last
    line in the file counts.
    """
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        sep = max(("\t", ",", ";", "|"), key=(head[0][0] if head else ",").count)
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    key, *others = raw.columns
    names = {c: clean_name(c.lstrip("﻿")) for c in raw.columns}
    plain = {c: F.lower(F.trim(F.col(f"`{c}`"))) for c in others}
    kind = lambda c: F.when(plain[c].isNull() | plain[c].isin(*_NONE), None).when(plain[c].isin(*_TRUE, *_FALSE), "boolean").when(plain[c].contains(".") & plain[c].try_cast("double").isNotNull(), "double").when(plain[c].try_cast("bigint").isNotNull(), "bigint").otherwise("string")
    votes = raw.agg(*(F.mode(kind(c), True).alias(str(i)) for i, c in enumerate(others))).first() if others else []
    columns = [F.trim(F.col(f"`{key}`")).alias(names[key])]
    for i, c in enumerate(others):
        value = F.when(~plain[c].isin(*_NONE), F.trim(F.col(f"`{c}`")))
        to = votes[i] or "string"
        if to == "boolean":
            value = F.when(plain[c].isin(*_TRUE), True).when(plain[c].isin(*_FALSE), False)
        elif to != "string":
            value = value.try_cast("double").cast(to) if to == "bigint" else value.try_cast(to)
        columns.append(value.alias(names[c]))
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.select(*columns, "_at").where(F.col(names[key]).isNotNull())
    rest = [names[c] for c in others]
    return rows.groupBy(names[key]).agg(F.max_by(F.struct(*rest), "_at").alias("_v")).select(names[key], *(F.col("_v")[c].alias(c) for c in rest)) if rest else rows.select(names[key]).distinct()


def enrich(table: DataFrame, properties: DataFrame, on: str, key: str | None = None, case_sensitive: bool = True, keep_present: bool = False) -> DataFrame:
    """table with the properties of its key, all rows kept; a column that both have is overwritten where a new value exists, or left if keep_present."""
    key = key or properties.columns[0]
    new = [c for c in properties.columns if c != key and not (keep_present and c in table.columns)]
    fold = (lambda c: c) if case_sensitive else F.lower
    side = properties.select(fold(F.col(key)).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in new))
    if not case_sensitive:
        side = side.dropDuplicates(["_key"])
    joined = table.join(side, fold(F.col(on)) == F.col("_key"), "left")
    merged = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in table.columns else F.col(f"_new_{c}").alias(c) for c in new]
    return joined.select(*(c for c in table.columns if c not in new), *merged)


def update(table: DataFrame, where: Column, **values) -> DataFrame:
    """New values in the rows that match; None removes the column's values there."""
    out = table
    for name, value in values.items():
        new = value if isinstance(value, Column) else F.lit(value)
        old = F.col(name) if name in table.columns else F.lit(None)
        out = out.withColumn(name, F.when(where, new).otherwise(old))
    return out


def delete(table: DataFrame, where: Column) -> DataFrame:
    """The rows that don't match (a null condition doesn't)."""
    return table.where(~F.coalesce(where, F.lit(False)))


def add_subset(table: DataFrame, where: Column, name: str) -> DataFrame:
    """Rows that match get `name` among their subsets, once."""
    old = F.coalesce("subsets", F.expr("cast(array() as array<string>)")) if "subsets" in table.columns else F.expr("cast(array() as array<string>)")
    return table.withColumn("subsets", F.when(F.coalesce(where, F.lit(False)), F.array_union(old, F.array(F.lit(name)))).otherwise(old))


def remove_subset(table: DataFrame, where: Column, name: str) -> DataFrame:
    return table.withColumn("subsets", F.when(F.coalesce(where, F.lit(False)), F.array_except("subsets", F.array(F.lit(name)))).otherwise(F.col("subsets")))


def in_subset(name: str) -> Column:
    return F.coalesce(F.array_contains("subsets", name), F.lit(False))


def encode_class(types: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """Types whose label is listed become a subset."""
    return add_subset(types, F.col("label").isin(list(labels)), name)


def remove_pattern(phones: DataFrame, pattern: str = "[0-9]") -> DataFrame:
    """Labels without the pattern; oldlabel keeps what they were."""
    return phones.withColumn("oldlabel", F.col("label")).withColumn("label", F.regexp_replace("label", pattern, ""))


def reset_to_old_label(phones: DataFrame) -> DataFrame:
    return phones.withColumn("label", F.coalesce("oldlabel", "label")).drop("oldlabel")


def orphans_removed(dimension: DataFrame, facts: DataFrame, key: str, foreign: str) -> DataFrame:
    """Rows of a dimension that some fact refers to."""
    return dimension.join(facts.select(F.col(foreign).alias(key)).distinct(), key, "left_semi")


def equal_join(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """a with columns of b, where null keys are equal too."""
    b = b.select(*(F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)), *columns)
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)), F.lit(True))
    return a.join(b, on, how).drop(*(f"_r{i}" for i in range(len(keys))))
