"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Models are learnt from the tables in sf_dir, decisions are made about docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlake.llm import bpe_codec, decontaminate, ngram_join, quality, toxicity
from tierlake.llm.runtime import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. Null and empty texts have the score of the intercept; repeated rows are judged alike, null ids by their texts; all columns stay, whatever their names."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name := _free(docs)).where(F.col(name) < toxicity.TOXIC_FROM).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the quality threshold. Null and empty texts are judged by their statistics; repeated rows alike, null ids by their texts; all columns stay, whatever their names."""
    model = quality.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name := _free(docs)).where(F.col(name) >= quality.GOOD_FROM).select(*docs.columns)


def _keyed(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """docs with a number of each row's own, written so that it stays the same."""
    return Workspace(spark, "rows").keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: one with the smallest id (null only if no row has one); documents without words stay."""
    rows = _keyed(spark, docs, key := _free(docs))
    groups = ngram_join.components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    first = rows.select(key, "doc_id").join(groups, key).groupBy("_group").agg(F.min_by(key, order).alias(key)).select(key)
    return rows.join(first, key, "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; each row is judged by its own text."""
    rows = _keyed(spark, docs, key := _free(docs))
    gone = decontaminate.contamination(rows.select(F.col(key).alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left. A null text counts as empty and has no ids; repeated rows and null ids are encoded each; further columns end here."""
    return bpe_codec.encode(docs, decoded=False).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: The classifiers can't be put as SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    space = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
