"""What the tiers of a file mean: which level they are of, and whether they give its tokens, a property or subannotations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.corpus import KEYS, Corpus
from tierlake.operators.rangejoin import within
from tierlake.sources.readers import morphemes_of, segments_of


@dataclass(frozen=True)
class TierSpec:
    """What a tier is.

    tier: its name in the file. points: labels at times instead of intervals. role: token (its intervals are the level's tokens),
    grouping (the same, but what they hold is no label: phrases, breaths), token_property, type_property,
    subannotation, ignored, morphemes (the parts of each label at `delimiter`, a list among the type's properties) or
    transcription (each label is the segments of its token, told apart by `delimiter`, else longest of `digraphs` first:
    they become the tokens of the level `below`, which share the token's time in equal parts; the type keeps the
    transcription, joined by dots).
    """

    tier: str
    level: str
    role: str = "token"
    name: str | None = None
    points: bool = False
    delimiter: str | None = None
    digraphs: tuple[str, ...] = ()
    ignored: str = ""
    below: str | None = None

    def __post_init__(self) -> None:
        if self.role not in ("token", "grouping", "token_property", "type_property", "subannotation", "morphemes", "transcription", "ignored"):
            raise ValueError(f"unknown role {self.role!r}")
        if self.role == "transcription" and not self.below:
            raise ValueError(f"{self.tier}: a transcription needs the level below that its segments make")


def _segments(tier: DataFrame, spec: TierSpec) -> DataFrame:
    """The segments of each label as intervals: label, begin, end and keys."""
    parts = tier.withColumn("_parts", segments_of(F.col("label"), spec.delimiter, spec.digraphs, spec.ignored)).withColumn("_n", F.size("_parts"))
    share = (F.col("end") - F.col("begin")) / F.col("_n")
    parts = parts.select(*KEYS, F.col("begin").alias("_b"), share.alias("_share"), F.posexplode("_parts").alias("_i", "label"))
    return parts.select("label", (F.col("_b") + F.col("_i") * F.col("_share")).alias("begin"), (F.col("_b") + (F.col("_i") + 1) * F.col("_share")).alias("end"), *KEYS)


def build(spark, name: str, rows: DataFrame, specs: Sequence[TierSpec], order: Sequence[str]) -> Corpus:
    """A corpus of a reader's tokens; properties, subannotations and morphemes go to the token that holds their midpoint, segments of a transcription to the one that holds theirs."""
    one = lambda s: rows.where(F.col("tier") == s.tier).select("label", "begin", "end", *KEYS[::-1])
    tiers = {s.level: one(s).withColumn("label", F.when(F.col("label") == "", "<SIL>").otherwise(F.col("label"))) for s in specs if s.role == "token"}
    tiers |= {s.level: one(s).withColumn("label", F.lit(None).cast("string")) for s in specs if s.role == "grouping"}
    for s in specs:
        if s.role == "transcription":
            if s.below in tiers:
                raise ValueError(f"{s.below} has a tier of its own")
            tiers[s.below] = _segments(one(s), s)
    corpus = Corpus.from_tiers(spark, name, tiers, order)
    for s in specs:
        if s.role in ("token", "grouping", "ignored"):
            continue
        spans = corpus.tokens[s.level].select(*KEYS, F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("id").alias("_id"), F.col("label").alias("_label"))
        found = within(one(s).withColumn("_mid", (F.col("begin") + F.col("end")) / 2), spans, KEYS, "_mid", "_b", "_e", ["_id", "_label"])
        kept = s.name or s.tier
        if s.role == "token_property":
            corpus.enrich_tokens(s.level, found.groupBy(F.col("_id").alias("id")).agg(F.min_by("label", "begin").alias(kept)))
        elif s.role in ("morphemes", "transcription"):
            parts = morphemes_of(F.col("label"), s.delimiter or "-=") if s.role == "morphemes" else F.array_join(segments_of(F.col("label"), s.delimiter, s.digraphs, s.ignored), ".")
            corpus.enrich_types(s.level, found.groupBy(F.col("_label").alias("label")).agg(F.mode(parts, True).alias(s.name or s.role)), case_sensitive=True)
        elif s.role == "type_property":
            corpus.enrich_types(s.level, found.groupBy(F.col("_label").alias("label")).agg(F.mode("label", True).alias(kept)), case_sensitive=True)
        else:
            own = F.sha1(F.concat_ws("|", F.lit(kept), "_id", "begin", "end", "label"))
            corpus.add_subannotations(s.level, kept, found.select(own.alias("id"), F.col("_id").alias("annotated_id"), "label", "begin", "end"))
    return corpus


def export_points(corpus: Corpus, level: str, measures: Sequence[str], path: str) -> None:
    """id and point measures of a level's tokens as CSV."""
    from tierlake.sources.sinks import write_csv

    write_csv(corpus.tokens[level].select("id", "label", "begin", "end", *measures), path)


def import_points(corpus: Corpus, level: str, path: str, measures: Sequence[str]) -> None:
    """Measures of a CSV that export_points wrote, by id."""
    rows = corpus.spark.read.option("header", True).csv(path)
    corpus.enrich_tokens(level, rows.select("id", *(F.col(m).try_cast("double").alias(m) for m in measures)))
