"""Pauses and utterances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.operators import scans
from tierlake.operators.windows import chain, sessions


def encode_pauses(words: DataFrame, pauses: Sequence[str] | str) -> DataFrame:
    """words with is_pause: labels in a list, or matching a regular expression as a whole."""
    hit = F.col("label").rlike(rf"\A(?:{pauses})\z") if isinstance(pauses, str) else F.col("label").isin(list(pauses))
    return words.withColumn("is_pause", F.coalesce(hit, F.lit(False)))


def reset_pauses(words: DataFrame) -> DataFrame:
    return words.withColumn("is_pause", F.lit(False))


def speech_bounds(words: DataFrame) -> DataFrame:
    """discourse, speech_begin, speech_end: the first begin and last end of words that are no pauses."""
    return words.where(~F.col("is_pause")).groupBy("discourse").agg(F.min("begin").alias("speech_begin"), F.max("end").alias("speech_end"))


def spans(words: DataFrame, keys: Sequence[str], shortest_pause: float, pieces: int = 0) -> DataFrame:
    """words that are no pauses, with span: stretches between which at least `shortest_pause` seconds pass. pieces: chains are cut into so many segments of time, if any."""
    speech, order = words.where(~F.col("is_pause")), ["begin", "id"]
    # any gap, however short, where no shortest one is asked for
    gap = shortest_pause if shortest_pause > 0 else 5e-324
    if pieces:
        found = scans.sessions(speech, keys, order, "begin", "end", gap, pieces)
    else:
        found = sessions(speech, keys, order, "begin", "end", gap)
    return found.withColumnRenamed("session", "span")


def utterances(words: DataFrame, shortest_pause: float = 0.5, shortest: float = 0.0, keys: Sequence[str] = ("discourse",), pieces: int = 0) -> DataFrame:
    """keys, utterance (1, 2, ...), begin, end, n_words.

    Speech splits at pauses of at least `shortest_pause` (any pause if 0). A stretch shorter than
    `shortest` joins the utterance before it if that is nearer than the next stretch, and is dropped
    otherwise. A long stretch always begins an utterance, whatever came before it; so the short ones between
    two long ones are folded by themselves, over the end that the utterance has so far. pieces: as in spans().
    """
    # a pause of 0.5 that floating point shows as 0.4999999 still is one
    found = spans(words, keys, shortest_pause - 1e-9 if shortest_pause else 0.0, pieces).groupBy(*keys, "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n_words"))
    if shortest > 0:
        w = chain(keys, ["span"])
        long = F.col("end") - F.col("begin") >= shortest
        # a null length is not short
        found = found.withColumn("_long", F.coalesce(long, F.lit(True))).withColumns({"_head": F.sum(F.col("_long").cast("long")).over(w), "_to_next": F.lead("begin").over(w) - F.col("end")})
        short = F.struct("span", "begin", "end", "n_words", F.coalesce("_to_next", F.lit(float("inf"))).alias("to_next"))
        groups = found.where("_head > 0").groupBy(*keys, "_head").agg(
            F.min_by(F.struct("begin", "end", "n_words"), "span").alias("_first"), F.array_sort(F.collect_list(F.when(~F.col("_long"), short))).alias("_short")
        )

        def join(so_far: Column, s: Column) -> Column:
            near = s["begin"] - so_far["end"] < s["to_next"]
            return F.struct(F.when(near, s["end"]).otherwise(so_far["end"]).alias("end"), (so_far["n_words"] + F.when(near, s["n_words"]).otherwise(0)).alias("n_words"))

        folded = F.aggregate("_short", F.struct(F.col("_first.end").alias("end"), F.col("_first.n_words").alias("n_words")), join)
        found = groups.withColumn("_all", folded).select(*keys, "_first.begin", "_all.end", "_all.n_words")
    return found.withColumn("utterance", F.row_number().over(Window.partitionBy(*keys).orderBy("begin")).cast("int")).select(*keys, "utterance", "begin", "end", "n_words")


def attach(tokens: DataFrame, intervals: DataFrame, keys: Sequence[str], column: str = "utterance", name: str = "utterance_id") -> DataFrame:
    """tokens with the interval that contains their midpoint, or null."""
    from tierlake.operators.rangejoin import within

    named = intervals.withColumn(name, F.sha1(F.concat_ws("|", *keys, F.lit(name), column)))
    return within(tokens.withColumn("_mid", (F.col("begin") + F.col("end")) / 2), named.select(*keys, F.col("begin").alias("_b"), F.col("end").alias("_e"), name), keys, "_mid", "_b", "_e", [name], inner=False).drop("_mid")


def rate(parents: DataFrame, children: DataFrame, parent_id: str = "id", foreign: str = "parent_id", begin: str = "begin", end: str = "end") -> DataFrame:
    """parents with n (their children) and rate (n by duration, null where that is zero)."""
    n = children.groupBy(F.col(foreign).alias(parent_id)).agg(F.count("*").alias("n"))
    joined = parents.join(n, parent_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col(end) - F.col(begin)))
