"""Onsets, codas and syllables of words' phone lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlake.functions.syllables import EMPTY, UNSEEN_CODAS, UNSEEN_ONSETS


def phone_lists(phones: DataFrame, parent: str = "word_id") -> DataFrame:
    """parent, ids, phones, begins, ends of each word in order of time."""
    items = F.array_sort(F.collect_list(F.struct("begin", "id", "label", "end")))
    pick = lambda name: F.transform("_p", lambda x: x[name])
    return phones.groupBy(parent).agg(items.alias("_p")).select(parent, pick("id").alias("ids"), pick("label").alias("phones"), pick("begin").alias("begins"), pick("end").alias("ends"))


def _nucleus_places(phones: str, nuclei: Sequence[str]) -> Column:
    wanted = F.array(*map(F.lit, nuclei))
    places = F.transform(phones, lambda p, i: F.when(F.array_contains(wanted, p), i + 1))
    return F.filter(places, lambda i: i.isNotNull())


def onsets(words: DataFrame, nuclei: Sequence[str], phones: str = "phones") -> DataFrame:
    """onset (array, empty included), freq: the phones before the first nucleus of words that have one."""
    first = F.try_element_at(_nucleus_places(phones, nuclei), F.lit(1))
    return words.withColumn("_at", first).where("_at is not null").select(F.slice(phones, F.lit(1), F.col("_at") - 1).alias("onset")).groupBy("onset").agg(F.count("*").alias("freq"))


def codas(words: DataFrame, nuclei: Sequence[str], phones: str = "phones") -> DataFrame:
    """coda (array, empty included), freq: the phones after the last nucleus of words that have one."""
    last = F.try_element_at(_nucleus_places(phones, nuclei), F.lit(-1))
    return words.withColumn("_at", last).where("_at is not null").select(F.slice(phones, F.col("_at") + 1, F.size(phones)).alias("coda")).groupBy("coda").agg(F.count("*").alias("freq"))


def longest_onset_split(consonants: Column, legal: Sequence[Sequence[str]]) -> Column:
    """split_at_longest_onset as a column: the first place whose rest is legal, or null."""
    allowed = F.array(*[F.array(*map(F.lit, x)) if x else F.expr("cast(array() as array<string>)") for x in legal])
    places = F.sequence(F.lit(0), F.size(consonants))
    good = F.filter(places, lambda i: F.array_contains(allowed, F.slice(consonants, i + 1, F.greatest(F.size(consonants) - i, F.lit(0)))))
    return F.when(F.size(consonants) > 0, F.try_element_at(good, F.lit(1)))


def log_shares(counts: DataFrame, sequence: str, unseen: float) -> tuple[DataFrame, Column]:
    """(sequence, share: the log of each counted sequence's share; the log share of all sequences that were not counted).

    What was not counted gets `unseen` of all counts, and the empty sequence a fixed share of that, whatever its count.
    """
    totals = counts.agg(F.struct(F.sum("freq").alias("seen"), F.coalesce(F.sum(F.when(F.size(sequence) > 0, F.col("freq"))), F.lit(0)).alias("full"))).scalar()
    seen, full = totals["seen"], totals["full"]
    rest, empty = seen * unseen, (seen + seen * unseen) * unseen * EMPTY
    whole = full + rest + empty
    kind = dict(counts.dtypes)[sequence]
    none = counts.sparkSession.range(1).select(F.array().cast(kind).alias(sequence), F.lit(None).cast("bigint").alias("freq"))
    known = counts.where(F.size(sequence) > 0).select(sequence, "freq").unionByName(none)
    return known.select(sequence, F.ln(F.coalesce(F.col("freq").cast("double"), empty) / whole).alias("share")), F.ln(rest / whole)


def splits(runs: DataFrame, onset_counts: DataFrame, coda_counts: DataFrame | None = None, bare: bool = False) -> DataFrame:
    """run and cut for each distinct run (array) of consonants: how many of them go to the syllable before; no row where no split is legal.

    With onsets only, the longest rest that is an onset; with codas too, the likeliest pair of a coda and an onset, the
    first of equals (to nine places). bare: runs that are whole words without a nucleus, which are cut into an onset and what
    is left. Every split of a run is a row, and meets the counts by equality of its parts.
    """
    n = F.size("run")
    each = runs.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), n)).alias("cut"))
    each = each.withColumns({"_left": F.slice("run", F.lit(1), F.col("cut")), "_right": F.slice("run", F.col("cut") + 1, n - F.col("cut"))})
    if coda_counts is None:
        legal = onset_counts.select(F.col("onset").alias("_left" if bare else "_right")).distinct()
        return each.join(legal, legal.columns[0], "left_semi").groupBy("run").agg((F.max if bare else F.min)("cut").alias("cut"))
    (onset, no_onset), (coda, no_coda) = log_shares(onset_counts, "onset", UNSEEN_ONSETS), log_shares(coda_counts, "coda", UNSEEN_CODAS)
    first, second = ((onset, "onset", no_onset), (coda, "coda", no_coda)) if bare else ((coda, "coda", no_coda), (onset, "onset", no_onset))
    for place, (table, name, rest) in (("_left", first), ("_right", second)):
        each = each.join(table.select(F.col(name).alias(place), F.col("share").alias(f"{place}_share")), place, "left").withColumn(f"{place}_share", F.coalesce(f"{place}_share", rest))
    likely = F.round(F.col("_left_share") + F.col("_right_share"), 9)
    return each.groupBy("run").agg(F.min_by("cut", F.struct(-F.coalesce(likely, F.lit(float("-inf"))), "cut")).alias("cut"))


def encode_syllables(phones: DataFrame, nuclei: Sequence[str], method: str = "maxonset", custom_onsets: Sequence[Sequence[str]] | None = None, parent: str = "word_id") -> DataFrame:
    """One row for each phone that is in a syllable: parent, syllable_id, place (of the syllable in its word, from 1), label ('.'-joined phones), begin, end, phone_id, part (onset, nucleus or coda).

    Consonants before the first nucleus and after the last belong to theirs; a run between two nuclei is split by
    the method (maxonset or probabilistic), once for all words that have it. Where no split is legal the run belongs to no syllable. A
    word without a nucleus is one syllable. Legal onsets (and codas, for the probabilistic method) are those of
    the words themselves unless given. Phones of no word are in no syllable.
    """
    words = phone_lists(phones.where(F.col(parent).isNotNull()), parent)
    counts = onsets(words, nuclei)
    if custom_onsets is not None:
        counts = words.sparkSession.createDataFrame([([*x], 1) for x in custom_onsets], "onset array<string>, freq long")
    elif method == "maxonset":
        counts = counts.unionByName(words.sparkSession.range(1).select(F.array().cast("array<string>").alias("onset"), F.lit(0).cast("bigint").alias("freq")))
    ends = None if method == "maxonset" else codas(words, nuclei)
    words = words.withColumn("_at", _nucleus_places("phones", nuclei))
    count, at = F.size("_at"), lambda k: F.get("_at", k - 1)
    between = F.transform(F.sequence(F.lit(1), count - 1), lambda k: F.struct(k.alias("k"), F.slice("phones", at(k) + 1, at(k + 1) - at(k) - 1).alias("run")))
    runs = words.select(parent, F.explode(F.when(count > 1, between).when(count == 0, F.array(F.struct(F.lit(0).alias("k"), F.col("phones").alias("run"))))).alias("_r")).select(parent, "_r.*", (F.col("_r.k") == 0).alias("bare"))
    known = [splits(runs.where(test), counts, ends, bare).withColumn("bare", F.lit(bare)) for bare, test in ((False, "k > 0 and size(run) > 0"), (True, "k = 0"))]
    cut = F.when((F.col("k") > 0) & (F.size("run") == 0), 0).otherwise(F.col("cut"))
    cuts = runs.join(known[0].unionByName(known[1]), ["run", "bare"], "left").groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", cut.alias("cut")))), lambda x: x["cut"]).alias("_cuts"))
    found = words.join(cuts.hint("merge"), parent, "left")  # exploded rows aren't in Spark's guess of a size: they are not for the driver
    after = lambda k: F.get("_cuts", k - 1)  # the cut after the k-th nucleus
    size = F.size("phones")

    def syllable(k: Column) -> Column:
        first = F.when(k == 1, 0).when(after(k - 1).isNull(), at(k) - 1).otherwise(at(k - 1) + after(k - 1))
        stop = F.when(k == count, size).otherwise(at(k) + F.coalesce(after(k), F.lit(0)))
        return F.struct(k.alias("place"), first.alias("first"), stop.alias("stop"), (at(k) - 1).alias("nucleus"), (at(k) - 1).alias("border"))

    # a syllable without a nucleus is an onset and what is left
    lone = F.struct(F.lit(1).alias("place"), F.lit(0).alias("first"), size.alias("stop"), F.lit(-1).alias("nucleus"), F.coalesce(F.get("_cuts", F.lit(0)), size).alias("border"))
    found = found.select(parent, "phones", "ids", "begins", "ends", F.explode(F.when(count == 0, F.array(lone)).otherwise(F.transform(F.sequence(F.lit(1), count), syllable))).alias("_s")).select(parent, "phones", "ids", "begins", "ends", "_s.*")
    found = found.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("stop") - 1)))
    return found.select(
        parent, F.sha1(F.concat_ws("|", parent, "place")).alias("syllable_id"), "place", F.array_join(F.slice("phones", F.col("first") + 1, F.col("stop") - F.col("first")), ".").alias("label"),
        F.get("begins", F.col("first")).alias("begin"), F.get("ends", F.col("stop") - 1).alias("end"), F.get("ids", F.col("i")).alias("phone_id"),
        F.when(F.col("i") == F.col("nucleus"), "nucleus").when(F.col("i") < F.col("border"), "onset").otherwise("coda").alias("part"),
    )


def stress_from_label(label: Column, pattern: str = "[0-9]") -> tuple[Column, Column]:
    """(the first match of the pattern or null, the label without any)."""
    return F.nullif(F.regexp_extract(label, f"({pattern})", 1), F.lit("")), F.regexp_replace(label, pattern, "")


def stress_from_word_property(syllables: DataFrame, prop: str, place: str, n: str) -> Column:
    """The syllable's part of a word property like 0-1-0, where it has as many parts as the word has syllables."""
    parts = F.split(F.col(prop), "-")
    return F.when(F.size(parts) == F.col(n), F.get(parts, F.col(place) - 1))
