"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Stems (prefixes of words) stand beside words as unigrams of word forms not met in the sample.
They and the settings were chosen by fold_losses, on rows that may be learnt from alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tierlake.llm.columns import coded, distinct
from tierlake.llm.labelled import SAMPLE_ROWS, gathered, held_out, sample
from tierlake.llm.runtime import documents, give_back, slices
from tierlake.llm.shingles import mix

BITS = 18
#: Stems, in characters, that stand beside the whole word.
STEMS = (4, 5, 6, 7)
#: A feature counts if so many rows of the sample have it.
LEAST_ROWS = 4
#: How many words a skip-gram leaves out at most.
SKIPS = 2


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate learning rates (alpha, beta) and the penalties l1 and l2."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.01
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, by feature number in order, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.features] = self.weights
        return out


def _place(x: np.ndarray, seed: int) -> np.ndarray:
    return (mix(x, seed) >> np.uint64(64 - BITS)).astype(np.int64)


def _twice(number: np.ndarray) -> np.ndarray:
    """The feature that says a stem occurs in two or more different words."""
    return (number * 0x9E3779B1 + 77) & ((1 << BITS) - 1)


def features(texts: pa.Array, weights: np.ndarray | None = None) -> np.ndarray:
    """text << BITS | feature, in order and without repeats; with weights, only features whose weight is not zero.

    Words are lower-cased runs of letters and digits. Features: each word; its stems, and again
    where a text has two different words of a stem; neighbouring words; pairs that skip one or
    two words.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+", " ")
    lists = pc.ascii_split_whitespace(plain)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    full = pc.not_equal(flat, "")
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    if not len(flat):
        return np.zeros(0, np.int64)
    forms, index = coded(flat)
    found: list[np.ndarray] = []

    def take(number: np.ndarray, who: np.ndarray, stem: bool = False) -> None:
        if weights is not None:
            some = weights[number] != 0
            if stem:
                some |= weights[_twice(number)] != 0
            number, who = number[some], who[some]
        both = who << BITS | number
        if stem:
            both, times = np.unique(both, return_counts=True)
            more = both[times > 1]
            found.append(more >> BITS << BITS | _twice(more & ((1 << BITS) - 1)))
        found.append(both)

    once = distinct(owner, index, len(forms))
    who, what = once // len(forms), once % len(forms)
    names = forms.to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    take(_place(known, 0)[what], who)
    length = pc.utf8_length(forms).to_numpy()
    for k in STEMS:
        cut = pc.utf8_slice_codeunits(forms, 0, k).to_pylist()
        number = _place(np.fromiter(map(xxhash.xxh3_64_intdigest, cut), np.uint64, len(cut)), k)
        long = length[what] >= k
        take(number[what[long]], who[long], stem=True)
    word = known[index]
    for gap in range(1, SKIPS + 2):
        if len(word) > gap:
            same = owner[gap:] == owner[:-gap]
            take(_place((word[:-gap] * np.uint64(0x9E3779B97F4A7C15) + word[gap:])[same], 10 + (gap > 1)), owner[gap:][same])
    both = np.unique(np.concatenate(found))
    if weights is not None:
        both = both[weights[both & ((1 << BITS) - 1)] != 0]
    return both


def _examples(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and truths of at most `rows` labelled rows, in order of ids, labels and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = features(batch.column("text"))
            cut = np.searchsorted(both >> BITS, np.arange(batch.num_rows + 1))
            numbers = (both & ((1 << BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([numbers[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["doc_id", "y", "numbers"])

    known = gathered(sample(docs, labels, label, rows).mapInArrow(run, "doc_id long, y int, numbers binary"), "numbers", rows)
    examples = sorted(zip(*(known[c].to_pylist() for c in ("doc_id", "y", "numbers"))))
    return [np.frombuffer(x, np.uint32) for _, _, x in examples], np.array([y for _, y, _ in examples], float)


def learn(numbers: list[np.ndarray], truth: np.ndarray, settings: Ftrl = Ftrl()) -> Model:
    """FTRL-proximal over examples (their feature numbers, each once) in a random order that is always the same. Without examples, every score is 0."""
    if not len(numbers):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -50.0)
    order = np.random.default_rng(11)
    often = np.zeros(1 << BITS, np.int64)
    for x in numbers:
        often[x] += 1
    # a feature of few rows tells little; in a sample of very few rows all count
    numbers = [x[often[x] >= min(LEAST_ROWS, len(numbers) // 4)] for x in numbers]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
    bias, seen = float(np.log(share / (1 - share))), 1.0
    s = settings

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i in order.permutation(len(numbers)):
            at = numbers[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            error = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -50, 50))) - truth[i]
            z[at] = zi + error - (np.sqrt(ni + error * error) - np.sqrt(ni)) / s.alpha * w
            n[at] = ni + error * error
            seen += error * error
            bias -= s.alpha * error / (1 + np.sqrt(seen))
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept].astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Ftrl = Ftrl(), rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `rows` labelled rows (see labelled.sample). Without any, every score is 0."""
    model = learn(*_examples(docs, labels, label, rows), settings)
    give_back()
    return model


def fold_losses(docs: DataFrame, labels: DataFrame, settings: Sequence[Ftrl], label: str = "toxic", rows: int = SAMPLE_ROWS, folds: int = 3) -> list[float]:
    """The mean log loss of each settings over folds of the rows that may be learnt from; held-out rows play no part. The defaults were chosen by it."""
    numbers, truth = _examples(docs, labels, label, rows)
    fold = np.random.default_rng(3).integers(0, folds, len(numbers))
    out = []
    for s in settings:
        loss = 0.0
        for k in range(folds):
            model = learn([x for x, f in zip(numbers, fold) if f != k], truth[fold != k], s)
            dense = model.dense()
            for x, y in ((numbers[i], truth[i]) for i in np.flatnonzero(fold == k)):
                p = np.clip(1 / (1 + np.exp(-np.clip(dense[x].sum() + model.bias, -50, 50))), 1e-6, 1 - 1e-6)
                loss -= np.log(p if y else 1 - p)
        out.append(loss / max(len(numbers), 1))
    return out


def score(docs: DataFrame, model: Model, extend: str | None = None) -> DataFrame:
    """doc_id, score (0 to 1) for each row; or, if `extend` is a
    name that docs has no column of, all columns of docs and the score under that name.

    A feature counts once a text. A null or empty text has no features, so its score is that of
    the intercept; a very long one is scored whole. Repeated rows stay and score alike; an empty table gives none; other
    columns are ignored unless extended. The
    weights have 2**BITS entries at most, whatever the input, and travel with the task.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.features, model.weights, model.bias))
    rows = docs if extend else documents(docs).select("doc_id", "text")
    kept = rows.columns if extend else ["doc_id"]
    schema = StructType([*(rows.schema[c] for c in kept), StructField(extend or "score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        weights = own.dense()
        for batch in slices(batches):
            both = features(batch.column("text"), weights)
            logit = np.bincount(both >> BITS, weights[both & ((1 << BITS) - 1)], minlength=batch.num_rows) + own.bias
            values = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values)], names=[*kept, extend or "score"])

    return rows.mapInArrow(run, schema)


#: From this score on a document counts as toxic.
TOXIC_FROM = 0.7


def query(spark, sf_dir: str) -> DataFrame:
    """op10: toxicity of all documents, learnt from the labelled rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
