"""Quality: a factorisation machine over hashed words, structure statistics and the text's length."""

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

from tierlake.llm.columns import coded
from tierlake.llm.columns import distinct as distinct_in
from tierlake.llm.labelled import SAMPLE_ROWS, gathered, held_out, sample
from tierlake.llm.runtime import documents, give_back, slices

BITS = 14
#: Steps that a statistic's range is cut into, each a feature of its own beside the value itself.
STEPS = 8
STATISTICS = ("upper", "symbols", "digits", "repeats", "same_words", "same_lines", "word_length", "words", "lines", "line_length", "bytes")
_PLAIN = 1 << BITS
SIZE = _PLAIN + len(STATISTICS) * (STEPS + 1)


@dataclass(frozen=True)
class Model:
    """Intercept, linear weights and the factor vectors of all features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples in order of texts: distinct words with equal weights of total square 1, and the statistics."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    rows = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(flat, "")
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    forms, word = coded(flat)
    length = pc.utf8_length(forms).to_numpy()
    flag = lambda mask: mask.to_numpy(zero_copy_only=False).astype(float)
    count = lambda x=None: np.bincount(owner, x, minlength=rows)
    n = count()
    share = lambda x: x / np.maximum(n, 1)
    both = distinct_in(owner, word, max(len(forms), 1))
    who, what = both // max(len(forms), 1), both % max(len(forms), 1)
    distinct = np.bincount(who, minlength=rows)
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    line_lists = pc.split_pattern(texts, "\n")
    line_forms, line = coded(line_lists.flatten())
    line_owner = pc.list_parent_indices(line_lists).to_numpy().astype(np.int64)
    lines = np.bincount(line_owner, minlength=rows)
    distinct_lines = np.bincount(distinct_in(line_owner, line, max(len(line_forms), 1)) // max(len(line_forms), 1), minlength=rows)
    sizes = pc.binary_length(texts).to_numpy().astype(float)
    up = pc.and_(pc.utf8_is_upper(forms), pc.greater(pc.utf8_length(forms), 1))
    stats = np.stack([
        share(count(flag(up)[word])),
        share(count(flag(pc.match_substring_regex(forms, r"[^\p{L}\p{N}\p{M}.,;:?'’\"()\-]"))[word])),
        share(count(flag(pc.match_substring_regex(forms, r"\p{N}"))[word])),
        share(count(again)),
        1 - distinct / np.maximum(n, 1),
        1 - distinct_lines / np.maximum(lines, 1),
        np.minimum(share(count(length[word].astype(float))) / 20, 1),
        np.minimum(np.log1p(n) / 12, 1),
        np.minimum(np.log1p(lines) / 10, 1),
        np.minimum(np.log1p(sizes / np.maximum(lines, 1)) / 12, 1),
        np.minimum(np.log1p(sizes) / 16, 1),
    ], 1)
    k = len(STATISTICS)
    steps = np.minimum((stats * STEPS).astype(np.int64), STEPS - 1)
    number = np.fromiter((xxhash.xxh3_64_intdigest(w) & (_PLAIN - 1) for w in forms.to_pylist()), np.int64, len(forms))
    everyone = np.repeat(np.arange(rows), k)
    parts = [
        (who, number[what], 1 / np.sqrt(np.maximum(distinct, 1))[who]),
        (everyone, np.tile(_PLAIN + np.arange(k), rows), stats.ravel()),
        (everyone, (_PLAIN + k + np.arange(k) * STEPS + steps).ravel(), np.full(rows * k, 0.5)),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _values(model: Model, who: np.ndarray, what: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and the factor sums of each row. Pairs cost linear time: half of (square of the sum less the sum of squares)."""
    logit = model.bias + np.bincount(who, model.linear[what] * x, minlength=rows)
    sums = np.empty((rows, model.factors.shape[1]))
    for f in range(model.factors.shape[1]):
        vx = model.factors[what, f] * x
        sums[:, f] = np.bincount(who, vx, minlength=rows)
        logit += 0.5 * (sums[:, f] ** 2 - np.bincount(who, vx * vx, minlength=rows))
    return logit, sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass(frozen=True)
class Settings:
    """Factors of a feature, AdaGrad's epochs, rate and batch, and the penalty."""

    factors: int = 8
    epochs: int = 12
    rate: float = 0.1
    l2: float = 1e-4
    batch: int = 128


def _examples(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Feature numbers, values and truths of at most `rows` labelled rows, in order of ids, labels and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            who, what, x = features(part.column("text"))
            order = np.argsort(who, kind="stable")
            cut = np.searchsorted(who[order], np.arange(part.num_rows + 1))
            what, x = what[order].astype(np.uint32), x[order].astype(np.float32)
            pack = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pack(what), pack(x)], ["doc_id", "y", "what", "x"])

    known = gathered(sample(docs, labels, label, rows).mapInArrow(run, "doc_id long, y int, what binary, x binary"), "what", rows)
    examples = sorted(zip(*(known[c].to_pylist() for c in ("doc_id", "y", "what", "x"))))
    return [np.frombuffer(e[2], np.uint32) for e in examples], [np.frombuffer(e[3], np.float32) for e in examples], np.array([e[1] for e in examples], float)


def learn(what: list[np.ndarray], x: list[np.ndarray], truth: np.ndarray, settings: Settings = Settings()) -> Model:
    """A factorisation machine by AdaGrad over examples in a random order that is always the same. Without examples, every score is a half."""
    s = settings
    chance = np.random.default_rng(13)
    v = chance.normal(0, 0.05, (SIZE, s.factors))
    w = np.zeros(SIZE)
    if not len(what):
        return Model(0.0, w.astype(np.float32), np.zeros((SIZE, s.factors), np.float32))
    share = np.clip(truth.mean(), 1e-3, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, s.factors), 1e-2), 1e-2
    for _ in range(s.epochs):
        order = chance.permutation(len(what))
        for begin in range(0, len(order), s.batch):
            some = order[begin : begin + s.batch]
            who = np.repeat(np.arange(len(some)), [len(what[i]) for i in some])
            at, xs = np.concatenate([what[i] for i in some]).astype(np.int64), np.concatenate([x[i] for i in some]).astype(float)
            logit, sums = _values(Model(b, w, v), who, at, xs, len(some))
            error = (_sigmoid(logit) - truth[some]) / len(some)
            ex = error[who] * xs
            used, at = np.unique(at, return_inverse=True)
            g = np.bincount(at, ex, minlength=len(used)) + s.l2 * w[used]
            gw[used] += g * g
            w[used] -= s.rate * g / np.sqrt(gw[used])
            for f in range(s.factors):
                own = v[used, f]
                g = np.bincount(at, ex * (sums[who, f] - own[at] * xs), minlength=len(used)) + s.l2 * own
                gv[used, f] += g * g
                v[used, f] = own - s.rate * g / np.sqrt(gv[used, f])
            g = error.sum()
            gb += g * g
            b -= s.rate * g / np.sqrt(gb)
    return Model(float(b), w.astype(np.float32), v.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, settings: Settings = Settings()) -> Model:
    """Fit on at most `rows` labelled rows (see labelled.sample). Without any, every score is a half."""
    model = learn(*_examples(docs, labels, label, rows), settings)
    give_back()
    return model


def fold_losses(docs: DataFrame, labels: DataFrame, settings: Sequence[Settings], label: str = "quality", rows: int = SAMPLE_ROWS, folds: int = 3) -> list[float]:
    """The mean log loss of each settings over folds of the rows that may be learnt from; held-out rows play no part. The defaults were chosen by it."""
    what, x, truth = _examples(docs, labels, label, rows)
    fold = np.random.default_rng(3).integers(0, folds, len(what))
    out = []
    for s in settings:
        loss = 0.0
        for k in range(folds):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = learn([what[i] for i in rest], [x[i] for i in rest], truth[rest], s)
            who = np.repeat(np.arange(len(own)), [len(what[i]) for i in own])
            if len(own):
                logit, _ = _values(model, who, np.concatenate([what[i] for i in own]).astype(np.int64), np.concatenate([x[i] for i in own]).astype(float), len(own))
                p = np.clip(_sigmoid(logit), 1e-6, 1 - 1e-6)
                loss -= float(np.log(np.where(truth[own] > 0, p, 1 - p)).sum())
        out.append(loss / max(len(what), 1))
    return out


def score(docs: DataFrame, model: Model, extend: str | None = None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) for each row; or, if `extend` is a
    name that docs has no column of, all columns of docs and the score under that name.

    A null or empty text is scored by its statistics alone, a very long one whole. Repeated rows stay and
    score alike, so ties stay ties; an empty table gives none; other columns are ignored unless extended. The model has SIZE features, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))
    rows = docs if extend else documents(docs).select("doc_id", "text")
    kept = rows.columns if extend else ["doc_id"]
    schema = StructType([*(rows.schema[c] for c in kept), StructField(extend or "score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in slices(batches):
            logit, _ = _values(own, *features(batch.column("text")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(_sigmoid(logit))], names=[*kept, extend or "score"])

    return rows.mapInArrow(run, schema)


#: From this score on a document counts as good.
GOOD_FROM = 0.5


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of all documents, learnt from the labelled rows that aren't held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
