"""Periodic runs of words in a text: stretches that repeat their first q words again and again.

A run of period q and length L has L - q words in common with itself moved by q. With runs of
min_length words and min_exponent periods at least, that overlap is never below some k, so every word
of a run lies in a k-gram that the document repeats. Words outside repeated k-grams are
masked; what survives are segments, searched by the divide and conquer of Main and Lorentz: a
run that crosses a centre agrees with itself from there, one period ahead or behind, and is found by
longest common extensions at that centre for every period. All centres of one level, of all segments of a slice
of documents, are taken at once. Extensions are exact: they compare names of equal stretches of
1, 2, 4, ... words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tierlake.llm.runtime import documents, give_back, slices
from tierlake.llm.shingles import mix

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Pairs of a centre and a period tested at once.
_PAIRS = 1 << 19


def mask_width(min_length: int, min_exponent: int) -> int:
    """The least number of words that a run shares with itself one period later."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of all texts, where each text's words begin, and the end); words are `[^\\x20\\x09-\\x0D]+`."""
    if texts.offset:  # the splitting kernel misreads slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, owner = words.flatten(), pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat, owner = flat.filter(pa.array(full)), owner[full]
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def surviving(codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in their document. Grams are compared by 64-bit hashes: a collision lets more words survive and masks none."""
    n = len(codes)
    keep = np.zeros(n + 1, np.int64)
    if n < k:
        return keep[:n] > 0
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    h = owner[first].astype(np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[first + i].astype(np.uint64), i)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = first[twice]
    np.add.at(keep, at, 1)
    np.add.at(keep, at + k, -1)
    return np.cumsum(keep)[:n] > 0


class _Extensions:
    """Longest common extensions of pairs of places in a sequence, exact, by names of its stretches of 1, 2, 4, ... items."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.names = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
        width = 1
        while 2 * width <= self.n:
            last = self.names[-1]
            kinds = int(last.max()) + 1
            if kinds == len(last):  # all different: no two places agree that far
                break
            _, name = np.unique(last[:-width] * kinds + last[width:], return_inverse=True)
            self.names.append(name.astype(np.int64))
            width *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items from i on equal those from j on; i < j."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            fits = j < len(name)
            go = fits & (name[np.where(fits, i, 0)] == name[np.where(fits, j, 0)])
            step = np.where(go, width, 0)
            i, j, out = i + step, j + step, out + step
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items before i equal those before j; i < j."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            fits = i >= width
            go = fits & (name[np.where(fits, i - width, 0)] == name[np.where(fits, j - width, 0)])
            step = np.where(go, width, 0)
            i, j, out = i - step, j - step, out + step
        return out


def _crossing(x: np.ndarray, half: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q): places where a run of period q may hold the 2 q items from i on, just after or just before the centre of a block of 2 * half items.

    A run belongs to the largest block whose centre it crosses, so it is at most 2 * half long and q at
    most 2 * half / exponent; on its longer side of the centre it has two periods at least.
    """
    n, most = len(x), 2 * half // exponent
    for low in range(1, most + 1, _PAIRS):
        q = np.arange(low, min(low + _PAIRS, most + 1))
        centres = np.arange(half, n, 2 * half)
        step = max(1, _PAIRS // len(q))
        for c in range(0, len(centres), step):
            m = centres[c : c + step, None]
            for i in (m + 0 * q, m - 2 * q):
                a, b = np.nonzero((i >= 0) & (i + 2 * q <= n))
                at, period = i[a, b], q[b]
                hit = x[at] == x[at + period]
                at, period = at[hit], period[hit]
                hit = x[at + period - 1] == x[at + 2 * period - 1]
                yield at[hit], period[hit]


def runs(x: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of every maximal run in x with its smallest period, of min_length items and min_exponent periods at least, by start and period."""
    if min_exponent < MIN_EXPONENT:
        raise ValueError(f"runs of at least {MIN_EXPONENT} periods can be found")
    found, half, same = [np.zeros((0, 3), np.int64)], 2, None
    while half < len(x):
        for i, q in _crossing(x, half, min_exponent):
            if not len(i):
                continue
            same = same or _Extensions(x)
            start = i - same.behind(i, i + q)
            end = i + q + same.ahead(i, i + q)
            long = end - start >= np.maximum(min_length, min_exponent * q)
            found.append(np.stack([start, end - start, q], 1)[long])
        half *= 2
    out = np.concatenate(found)
    # of equal stretches the smallest period; the others are its multiples
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of_documents(codes: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, period) of the runs of all documents, start counted over all words: mask, cut into segments, search the segments together."""
    keep = surviving(codes, starts, mask_width(min_length, min_exponent))
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    owner = np.searchsorted(starts, at, side="right")
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) > 1) | (np.diff(owner) > 0)
    segment = np.cumsum(cut) - 1
    # a segment of its own between two others: an item that occurs nowhere else
    place = np.arange(len(at)) + segment
    x = np.full(int(place[-1]) + 1, -1, np.int64)
    x[place] = codes[at]
    walls = np.flatnonzero(x < 0)
    x[walls] = int(codes.max()) + 1 + np.arange(len(walls))
    out = runs(x, min_length, min_exponent)
    back = np.zeros(len(x), np.int64)
    back[place] = at
    out[:, 0] = back[out[:, 0]]
    return out


def planted(starts: np.ndarray, ids: list[int | None]) -> np.ndarray | None:
    """Which word stands where, after documents with crc32(doc_id) % 10 = 0 got a periodic end; None if all stay as they are."""
    out = None
    for k, name in enumerate(ids):
        a0, n = int(starts[k]), int(starts[k + 1] - starts[k])
        if name is None or not n or (h := zlib.crc32(str(name).encode())) % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out = np.arange(int(starts[-1])) if out is None else out
        out[a0 + a : a0 + n] = a0 + a + np.arange(n - a) % p
    return out


def _sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


_KINDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, plant: bool = False, texts: bool = True) -> DataFrame:
    """Each document's runs, the longest of them, and its text with every run cut down to one period.

    doc_id, n_runs, start, length, period, exponent_milli (of the longest run; ties to the smallest
    start, then period; null without a run), runs (by start, then period), collapsed (the words that no
    run holds beyond its first period, joined by one space), and SHA-256 of the runs as
    `start,length,period` lines and of collapsed. Both are long columns; texts=False leaves them null. With plant, documents whose id has a
    crc32 divisible by ten first get a periodic end, as a test of the search.

    A null or empty text, or one of white space only, has no words and no runs; whole texts are
    searched however long, in memory of a few hundred bytes for each surviving word. Each row is treated by
    itself, so nothing is shuffled: repeated rows, ties and null ids (never planted) get rows of
    their own, and an empty table gives none. Further columns, whatever their names, are ignored.
    """
    mask_width(min_length, min_exponent)
    if min_exponent < MIN_EXPONENT:
        raise ValueError(f"runs of at least {MIN_EXPONENT} periods can be found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _searched(batch, min_length, min_exponent, plant, texts)
        give_back()

    return documents(docs).mapInArrow(run, _KINDS)


def _searched(batch: pa.RecordBatch, min_length: int, min_exponent: int, plant: bool, texts: bool) -> pa.RecordBatch:
    flat, starts = split(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    moved = planted(starts, ids) if plant else None
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    if moved is not None:
        flat, codes = flat.take(pa.array(moved)), codes[moved]
    found = runs_of_documents(codes, starts, min_length, min_exponent)
    # a word goes if a run holds it after the run's first period
    drop = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(drop)[:-1] == 0
    kept = np.concatenate([[0], np.cumsum(stays)])[starts]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept), flat.filter(pa.array(stays))), pa.scalar(" ", pa.large_string()))
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    edges = np.searchsorted(owner, np.arange(len(ids) + 1))
    own = found.copy()
    own[:, 0] -= starts[owner]
    best = [None] * len(ids)
    lines = [""] * len(ids)
    lists: list[list | None] = [[] if texts else None for _ in ids]
    for k in np.unique(owner).tolist():
        rows = own[edges[k] : edges[k + 1]]
        best[k] = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]].tolist()
        lines[k] = "".join(f"{s},{n},{q}\n" for s, n, q in rows.tolist())
        if texts:
            lists[k] = [{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()]
    long = lambda values: pa.array(values, pa.int64())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    columns = {
        "doc_id": batch.column("doc_id"), "n_runs": long(np.diff(edges)),
        "start": long([b and b[0] for b in best]), "length": long([b and b[1] for b in best]), "period": long([b and b[2] for b in best]),
        "exponent_milli": long([b and 1000 * b[1] // b[2] for b in best]), "runs": pa.array(lists, kind),
        "collapsed": collapsed.cast(pa.string()) if texts else pa.nulls(len(ids), pa.string()),
        "runs_sha256": pa.array([_sha(t) for t in lines]), "collapsed_sha256": pa.array([_sha(t) for t in collapsed.cast(pa.large_binary()).to_pylist()]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the runs of all documents, after those with a crc32 divisible by ten got a periodic end."""
    out = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True, texts=False)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
