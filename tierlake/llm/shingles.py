"""Word shingles of whole texts as 64-bit hashes, computed column-wise on Arrow batches.

A text is lower-cased (A-Z only) and cut into words at ASCII white space; each run of five
words is one shingle, a shorter text is one shingle as a whole, and a text without words
(null, empty or only white space) has no shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
# The odd constants of the splitmix64 finaliser and of a 64-bit polynomial hash.
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and the end)."""
    if texts.offset:  # the splitting kernel misreads slices
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat, owner = flat.filter(pa.array(full)), owner[full]
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not len(flat):
        return np.zeros(0, np.uint64), starts
    coded = pc.dictionary_encode(flat)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()], starts


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, text by text and sorted in each; where each text begins, and the end)."""
    words, starts = word_hashes(texts)
    counts = np.diff(starts)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    n_out = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    owner = np.repeat(np.arange(len(counts)), n_out)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(n_out)[:-1]]), n_out) + np.arange(int(n_out.sum()))
    span = np.minimum(counts, width)[owner]
    h = span.astype(np.uint64)
    for k in range(width):
        at = np.minimum(first + k, total - 1)
        h = np.where(k < span, mix(h * _BASE + words[at], k), h)
    ends = np.cumsum(n_out)
    for a, b in zip((ends - n_out).tolist(), ends.tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64)
