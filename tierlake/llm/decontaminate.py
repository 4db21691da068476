"""Benchmark decontamination: every training passage queries a BM25 index of the benchmark by block-max WAND; hits are verified by overlap.

A passage is a window of words; each is a query of its distinct words. An item's score is
divided by the score that a passage wholly inside the item would get, so one threshold in (0, 1]
fits items of all lengths. A look at block maxima comes first, for all passages of a slice at
once: a passage whose terms' maxima add up to less than the threshold in every block of items
retrieves nothing; larger blocks are tried before smaller ones. The others walk the postings by
block-max WAND. A retrieved item counts as contained if enough of its question and of its answer
stand word by word in the document, in grams; or, as one changed word spoils most grams of a
short part, if question and answer follow each other in one place of the document with few
enough words changed, left out or put in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm.columns import coded
from tierlake.llm.runtime import Workspace, documents, slices
from tierlake.llm.shingles import mix

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FAR = 1 << 62


@dataclass(frozen=True)
class Settings:
    """window and stride of passages in words, BM25's k1 and b, retrieval and overlap thresholds, gram width, the share of a part's words that may be edited where it stands, items of the blocks (larger first; the last are the postings' blocks), items of an index, and the bytes of benchmark text that one pass takes."""

    window: int = 64
    stride: int = 32
    k1: float = 1.2
    b: float = 0.75
    retrieve: float = 0.4
    overlap: float = 0.5
    grams: int = 5
    edits: float = 0.4
    blocks: tuple[int, ...] = (8, 4)
    index_items: int = 512
    pass_bytes: int = 2_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, cut at ASCII characters other than letters and digits) and where each text begins, and the end."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _BETWEEN, " ")
    lists = pc.ascii_split_whitespace(plain)
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(flat, "")
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)
    if not len(flat):
        return np.zeros(0, np.uint64), bounds
    forms, index = coded(flat)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, forms.to_pylist()), np.uint64, len(forms))[index], bounds


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words."""
    n = len(words) - width + 1
    if n < 1 or not width:
        return np.zeros(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n], k)
    return np.unique(h)


def _edits(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each place between words, the fewest edits (a word changed, left out or put in) that make the part of a run of words which ends there."""
    places = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for word in part:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (words != word))
        row = np.minimum.accumulate(new - places) + places
    return row


def _stands(question: np.ndarray, answer: np.ndarray, words: np.ndarray, share: float) -> bool:
    """Whether question and answer follow each other in one place, each with at most `share` of its words edited."""
    most = [int(len(p) * share + 1e-9) for p in (question, answer)]
    item = np.concatenate([question, answer])
    hits = np.concatenate([[0], np.cumsum(np.isin(words, item))])
    # a place takes so many words at most, and so many of them are the item's
    span = min(len(item) + sum(most), len(words))
    full = hits[span:] - hits[: len(hits) - span] >= len(item) - sum(most)
    near = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(full)
    np.add.at(near, at, 1)
    np.add.at(near, at + span, -1)
    inside = np.concatenate([[0], np.cumsum(near)[:-1] > 0, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(inside))
    for a, b in zip(turns[::2], turns[1::2]):
        run = words[a:b]
        before = _edits(question, run) <= most[0]
        if before.any() and (before & (_edits(answer[::-1], run[::-1])[::-1] <= most[1])).any():
            return True
    return False


class Index:
    """Postings of some benchmark items: item numbers and normalised impacts by term, with the largest impact of each term and block."""

    def __init__(self, ids: list, texts: list[str], settings: Settings, statistics: tuple[int, float, dict[int, int]]):
        """ids: what tells an item, here its id and how many rows it has. statistics: of the whole benchmark, the number of items, their mean length and how many items have a word (1 if absent)."""
        self.settings = s = settings
        words, bounds = words_of(pa.array(texts, pa.large_string()))
        own = [words[a:b] for a, b in zip(bounds, bounds[1:])]
        keep = [i for i, w in enumerate(own) if len(w)]
        self.ids, own = [ids[i] for i in keep], [own[i] for i in keep]
        # the last quarter of an item's words is its answer
        self.parts, self.texts = [], []
        for w in own:
            cut = len(w) - max(1, len(w) // 4)
            self.texts.append((w[:cut], w[cut:]))
            self.parts.append([(width := min(s.grams, len(p)), _grams(p, width)) for p in (w[:cut], w[cut:])])
        n = len(own)
        terms, number = np.unique(np.concatenate(own), return_inverse=True) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sizes = np.array([len(w) for w in own], float)
        item = np.repeat(np.arange(n), sizes.astype(int))
        pair, tf = np.unique(number * max(n, 1) + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        everything, mean, rows = statistics
        df = np.fromiter((rows.get(t, 1) for t in terms.tolist()), float, len(terms))
        idf = np.log1p((everything - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * sizes[item] / max(mean, 1)))
        whole = np.bincount(item, impact, minlength=n) * np.minimum(1, s.window / np.maximum(sizes, 1))
        impact = impact / whole[item]
        self.terms, self.first = terms, np.searchsorted(term, np.arange(len(terms) + 1))
        self.items, self.impacts = item.tolist(), impact.tolist()
        self.bound = np.maximum.reduceat(impact, self.first[:-1]) if len(terms) else np.zeros(0)
        self.begins = self.first.tolist()
        # for each size of blocks the largest impact of each term in each block
        self.maxima = []
        for size in s.blocks:
            table = np.zeros((len(terms), -(-n // size)), np.float32)
            np.maximum.at(table, (term, item // size), impact)
            self.maxima.append(table)
        last = s.blocks[-1]
        self.blocks = []  # of each term: (last item, largest impact) of its blocks
        for a, b in zip(self.begins, self.begins[1:]):
            cuts = range(a, b, last)
            self.blocks.append([(self.items[min(c + last, b) - 1], max(self.impacts[c : min(c + last, b)])) for c in cuts])

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 for words of no item."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def search(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items with a score of at least `least`, for distinct term numbers."""
        items, impacts, bounds, blocks, size = self.items, self.impacts, self.bound, self.blocks, self.settings.blocks[-1]
        # a cursor: [current item, its place, end, term, first place]
        cursors = [[items[a], a, self.begins[t + 1], t, a] for t in query if (a := self.begins[t]) < self.begins[t + 1]]
        found = []

        def seek(c: list, item: int) -> None:
            at, end = c[1], c[2]
            while at < end and items[at] < item:
                at += 1
            c[1], c[0] = at, items[at] if at < end else _FAR

        while True:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                if c[0] == _FAR:
                    break
                total += bounds[c[3]]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            reach, total = _FAR, 0.0
            for c in cursors[: pivot + 1]:
                own, k = blocks[c[3]], (c[1] - c[4]) // size
                while k < len(own) and own[k][0] < item:
                    k += 1
                if k < len(own):
                    total += own[k][1]
                    reach = min(reach, own[k][0])
            if total < least:
                # nothing up to the end of these blocks, or to the next list, can reach the threshold
                after = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else _FAR
                skip = max(min(reach + 1, after), item + 1)
                for c in cursors[: pivot + 1]:
                    seek(c, skip)
            elif cursors[0][0] == item:
                value = 0.0
                for c in cursors[: pivot + 1]:
                    if c[0] == item:
                        value += impacts[c[1]]
                        seek(c, item + 1)
                if value >= least:
                    found.append((item, value))
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        seek(c, item)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, dict[int, float]]]:
        """(text, best score by item number) of the texts with a passage that retrieves something."""
        s = self.settings
        n = np.diff(bounds)
        passages = np.where(n > 0, np.maximum(-(-(n - s.window) // s.stride), 0) + 1, 0)
        owner = np.repeat(np.arange(len(n)), passages)
        ends = np.cumsum(passages)
        begin = bounds[owner] + (np.arange(len(owner)) - np.repeat(ends - passages, passages)) * s.stride
        size = np.minimum(bounds[owner + 1] - begin, s.window)
        least = s.retrieve - 1e-6
        hits: dict[int, dict[int, float]] = {}
        number = self.numbers(words)
        known = np.concatenate([[0], np.cumsum(number >= 0)])
        number = number[number >= 0]
        for first in range(0, len(begin), 4096):  # passages at once
            a, b = known[begin[first : first + 4096]], known[(begin + size)[first : first + 4096]]
            lens = b - a
            stop = np.cumsum(lens)
            passage = np.repeat(np.arange(len(a)), lens)
            both = np.unique(passage * len(self.terms) + number[np.repeat(a - (stop - lens), lens) + np.arange(int(lens.sum()))])
            passage, term = both // max(len(self.terms), 1), both % max(len(self.terms), 1)
            for table in self.maxima:
                if not len(passage):
                    break
                starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                good = np.add.reduceat(table[term], starts, axis=0).max(1) >= least
                keep = np.repeat(good, np.diff(np.append(starts, len(passage))))
                passage, term = passage[keep], term[keep]
            if len(passage):
                starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                for k, query in zip(passage[starts].tolist(), np.split(term, starts[1:])):
                    for item, value in self.search(query.tolist(), least):
                        best = hits.setdefault(int(owner[first + k]), {})
                        best[item] = max(value, best.get(item, 0.0))
        yield from hits.items()

    def verified(self, words: np.ndarray, found: dict[int, float]) -> Iterator[tuple[int, float, float, float, bool]]:
        """(item id, score, question overlap, answer overlap, whether only the edit rule tells so) of the items found that the words contain."""
        known: dict[int, np.ndarray] = {}
        for item, value in sorted(found.items()):
            shares = []
            for width, grams in self.parts[item]:
                if width not in known:
                    known[width] = _grams(words, width)
                shares.append(float(np.isin(grams, known[width], assume_unique=True).mean()) if len(grams) else 1.0)
            edited = min(shares) < self.settings.overlap
            if not edited or _stands(*self.texts[item], words, self.settings.edits):
                yield self.ids[item], value, *shares, edited


def _count_words(items: DataFrame) -> DataFrame:
    """item (number of an item's row), word (hash) for each distinct word of each item, and n, the item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, bounds = words_of(batch.column("text"))
            for a, b in zip(bounds, bounds[1:]):
                own = np.unique(words[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), b - a)), pa.array(np.arange(len(own)) == 0)], ["word", "n", "head"])

    return items.mapInArrow(run, "word long, n long, head boolean")


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, bm25, question_overlap, answer_overlap, edited for each document row and benchmark item that it contains.

    The benchmark goes in passes over the documents, each with at most about `pass_bytes` of its
    text in a broadcast (a single item is never cut); word statistics are those of the whole
    benchmark. An item's last quarter of words is taken as its answer, what stands before as its
    question. The overlaps are shares of grams; one is below `overlap` only where an edited item was
    found in one place (edited). Null or empty texts of either side, and items with a null id, match nothing;
    very long ones are matched whole, passage by passage; repeated rows are matched each; an item_id that occurs twice is two items; other columns are
    ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    words = _count_words(items)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, mean = words.where("head").agg(F.count("*"), F.avg("n")).first()
    often = words.groupBy("word").count().where("count > 1")
    passes = max(1, -(-total // settings.pass_bytes))
    rows, space = documents(docs), Workspace(spark, "decontamination")
    out = None
    for turn in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn)
        # repeated rows of an item are one entry of the index, and as many rows of the result
        some = mine.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("times")).orderBy("item_id", "text").collect()
        # no more than the distinct words of the pass's own texts
        df = {r["word"] % 2**64: r["count"] for r in often.join(_count_words(mine).select("word").distinct(), "word", "left_semi").collect()}
        groups = [some[i : i + settings.index_items] for i in range(0, len(some), settings.index_items)]
        shared = spark.sparkContext.broadcast([Index([(r.item_id, r.times) for r in g], [r.text for r in g], settings, (count, mean or 0.0, df)) for g in groups])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, most=1_000_000):
                words, bounds = words_of(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[i], item, *x) for index in shared.value for i, hits in index.candidates(words, bounds) for (item, times), *x in index.verified(words[bounds[i] : bounds[i + 1]], hits) for _ in range(times)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))], ["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap", "edited"])

        one = rows.mapInArrow(run, "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, edited boolean")
        if passes == 1:
            return one
        # a pass is written before the next one's index is made, so that one index at a time is held anywhere
        one = space.keep(one, "pass")
        shared.destroy()
        out = one if out is None else out.union(one)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all (document, benchmark item) pairs with enough of the item's question and answer in the document, gram by gram. Pairs that only the edit rule finds, whose overlaps are too small, are the operator's (and the pipeline's) but not this query's."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).where("not edited").select("doc_id", "item_id", F.round("question_overlap", 6).alias("question_overlap"), F.round("answer_overlap", 6).alias("answer_overlap"))


_SQL_WORD = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: By brute force, without the index: every gram of every item against every document.
ORACLE_SQL = f"""WITH items AS (SELECT item_id, regexp_extract_all({_SQL_LOWER}, {_SQL_WORD}) AS w FROM benchmark),
parts AS (
  SELECT item_id, 'q' AS part, w[:len(w) - greatest(1, len(w) // 4)] AS p FROM items WHERE len(w) > 0
  UNION ALL SELECT item_id, 'a', w[len(w) - greatest(1, len(w) // 4) + 1:] FROM items WHERE len(w) > 0),
wide AS (SELECT *, least(5, len(p)) AS k FROM parts WHERE len(p) > 0),
grams AS (SELECT DISTINCT item_id, part, k, array_to_string(p[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(p) - k + 2)) AS i FROM wide)),
sizes AS (SELECT item_id, part, count(*) AS n FROM grams GROUP BY ALL),
docs AS (SELECT doc_id, regexp_extract_all({_SQL_LOWER}, {_SQL_WORD}) AS w FROM documents),
found AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wide) WHERE len(w) >= k)),
both_parts AS (SELECT doc_id, item_id, part, count(*) AS c FROM found JOIN grams USING (k, g) GROUP BY ALL),
shares AS (SELECT doc_id, item_id, max(CASE WHEN part = 'q' THEN c * 1.0::DOUBLE / n END) AS q, max(CASE WHEN part = 'a' THEN c * 1.0::DOUBLE / n END) AS a FROM both_parts JOIN sizes USING (item_id, part) GROUP BY ALL)
SELECT doc_id, item_id, round(coalesce(q, 1.0), 6) AS question_overlap, round(a, 6) AS answer_overlap FROM shares
WHERE a >= 0.5 AND (q >= 0.5 OR NOT EXISTS (SELECT 1 FROM sizes z WHERE z.item_id = shares.item_id AND z.part = 'q'))"""
