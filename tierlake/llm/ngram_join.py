"""N-gram Jaccard join by universe partition: exact links between shingle sets, and their components.

Method. Sets fall into size bands; two sets that link lie in the same band or in neighbouring
ones. At a band whose largest set has U shingles, linked sets differ in at most
H = U * (1 - t) / t shingles. The universe of shingles is hashed into m > H segments; as H
differences spoil H segments at most, linked sets agree on m - H whole segments. A segment's
subset is one 64-bit key (a sum of scrambled hashes, so that taking an element away is one
subtraction).

Cost-based allocation: a set needs shares for H + 1 differences. A segment's subset gives one, a
subset with its one-deletion neighbourhood two, as it finds all sets that differ by one shingle
there; a segment may also give none. The cost of a share is the number of sets of other
components that it meets. Each set takes the cheapest single shares that make H + 1; where these
would meet more sets than the set has shingles, it takes the cheapest of single and double shares
instead, among the sets that have a group in common with it. A pair needs the shares of one of
its sets only: that of the smaller component, so the members of a large group of near copies
never look for each other again, nor for those that differ from them. Sets with less than H + 1
segments that aren't empty are looked for by all others, and use double shares among each other;
if even those are too few, they add the prefix of their sorted shingles.

Work in large groups of near copies: members of a key's group are first tested against its
smallest id, which brings most links together; only pairs that are in different components
after that are looked for by shares. What shares pair is compared by a parity sketch within the
join; it proves that most others differ too much, so only pairs near the threshold leave the join.
Every link is verified on the whole sets. Exact copies share one id (a digest of the set; if two
sets share it, both get another), and are never paired.

All links or components only: join and links test every pair that the shares ask for, so they
find each link of each set. components leaves out pairs whose sets are known to be in one
component already; it finds the same components, but not all links within them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.llm.components import connected
from tierlake.llm.runtime import Workspace, documents, slices
from tierlake.llm.shingles import WIDTH, mix, shingle_sets

#: Index entries (16 bytes) that a task takes at about.
BUCKET_ENTRIES = 750_000
#: Entries that a task holds before it drops repeated ones.
COMPACT_ENTRIES = 4_000_000
#: Entries that a task gathers before it deals them out.
FLUSH_ENTRIES = 1_000_000
#: Entries of a row at most, as rows of half a megabyte and more burden the JVM.
ROW_ENTRIES = 16_384
#: A set whose single shares would compare it with more than this times its shingles uses double shares, whose entries cost about as much.
DOUBLE_FROM = 1
#: Words of the sketch that pairs of a group are compared by.
FOLD = 16
#: Ids of wanted texts that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


class Bands:
    """The size bands and segment counts of a threshold."""

    def __init__(self, threshold: Fraction, spare: float = 0.12):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den = threshold.numerator, threshold.denominator
        upper = [1]
        while upper[-1] < 2**40:
            upper.append(max(upper[-1] + 1, upper[-1] * self.den // self.num))
        self.upper = np.array(upper, np.int64)
        self.most = self.upper * (self.den - self.num) // self.num  # H
        self.segments = np.where(self.most > 0, self.most + 2 + np.ceil((self.most + 1) * spare).astype(np.int64), 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upper, n, side="left")

    def linked(self, both: int, n: int, m: int) -> bool:
        return both * self.den >= self.num * (n + m - both)

    def too_far(self, differ: int, n: int, m: int) -> bool:
        """Whether sets of n and m elements that differ in so many or more can't link."""
        return differ * (self.den + self.num) > (n + m) * (self.den - self.num)


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; the empty set has 0."""
    out = []
    for seed in (101, 102):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h, seed), dtype=np.uint64)])
        out.append((mix(total[bounds[1:]] - total[bounds[:-1]], seed) * (np.diff(bounds) > 0)).view(np.int64))
    return out[0], out[1]


def _segments(h: np.ndarray, bounds: np.ndarray, bands: Bands):
    """The segments of all (set, band) pairs: owner set, band, first slot of each pair, and sum and size of each slot, slot of each shingle."""
    n = np.diff(bounds)
    own = bands.of(n)
    owner, level = [], []
    for down in (0, 1):
        at = own - down
        ok = np.flatnonzero((n > 0) & (at >= 0) & (bands.segments[np.maximum(at, 0)] > 0))
        owner.append(ok)
        level.append(at[ok])
    owner, level = np.concatenate(owner), np.concatenate(level)
    m = bands.segments[level]
    first = np.concatenate([[0], np.cumsum(m)])
    sizes = n[owner]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    pick = np.repeat(bounds[owner] - (ends - sizes), sizes) + np.arange(total)
    slot = np.repeat(first[:-1], sizes) + (mix(h[pick], 11) % np.repeat(m, sizes).astype(np.uint64)).astype(np.int64)
    sums = np.zeros(int(first[-1]), np.uint64)
    part = mix(h[pick], 13)
    np.add.at(sums, slot, part)
    return owner, level, first, sums, np.bincount(slot, minlength=len(sums)), slot, part


def _key(sums: np.ndarray, pair: np.ndarray, level: np.ndarray, first: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """A key of a subset, its band and its segment."""
    place = level[pair].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (slot - first[pair]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(sums + place, 17)


def _pieces(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of stretches of one bucket in a sorted array, of ROW_ENTRIES at most."""
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(begin, len(bucket)))
    cuts = -(-sizes // ROW_ENTRIES)
    ends = np.cumsum(cuts)
    begin = np.repeat(begin, cuts) + ROW_ENTRIES * (np.arange(int(ends[-1])) - np.repeat(ends - cuts, cuts))
    return begin, np.append(begin[1:], len(bucket))


class _Dealer:
    """Gathers (key, id, band) entries and gives them out as one row for each bucket."""

    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("levels", pa.binary()), ("runs", pa.binary())])
    ddl = "bucket int, keys binary, ids binary, levels binary, runs binary"

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, ids, levels.astype(np.uint8)))
        self.size += len(keys)
        if self.size >= FLUSH_ENTRIES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, ids, levels = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        bucket = ((keys >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, ids, levels = bucket[order], keys[order], ids[order], levels[order]
        begin, end = _pieces(bucket)
        present = bucket[begin]
        new = np.ones(len(keys), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (levels[1:] != levels[:-1])
        new[begin] = True
        runs = np.flatnonzero(new)
        counts = np.diff(np.append(runs, len(keys))).astype(np.uint32)
        r0, r1 = np.searchsorted(runs, begin), np.searchsorted(runs, end)
        cut = lambda x, a, b: [x[i:j].tobytes() for i, j in zip(a, b)]
        rows = [present.astype(np.int32), cut(keys, begin, end), cut(ids[runs], r0, r1), cut(levels[runs], r0, r1), cut(counts, r0, r1)]
        for i in range(0, len(present), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 64], t.type) for x, t in zip(rows, self.schema)], schema=self.schema)


def _once(keys: np.ndarray, ids: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries without those whose key and id came before."""
    order = np.lexsort((ids, keys))
    keys, ids, levels = keys[order], ids[order], levels[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    return keys[fresh], ids[fresh], levels[fresh]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of some buckets -> the groups of two or more ids that share a key, equal groups of a band once: gid, level, n_keys, id."""
    parts, held, most = [], 0, COMPACT_ENTRIES
    for batch in batches:
        for keys, ids, levels, runs in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            n = np.frombuffer(runs, np.uint32)
            parts.append((np.frombuffer(keys, np.uint64), np.repeat(np.frombuffer(ids, np.int64), n), np.repeat(np.frombuffer(levels, np.uint8), n)))
            held += len(parts[-1][0])
        if held > most:
            # a set that many tasks have read is held once
            parts = [_once(*(np.concatenate(x) for x in zip(*parts)))]
            held = len(parts[0][0])
            most = max(COMPACT_ENTRIES, 2 * held)
    if not parts:
        return
    keys, ids, levels = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    live = same[1:] | same[:-1]
    keys, order = keys[live], order[live]
    ids, levels = ids[order], levels[order]
    order = np.lexsort((ids, keys))
    keys, ids, levels = keys[order], ids[order], levels[order]
    if not len(keys):
        return
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids, levels = keys[fresh], ids[fresh], levels[fresh]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begin, len(keys)))
    gid = mix(np.add.reduceat(mix(ids.view(np.uint64), 23), begin) + levels[begin].astype(np.uint64), 29).view(np.int64)
    gid, first, n_keys = np.unique(np.where(sizes > 1, gid, 0), return_index=True, return_counts=True)
    keep = sizes[first] > 1
    gid, first, n_keys = gid[keep], first[keep], n_keys[keep]
    sizes = sizes[first]
    ends = np.cumsum(sizes)
    pick = np.repeat(begin[first] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    out = [np.repeat(gid, sizes), levels[pick].astype(np.int32), np.repeat(n_keys, sizes).astype(np.int64), ids[pick]]
    for i in range(0, len(pick), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in out], ["gid", "level", "n_keys", "id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of some buckets of double shares -> those under keys of two ids or more, one of which is probing, with the number of subsets (ones) and of deletions (twos) under the key."""
    parts = [[np.frombuffer(v, t) for v, t in zip(row, (np.uint64, np.int64, np.uint8, np.int64))] for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)))]
    if not parts:
        return
    keys, ids, levels, notes = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((notes, ids, keys))
    keys, ids, levels, notes = keys[order], ids[order], levels[order], notes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (notes[1:] != notes[:-1])
    keys, ids, levels, notes = keys[fresh], ids[fresh], levels[fresh], notes[fresh]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begin, len(keys)))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    live = (np.add.reduceat(new.astype(np.int64), begin) > 1) & (np.add.reduceat(notes & 1, begin) > 0)
    ones = np.add.reduceat(1 - (notes >> 2 & 1), begin)
    pick = np.repeat(live, sizes)
    ones, twos = np.repeat(ones, sizes)[pick], np.repeat(sizes - ones, sizes)[pick]
    keys, ids, levels, notes = keys[pick], ids[pick], levels[pick], notes[pick]
    out = [keys.view(np.int64), ids, levels.astype(np.int32), ((notes >> 3) - 1).astype(np.int32), ((notes >> 2 & 1) + 1).astype(np.int32), ((notes >> 1 & 1) + 1).astype(np.int32), (notes & 1).astype(bool), ones, twos]
    for i in range(0, len(keys), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in out], ["key", "id", "level", "segment", "share", "most", "probing", "ones", "twos"])


def _sketch(h: np.ndarray) -> bytes:
    """Parities of how many elements fall on each of 2**k >= 2 n bits (at least 1024); halves folded together give the next shorter sketch."""
    bits = 64 * FOLD
    while bits < 2 * len(h):
        bits *= 2
    odd = np.bincount((mix(h, 31) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes) -> np.ndarray:
    """The sketch of FOLD words."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.int64).reshape(-1, FOLD), axis=0)


def _sketch_distance(a: bytes, b: bytes) -> int:
    """At least so many elements are in one set only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class _Join:
    """One run of the join over a table of documents."""

    def __init__(self, docs: DataFrame, threshold: Fraction, width: int):
        self.spark, self.docs = docs.sparkSession, documents(docs)
        self.bands, self.width = Bands(threshold), width
        self.space = Workspace(self.spark, "ngram-join")
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.clashing = np.zeros(0, np.int64)

    # -- sets -----------------------------------------------------------------------------

    @staticmethod
    def _ids(h: np.ndarray, bounds: np.ndarray, clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each set and its second digest. Where two sets had one id, theirs come from the second digest."""
        one, two = _digests(h, bounds)
        if len(clashing):
            one = np.where(np.isin(one, clashing), mix(two.view(np.uint64), 7).view(np.int64), one)
        return one, two

    def _digested(self) -> DataFrame:
        bands, width, clashing, ids = self.bands, self.width, self.clashing, self._ids
        schema = "doc_id long, n_shingles long, id long, id2 long, level int, room long, units long, room_below long, units_below long, sketch binary, fold array<long>"
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                h, bounds = shingle_sets(batch.column("text"), width)
                rows = batch.num_rows
                owner, level, first, _, sizes, _, _ = _segments(h, bounds, bands)
                full, double = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes > 0, np.minimum(sizes, 2)))
                room, units = (c[first[1:]] - c[first[:-1]] - bands.most[level] for c in (full, double))
                own = bands.of(np.diff(bounds))
                columns = []
                for down in (0, 1):
                    here = level == own[owner] - down
                    for values in (room, units):
                        out, known = np.zeros(rows, np.int64), np.zeros(rows, bool)
                        out[owner[here]], known[owner[here]] = values[here], True
                        columns.append(pa.array(out, mask=~known))
                sketches = [_sketch(h[a:b]) for a, b in zip(bounds, bounds[1:])]
                folds = np.concatenate([_folded(x) for x in sketches])
                folds = pa.ListArray.from_arrays(pa.array(np.arange(0, FOLD * rows + 1, FOLD, dtype=np.int32)), pa.array(folds))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, ids(h, bounds, clashing)), pa.array(own.astype(np.int32)), *columns, pa.array(sketches, pa.binary()), folds], names)

        return self.docs.mapInArrow(run, schema)

    def prepare(self) -> int:
        """Write digests (a row for each document) and sets (one for each distinct set); returns how many shingles there are."""
        for _ in range(3):
            rows, total = self.space.noted(self._digested(), "digests", shingles=F.sum("n_shingles"))
            one = rows.where("n_shingles > 0").groupBy("id").agg(
                F.min("doc_id").alias("least"), F.min("id2").alias("low"), F.max("id2").alias("high"),
                *(F.any_value(c).alias(c) for c in ("n_shingles", "level", "room", "units", "room_below", "units_below", "sketch", "fold")),
            )
            sets, seen = self.space.noted(one.withColumnRenamed("n_shingles", "n"), "sets", clashes=F.count_if(F.col("low") != F.col("high")))
            self.digests, self.sets = rows.select("doc_id", "n_shingles", "id"), sets.drop("low", "high")
            if not seen["clashes"]:
                break
            # of 2**32 sets one pair is expected to share an id, so these are few whatever the input
            found = sets.where(F.col("low") != F.col("high")).select("id").toArrow()["id"].to_numpy()
            self.clashing = np.concatenate([self.clashing, found])
        else:
            raise RuntimeError("digests of sets go on clashing")
        return total["shingles"] or 0

    def rooms(self) -> DataFrame:
        """id, n, level, room (segments that aren't empty less H) and units (shares at most two a segment, less H), for both bands of a set."""
        here = F.struct("level", "room", "units")
        below = F.struct((F.col("level") - 1).alias("level"), F.col("room_below").alias("room"), F.col("units_below").alias("units"))
        return self.sets.select("id", "n", F.explode(F.array(here, below)).alias("_r")).select("id", "n", "_r.*").where("room is not null")

    def texts(self, wanted: DataFrame) -> tuple[DataFrame, int]:
        """The texts of one document of each wanted id (where doc_ids repeat or are null, of some more), and of how many doc_ids."""
        some, seen = self.space.noted(self.sets.join(wanted, "id", "left_semi").select("least").distinct(), "some", narrow=True, rows=F.count(F.lit(1)))
        # up to BROADCAST_IDS ids of 8 bytes travel to the executors; more are joined by a shuffle of the texts
        some = F.broadcast(some) if seen["rows"] <= BROADCAST_IDS else some
        return self.docs.join(some, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text"), seen["rows"]

    def blobs(self, wanted: DataFrame) -> DataFrame:
        """id and set (sorted hashes) of the wanted ids, once each."""
        width, clashing, ids = self.width, self.clashing, self._ids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                h, bounds = shingle_sets(batch.column("text"), width)
                yield pa.RecordBatch.from_arrays([pa.array(ids(h, bounds, clashing)[0]), pa.array([h[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["id", "set"])

        texts, expected = self.texts(wanted)
        found, seen = self.space.noted(texts.mapInArrow(run, "id long, set binary"), "blobs", rows=F.count(F.lit(1)))
        if seen["rows"] > expected:
            found = self.space.keep(found.groupBy("id").agg(F.any_value("set").alias("set")), "blobs")
        return found

    # -- shares of whole segments ---------------------------------------------------------

    def index(self, total: int) -> DataFrame:
        """The groups of sets with a segment in common: gid, level, id, n_keys."""
        bands, width, clashing, ids_of = self.bands, self.width, self.clashing, self._ids
        buckets = self._buckets(total // 2)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealer, seen = _Dealer(buckets), set()
            for batch in slices(batches):
                h, bounds = shingle_sets(batch.column("text"), width)
                ids, _ = ids_of(h, bounds, clashing)
                once = np.zeros(len(ids), bool)  # a task indexes a set once, however many copies it reads
                once[np.unique(ids, return_index=True)[1]] = True
                once &= np.fromiter((i not in seen for i in ids.tolist()), bool, len(ids))
                seen.update(ids[once].tolist())
                if not once.all():
                    sizes = np.diff(bounds)
                    h, ids, bounds = h[np.repeat(once, sizes)], ids[once], np.concatenate([[0], np.cumsum(sizes[once])])
                owner, level, first, sums, sizes, _, _ = _segments(h, bounds, bands)
                slot = np.flatnonzero(sizes)
                pair = np.searchsorted(first, slot, side="right") - 1
                yield from dealer.add(_key(sums[slot], pair, level, first, slot), ids[owner[pair]], level[pair])
            yield from dealer.flush()

        entries = self.docs.select("text").mapInArrow(run, _Dealer.ddl)
        found = entries.repartition(buckets, "bucket").mapInArrow(_groups, "gid long, level int, n_keys long, id long")
        return self.space.keep(found.groupBy("gid", "level", "id").agg(F.sum("n_keys").alias("n_keys")), "groups")

    def _buckets(self, entries: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BUCKET_ENTRIES))

    # -- pairs ----------------------------------------------------------------------------

    def verified(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """Those of the pairs (a, b) that link, and how many they are."""
        bands = self.bands

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not bands.too_far(max(abs(n - m), _sketch_distance(x, y)), n, m) for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")))]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    keep.append(bands.linked(int((y[at] == x).sum()), len(x), len(y)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def both(table: DataFrame, other: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
            for side, place in (("b", 1), ("a", 0)):
                table = table.join(other.select(F.col("id").alias(side), *(F.col(c).alias(names[place]) for c, names in columns.items())), side)
            return table

        some, seen = self.space.noted(both(pairs, self.sets, {"n": ("na", "nb"), "sketch": ("sa", "sb")}).mapInArrow(near, "a long, b long"), "near", narrow=True, rows=F.count(F.lit(1)))
        if not seen["rows"]:
            return some, 0
        blobs = self.blobs(some.select(F.col("a").alias("id")).union(some.select("b")).distinct())
        links, seen = self.space.noted(both(some, blobs, {"set": ("x", "y")}).mapInArrow(exact, "a long, b long"), "links", narrow=True, rows=F.count(F.lit(1)))
        self.space.drop(some, blobs)
        return links, seen["rows"]

    def test(self, pairs: DataFrame) -> None:
        """Verify the pairs (a, b) and merge what links."""
        pairs, seen = self.space.noted(pairs.distinct(), "pairs", narrow=True, rows=F.count(F.lit(1)))
        if seen["rows"]:
            new, found = self.verified(pairs)
            if found:
                self.links = new if self.links is None else self.links.union(new)
                roots = connected(self.links, self.space)
                sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
                self.roots = self.space.keep(roots.join(sizes, "root").select(F.col("node").alias("id"), "root", "size"), "roots", narrow=True)
        self.space.drop(pairs)

    def rooted(self, table: DataFrame) -> DataFrame:
        """table with the root and size of each id's component so far."""
        if self.roots is None:
            return table.withColumns({"root": F.col("id"), "size": F.lit(1).cast("long")})
        return table.join(self.roots, "id", "left").withColumns({"root": F.coalesce("root", "id"), "size": F.coalesce("size", F.lit(1))})

    def centred(self, groups: DataFrame) -> DataFrame:
        """Pairs of each group's members with its smallest id."""
        centres = groups.groupBy("gid").agg(F.min("id").alias("centre"))
        return groups.join(centres, "gid").where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))

    def met(self, probes: DataFrame, others: DataFrame, on: str, also: str) -> DataFrame:
        """Pairs of a probe and another entry under one key whose sketches don't prove that they differ too much."""
        num, den = self.bands.num, self.bands.den
        folds = self.sets.select("id", F.col("n").alias("_n"), F.col("fold").alias("_f"))
        x = probes.join(folds, "id").withColumnsRenamed({c: f"x_{c}" for c in ("id", "root", "size", "share", "upto", "_n", "_f") if c in [*probes.columns, "_n", "_f"]})
        y = others.join(folds, "id")
        differ = " + ".join(f"bit_count(_f[{i}] ^ x__f[{i}])" for i in range(FOLD))
        close = f"({differ}) * {den + num} <= (_n + x__n) * {den - num} and abs(_n - x__n) * {den + num} <= (_n + x__n) * {den - num}"
        return x.join(y, on).where(f"root <> x_root and ({also}) and {close}").select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b"))

    def allotted(self, groups: DataFrame) -> list[DataFrame]:
        """The pairs of different components that the shares ask for."""
        rooms = self.rooms()
        now = self.space.keep(self.rooted(groups.join(rooms.select("id", "level", "n", "room"), ["id", "level"])).withColumn("wide", F.col("room") < 1), "members")
        self.space.drop(groups)
        # a pair needs the shares of one of its sets: the one that isn't short of segments, else of the smaller component
        counts = now.groupBy("gid", "wide", "size", "root").agg(F.count("*").alias("own"))
        stats = counts.groupBy("gid").agg(F.sum("own").alias("all"), F.max(F.struct("wide", "size", "root")).alias("top")).where("top.wide or all > 1")
        costs = counts.join(stats, "gid").where("not wide and struct(wide, size, root) <> top and all > own").select("gid", "root", (F.col("all") - F.col("own")).alias("cost"))
        mine = Window.partitionBy("id", "level")
        upto = F.sum("n_keys").over(mine.orderBy("cost", "gid").rowsBetween(Window.unboundedPreceding, 0))
        # the groups of one set in one band: fewer than it has segments
        plan = now.where("not wide").join(costs, ["gid", "root"]).withColumn("need", F.sum("n_keys").over(mine) + 1 - F.col("room")).withColumn("used", (upto - F.col("n_keys") < F.col("need")))
        # single shares that would compare more sets than double shares need entries are exchanged for those
        plan = plan.withColumn("double", F.sum(F.when(F.col("used"), F.col("cost")).otherwise(0)).over(mine) > DOUBLE_FROM * F.col("n")).where("used or double")
        plan, seen = self.space.noted(plan.select("gid", "id", "level", "root", "size", "double"), "plan", narrow=True, single=F.count_if(~F.col("double")), double=F.count_if("double"))
        left: list[DataFrame] = []
        if seen["single"]:
            probes = plan.where("not double").select("gid", "id", "root", "size")
            others = now.join(probes.select("gid").distinct(), "gid", "left_semi").select("gid", "id", "wide", "root", "size")
            left.append(self.met(probes, others, "gid", "wide or struct(size, root) > struct(x_size, x_root)"))
        wide = rooms.where("room < 1").select("id", "level")
        hot = plan.where("double")
        some = now.join(hot.select("gid").distinct(), "gid", "left_semi").select("id", "level") if seen["double"] else None
        chosen = hot.select("id", "level").union(wide).distinct()
        others = wide if some is None else some.union(wide)
        universe = others.distinct().join(chosen.withColumn("probing", F.lit(True)), ["id", "level"], "left")
        universe, seen = self.space.noted(universe, "universe", narrow=True, rows=F.count(F.lit(1)))
        if seen["rows"]:
            left.append(self.doubled(universe, rooms))
        return left

    # -- double shares --------------------------------------------------------------------

    def doubled(self, universe: DataFrame, rooms: DataFrame) -> DataFrame:
        """Pairs of different components that the double shares of the probing (id, level) ask for within universe: id, level, probing."""
        bands, width, clashing, ids_of = self.bands, self.width, self.clashing, self._ids
        wanted = universe.groupBy("id").agg(F.max(F.struct("level", "probing")).alias("up"), F.min(F.struct("level", "probing")).alias("low"))
        # a shingle gives a deletion, and a segment of its own at most, for either band
        buckets = self._buckets(4 * (self.sets.join(wanted, "id", "left_semi").agg(F.sum("n")).first()[0] or 0))

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                deal: list[list[np.ndarray]] = [[] for _ in range(5)]
                for sid, blob, up, low in zip(*(batch.column(c).to_pylist() for c in ("id", "set", "up", "low"))):
                    h = np.frombuffer(blob, np.uint64)
                    asked = {x["level"]: bool(x["probing"]) for x in (up, low)}
                    _, level, first, sums, sizes, slot, part = _segments(h, np.array([0, len(h)]), bands)
                    for p, at in enumerate(level.tolist()):
                        if at not in asked:
                            continue
                        own = sizes[first[p] : first[p + 1]]
                        use = np.flatnonzero(own) + first[p]
                        mine = (slot >= first[p]) & (slot < first[p + 1]) & (sizes[slot] > 1)
                        places, takes = np.concatenate([use, slot[mine]]), np.concatenate([np.zeros(len(use), np.uint64), part[mine]])
                        keys = _key(sums[places] - takes, np.full(len(places), p), level, first, places)
                        share = np.repeat([1, 2], [len(use), int(mine.sum())])
                        segment, most = places - first[p], np.minimum(sizes[places], 2)
                        if np.minimum(own, 2).sum() <= bands.most[at]:
                            rest = h[: len(h) - -(-len(h) * bands.num // bands.den) + 1]
                            keys, share = np.concatenate([keys, mix(rest, 37)]), np.concatenate([share, np.ones(len(rest), np.int64)])
                            segment, most = np.concatenate([segment, np.full(len(rest), -1)]), np.concatenate([most, np.ones(len(rest), np.int64)])
                        # segment, then two bits each for the share and the most, one for probing
                        note = ((segment + 1) << 3 | (share - 1) << 2 | (most - 1) << 1 | asked[at]).astype(np.int64)
                        for column, value in zip(deal, (keys, np.full(len(keys), sid, np.int64), np.full(len(keys), at, np.uint8), note)):
                            column.append(value)
                if deal[0]:
                    keys, sids, levels, notes = (np.concatenate(c) for c in deal[:4])
                    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    begin, end = _pieces(bucket[order])
                    present = bucket[order][begin]
                    cut = lambda x: pa.array([x[order[i:j]].tobytes() for i, j in zip(begin, end)], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), cut(keys), cut(sids), cut(levels), cut(notes)], ["bucket", "keys", "ids", "levels", "notes"])

        blobs = self.blobs(wanted.select("id")).join(wanted, "id")
        entries = blobs.mapInArrow(index, "bucket int, keys binary, ids binary, levels binary, notes binary")
        shared = entries.repartition(buckets, "bucket").mapInArrow(_shared, "key long, id long, level int, segment int, share int, most int, probing boolean, ones long, twos long")
        shared = self.space.keep(shared, "shared")
        # what an entry meets: a subset meets equal subsets; a double share also those one deletion away
        cost = shared.where("probing").groupBy("id", "level", "segment").agg(
            F.sum(F.when(F.col("share") == 1, F.col("ones") - 1).otherwise(0)).alias("one"),
            F.sum(F.when(F.col("share") == 1, F.col("ones") - 1 + F.col("twos")).otherwise(F.col("ones"))).alias("two"),
            F.max("most").alias("most"),
        )
        # the segments of one set in one band: fewer than it has shingles
        plans = universe.where("probing").select("id", "level").join(rooms.select("id", "level", "units"), ["id", "level"]).join(cost.groupBy("id", "level").agg(F.collect_list(F.struct("segment", "one", "two", "most")).alias("segments")), ["id", "level"])

        def allot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list[int]] = [[], [], [], []]
                for sid, level, units, segments in zip(*(batch.column(c).to_pylist() for c in ("id", "level", "units", "segments"))):
                    # segments that meet nothing give all their shares for nothing
                    need = 1 - (units - sum(x["most"] for x in segments if x["segment"] >= 0))
                    offers = []
                    for x in segments:
                        if x["segment"] >= 0:
                            offers.append((x["one"], 1, x["segment"]))
                            if x["most"] > 1:
                                offers.append((max(x["two"] - x["one"], x["one"]), 2, x["segment"]))
                    chosen: dict[int, int] = {}
                    for _, share, segment in sorted(offers)[: max(need, 0)]:
                        chosen[segment] = max(share, chosen.get(segment, 0))
                    if any(x["segment"] < 0 for x in segments):
                        chosen[-1] = 1
                    for s, v in chosen.items():
                        for column, value in zip(out, (sid, level, s, v)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["id", "level", "segment", "upto"])

        chosen = plans.mapInArrow(allot, "id long, level int, segment int, upto int")
        probes = shared.where("probing").join(chosen, ["id", "level", "segment"]).where("share <= upto and (ones > 1 or upto > 1)").select("key", "id", "share", "upto")
        probes = self.space.keep(self.rooted(probes), "probes", narrow=True)
        others = self.rooted(shared.join(probes.select("key").distinct(), "key", "left_semi").select("key", "id", "share"))
        return self.met(probes, others, "key", "share = 1 and x_share = 1 or x_upto = 2 and share + x_share < 4")

    # -- results --------------------------------------------------------------------------

    def run(self, complete: bool) -> None:
        """Find links: all if complete, otherwise as many as the components need."""
        total = self.prepare()
        groups = self.index(total)
        if not complete:
            self.test(self.centred(groups))
        # without roots each set is its own component, and no pair is left out
        left = self.allotted(groups)
        if left:
            self.test(reduce(DataFrame.union, left))

    def classes(self) -> DataFrame:
        """Each set's id, class_id, component_id and n_links (of the links found)."""
        named = self.sets.select("id", F.col("least").alias("class_id"))
        if self.links is None:
            return named.withColumns({"component_id": F.col("class_id"), "n_links": F.lit(0).cast("long")})
        degree = self.links.select(F.col("a").alias("id")).union(self.links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
        linked = self.space.keep(self.roots.join(degree, "id", "left").join(named, "id"), "named")
        least = self.space.keep(linked.groupBy("root").agg(F.min("class_id").alias("component_id")), "least")
        linked = linked.join(least, "root").select("id", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.lit(True).alias("_linked"))
        named = named.join(linked, "id", "left").select("id", "class_id", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("class_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.space.keep(named, "components")

    def documents(self) -> DataFrame:
        one = F.col("n_shingles") > 0
        return self.digests.join(self.classes(), "id", "left").select(
            "doc_id", "n_shingles", F.when(one, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(one, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(one, F.col("n_links")).otherwise(F.lit(0)).alias("n_links")
        )

    def pairs(self) -> DataFrame:
        """class_a, class_b of the links found."""
        sets = self.sets.select("id", F.col("least").alias("class_id"))
        links = self.links if self.links is not None else self.spark.createDataFrame([], "a long, b long")
        for side in ("a", "b"):
            links = links.join(sets.select(F.col("id").alias(side), F.col("class_id").alias(f"class_{side}")), side)
        first = F.coalesce(F.col("class_a") < F.col("class_b"), F.col("class_a").isNotNull())
        return links.select(F.when(first, F.col("class_a")).otherwise(F.col("class_b")).alias("class_a"), F.when(first, F.col("class_b")).otherwise(F.col("class_a")).alias("class_b"))


def join(docs: DataFrame, threshold: str | Fraction = "4/5", width: int = WIDTH) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, class_id, n_links.

    component_id is the smallest doc_id reachable over links (Jaccard similarity of the shingle
    sets at or above the threshold), class_id the smallest doc_id with the same set, and n_links
    the number of other classes that this class links with; all links are found and verified, so
    the work grows with their number. Texts that are null or without words have no shingle, link
    with nothing and get their own doc_id. Very long texts are sets like others, taken whole.
    Repeated rows are rows of one class. A null doc_id takes part like others, and is reported as
    component only where no row of the component has an id. An empty table gives no rows. Extra
    columns are ignored.
    """
    run = _Join(docs, Fraction(threshold), width)
    run.run(complete=True)
    return run.documents()


def links(docs: DataFrame, threshold: str | Fraction = "4/5", width: int = WIDTH) -> DataFrame:
    """class_a, class_b: all pairs of classes that link, once each, the smaller class_id first (a null one last)."""
    run = _Join(docs, Fraction(threshold), width)
    run.run(complete=True)
    return run.pairs()


def components(docs: DataFrame, threshold: str | Fraction = "4/5", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id as join gives them, without the work of links that change no component."""
    run = _Join(docs, Fraction(threshold), width)
    run.run(complete=False)
    return run.documents().drop("n_links")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: components of all documents at a similarity of 0.8 on shingles of five words."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


_SQL_WORDS = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other)"""

ORACLE_SQL = f"""WITH RECURSIVE {_SQL_WORDS}
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id"""
