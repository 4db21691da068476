"""Exact top-k inner-product search by ball trees, branch and bound in each shard.

Candidates are dealt to the nearest of some pivots, and large clusters into shards of bounded
size, each searched through a ball tree of its own. A query first asks one shard of its most
promising cluster; the k-th score so far is a lower bound that the shards of the next wave share:
only clusters whose ball reaches it are asked. A node or cluster can be skipped for a query if
q.c + |q| r (centre c, radius r) is below the bound. Inside a shard the bound rises from leaf to leaf,
and a leaf finishes only the products that its dimensions of most spread don't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierlake.llm.runtime import Workspace, give_back

SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF_ROWS = 64
#: Most pivots; they and their clusters' balls travel to the driver and to each task.
PIVOTS = 1024
#: Clusters that are asked before the last wave.
NEAR = 3
_LONG = 2**63


class BallTree:
    """Nested balls over rows of x. Rows are reordered so that each node is a slice; children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes: dict[int, tuple[int, int, np.ndarray, float]] = {}
        todo = [(0, 0, len(x))]
        while todo:
            node, a, b = todo.pop()
            own = x[self.order[a:b]]
            centre = own.mean(0)
            away = own - centre
            far = np.einsum("ij,ij->i", away, away)
            self.nodes[node] = (a, b, centre, float(np.sqrt(far.max())) * (1 + 1e-12))
            if b - a > LEAF_ROWS:
                # along the line from the centre's farthest point; halves by rank, so equal points split too
                side = away @ away[int(far.argmax())]
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(side, half)]
                todo += [(2 * node + 1, a, a + half), (2 * node + 2, a + half, b)]

    def leaves(self, q: np.ndarray, size: np.ndarray, least: np.ndarray):
        """(slice, queries that it may matter for), the most promising leaf first; `least` may rise meanwhile."""
        everyone = np.arange(len(q))
        open_ = [(np.inf, 0, everyone)]
        while open_:
            at = max(range(len(open_)), key=lambda i: open_[i][0])
            _, node, who = open_.pop(at)
            a, b, centre, radius = self.nodes[node]
            bound = q[who] @ centre + size[who] * radius
            bound += 1e-9 * np.abs(bound) + 1e-6
            who = who[bound >= least[who]]
            if not len(who):
                continue
            if b - a <= LEAF_ROWS:
                yield a, b, who
                continue
            for child in (2 * node + 1, 2 * node + 2):
                _, _, centre, radius = self.nodes[child]
                bound = q[who] @ centre + size[who] * radius
                bound += 1e-9 * np.abs(bound) + 1e-6
                keep = bound >= least[who]
                if keep.any():
                    open_.append((float(bound[keep].max()), child, who[keep]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _bound(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with balls, rounded up."""
    out = q @ centre.T + np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * radius
    return out + 1e-9 * np.abs(out) + 1e-6


def _exactly(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their inner products are exact: doubles up to 2**53, then 64-bit and at last Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return q, x
    if most < 2**62:
        return q.astype(np.int64), x.astype(np.int64)
    return tuple(np.array([[int(v) for v in row] for row in y], object).reshape(y.shape) for y in (q, x))


#: Share of the dimensions, those that vary most, whose products are taken before a row may be skipped.
HEAD = 0.75
#: Fewer dimensions are multiplied at once.
HEAD_FROM = 16


class _Leaves:
    """The vectors of one shard as a ball tree, and of each vector the part that its leaf tests first.

    In many dimensions balls hardly tell vectors apart. So a leaf first takes the products over the
    head: the score is at most that and the product of the two rests' lengths, and only pairs that may reach the k-th
    score are finished. Dimensions are only put in another order, so scores stay exact.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.tree = BallTree(x)
        self.x, self.ids, self.rows = x[self.tree.order], ids[self.tree.order], rows[self.tree.order]
        d = x.shape[1]
        self.dims = np.argsort(-self.x.var(0), kind="stable")
        self.head = max(1, int(d * HEAD)) if d >= HEAD_FROM else d
        self.pairs = self.finished = 0

    def search(self, q: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple]]:
        """(score, -id) of the k best rows of each query that reach `least`, the best first; own: the rows that are the queries themselves."""
        exact_q, exact_x = _exactly(q, self.x)
        exact_q, exact_x, h = exact_q[:, self.dims], exact_x[:, self.dims], self.head
        rest = [np.sqrt(np.einsum("ij,ij->i", y[:, self.dims[h:]], y[:, self.dims[h:]])) * (1 + 1e-9) for y in (q, self.x)]
        best: list[list[tuple]] = [[] for _ in range(len(q))]
        self.pairs += len(q) * len(self.x)
        for a, b, who in self.tree.leaves(q, np.sqrt(np.einsum("ij,ij->i", q, q)), least):
            scores = exact_q[who, :h] @ exact_x[a:b, :h].T
            most = scores.astype(float) + rest[0][who][:, None] * rest[1][None, a:b]
            most += 1e-9 * np.abs(most) + 1e-6
            i, j = np.nonzero((most >= least[who][:, None]) & (own[who][:, None] != self.rows[None, a:b]))
            self.finished += len(i)
            if not len(i):
                continue
            score = scores[i, j] + (exact_q[who[i], h:] * exact_x[a + j, h:]).sum(1) if h < exact_q.shape[1] else scores[i, j]
            if score.dtype == object:
                score = np.minimum(np.maximum(score, -_LONG), _LONG - 1)
            hit = (score >= least[who[i]]).astype(bool)
            i, j, score = i[hit], j[hit], score[hit]
            for m in np.unique(i):
                mine = i == m
                row = best[who[m]]
                row += zip(score[mine].tolist(), (-self.ids[a + j[mine]]).tolist())
                row.sort(reverse=True)
                del row[k:]
                if len(row) == k:
                    worst = float(row[-1][0])
                    least[who[m]] = max(least[who[m]], worst - (1e-15 * abs(worst) if abs(worst) >= 2**53 else 0))
        return best


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if candidates.num_rows and queries.num_rows:
            shard = _Leaves(_matrix(candidates["v"]), candidates["vec_id"].to_numpy(), candidates["own"].to_numpy())
            shared = queries["kth"].to_numpy()
            # a score beyond 2**53 may have been rounded up
            least = np.where(np.isnan(shared), -np.inf, shared - 1e-15 * np.abs(shared))
            best = shard.search(_matrix(queries["q"]), queries["own"].to_numpy(), least, k)
            for key, name, row in zip(queries["key"].to_pylist(), queries["query_id"].to_pylist(), best):
                out[0] += [key] * len(row)
                out[1] += [name] * len(row)
                out[2] += [-i for _, i in row]
                out[3] += [int(v) for v, _ in row]
        give_back()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["key", "query_id", "vec_id", "score"])

    return run


class _TopK:
    """One search: vectors dealt to clusters, queries with keys of their own, and what was found so far."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int):
        self.k, self.space = k, Workspace(vectors.sparkSession, "top-k")
        fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        # what makes a row the query itself
        self.single = "row" in vectors.columns and "row" in queries.columns
        own = F.col("row" if self.single else "vec_id").cast("long").alias("own")
        clean = lambda df: df.select("vec_id", "v", own).where("vec_id is not null and size(v) > 0").where(fine).withColumn("dim", F.size("v"))
        self.queries = self.space.keep(clean(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "dim", "own", F.monotonically_increasing_id().alias("key")), "queries")
        vectors = clean(vectors)
        few = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).select("dim", "v").toArrow()
        # a cluster for each SHARD_ROWS rows at most, as smaller ones need more groups than they spare
        n = max(1, min(PIVOTS, -(-vectors.count() // SHARD_ROWS)))
        pivots: dict[int, np.ndarray] = {}
        for dim, v in zip(few["dim"].to_pylist()[:n], few["v"].to_pylist()[:n]):
            pivots.setdefault(dim, []).append(v)
        self.pivots = pivots = {d: np.unique(np.array(v, float), axis=0) for d, v in pivots.items()}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    own = batch.filter(pa.array(dims == dim))
                    x, p = _matrix(own.column("v")), pivots.get(int(dim))
                    if p is None:
                        at, far = np.full(len(x), -1), np.zeros(len(x))
                    else:
                        at = (x @ p.T - 0.5 * np.einsum("ij,ij->i", p, p)).argmax(1)
                        far = np.sqrt(np.einsum("ij,ij->i", x - p[at], x - p[at])) * (1 + 1e-12)
                    yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), own.column("own"), own.column("dim"), pa.array(at.astype(np.int32)), pa.array(far)], ["vec_id", "v", "own", "dim", "pivot", "far"])

        dealt = vectors.mapInArrow(deal, "vec_id long, v array<double>, own long, dim int, pivot int, far double")
        dealt = self.space.keep(dealt.withColumn("row", F.monotonically_increasing_id()), "vectors")
        sizes = dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        self.sizes = self.space.keep(sizes.withColumn("salts", F.ceil(F.col("n") / SHARD_ROWS).cast("long")), "sizes", narrow=True)
        self.vectors = dealt.join(self.sizes.select("dim", "pivot", "salts"), ["dim", "pivot"]).withColumn("salt", F.pmod("row", "salts")).select("vec_id", "v", "own", "dim", "pivot", "salt")
        # PIVOTS rows at most: clusters of lengths without a pivot are always asked
        self.radius = {(r.dim, r.pivot): r.radius for r in self.sizes.where("pivot >= 0").collect()}
        self.found: DataFrame | None = None

    def _asked(self, wave: int) -> DataFrame:
        """The queries of a wave for each shard: the first asks one shard of the most promising cluster, the second the NEAR best, the third all others that reach the k-th score."""
        pivots, radius = self.pivots, self.radius
        asking = self.queries.withColumn("kth", F.lit(None).cast("double"))
        if self.found is not None:
            order = Window.partitionBy("key").orderBy(F.desc("score"))
            kth = self.found.select("key", "score", F.row_number().over(order).alias("_r")).where(F.col("_r") == self.k).select("key", F.col("score").cast("double").alias("kth"))
            asking = self.queries.join(kth, "key", "left")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    own = batch.filter(pa.array(dims == dim))
                    p = pivots.get(int(dim))
                    if p is None:
                        who, at = np.arange(own.num_rows), np.full(own.num_rows, -1)
                        place = np.zeros(own.num_rows, np.int64)
                    else:
                        reach = np.array([radius.get((int(dim), i), -np.inf) for i in range(len(p))])
                        bounds = np.where(np.isinf(reach), -np.inf, _bound(_matrix(own.column("q")), p, np.where(np.isinf(reach), 0, reach)))
                        kth = own.column("kth").to_numpy(zero_copy_only=False).astype(float)
                        least = np.where(np.isnan(kth), -np.inf, kth - 1e-15 * np.abs(kth))
                        order = np.argsort(-bounds, axis=1, kind="stable")
                        ranked = np.take_along_axis(bounds, order, 1)
                        who, place = np.nonzero((ranked >= least[:, None]) & (ranked > -np.inf))
                        at = order[who, place]
                    if wave < 3:
                        use = place < (1 if wave == 1 else NEAR)
                    else:
                        use = place >= NEAR
                    who, at, place = who[use], at[use], place[use]
                    for i in range(0, len(who), 4096):
                        part = own.take(pa.array(who[i : i + 4096]))
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "query_id", "q", "own", "dim", "kth")), pa.array(at[i : i + 4096].astype(np.int32)), pa.array(place[i : i + 4096] == 0)], ["key", "query_id", "q", "own", "dim", "kth", "pivot", "home"])

        chosen = asking.mapInArrow(choose, "key long, query_id long, q array<double>, own long, dim int, kth double, pivot int, home boolean")
        chosen = chosen.join(self.sizes.select("dim", "pivot", "salts"), ["dim", "pivot"])
        first = F.pmod("key", "salts")
        if wave == 1:
            return chosen.withColumn("salt", first)
        return chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).where(~F.col("home") | (F.col("salt") != first))

    def ask(self, wave: int) -> None:
        shard = ["dim", "pivot", "salt"]
        asked, seen = self.space.noted(self._asked(wave).select("key", "query_id", "q", "own", "kth", *shard), "asked", rows=F.count(F.lit(1)))
        if not seen["rows"]:
            return
        blocks = asked.groupBy(*shard).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("long").alias("blocks"))
        asked = asked.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).drop("blocks")
        # a shard goes to as many groups as its queries fill, and to none if no query asks it
        near = self.vectors.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        run = _search(self.k)
        found = near.groupBy(*shard, "block").cogroup(asked.groupBy(*shard, "block")).applyInArrow(lambda a, b: run(a, b), "key long, query_id long, vec_id long, score long")
        new = self.space.keep(found, "found", narrow=True)
        self.found = new if self.found is None else self.found.union(new)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of `vectors` with the largest inner product, ties to the smaller vec_id.

    Both tables have vec_id (long) and v (array<double> of whole numbers). Scores are exact; one
    beyond 64 bits counts as the largest or smallest long. Each row is a candidate of
    its own, also where rows share a vec_id. Where both tables have a column `row` that numbers the rows, only the query's own row is no
    candidate, and each query row is ranked by itself; without it candidates with the query's vec_id are left out, and
    queries that share an id are ranked together. Rows with a null id or vector, or a vector with
    a null or non-finite component, take no part; vectors meet only those of their own length.
    Fewer than k candidates give fewer rows, an empty table none; other columns are ignored.
    """
    search = _TopK(vectors, queries, k)
    for wave in (1, 2, 3):
        search.ask(wave)
    if search.found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy(*(["key"] if search.single else ["query_id"])).orderBy(F.desc("score"), "vec_id")
    return search.found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the five nearest rows of every fiftieth vector."""
    whole = F.transform("embedding", lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double")).cast("double")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = Workspace(spark, "top-k").keep(rows, "rows")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
