"""Embedding whitening: moments by partition, merged pairwise, eigenvectors of the covariance, and a second pass that checks the result.

Every partition of the distinct vectors computes its count, its sums and its scatter around its own
mean; two such moments merge by the formula of Chan, Golub and LeVeque, which never subtracts
large numbers that nearly cancel. Moments are merged in a tree, so that the driver gets a few of
them, each of the size of one covariance matrix, and decomposes that. The second pass whitens
the distinct vectors and takes the moments of the outcome the same way: its covariance must be the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm.runtime import Workspace, give_back

#: Rows whose deviations and products are computed at once.
CHUNK = 4096
#: Levels of the tree that merges moments.
DEPTH = 3
_EXACT = 2**62


@dataclass
class Moments:
    """Count, sums (whole numbers of any size, or doubles) and scatter around the mean, of vectors of one length."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        total = x.sum(0) if x.dtype.kind == "f" or float(np.abs(x.astype(float)).max(initial=0)) * len(x) < _EXACT else x.astype(object).sum(0)
        total = np.array([int(t) if x.dtype.kind != "f" else float(t) for t in total], object)
        away = x.astype(float) - _ratio(total, len(x))
        return cls(len(x), total, away.T @ away)

    def merged(self, other: Moments) -> Moments:
        # the difference of the means as one fraction, so that whole sums lose nothing before the division
        apart = _ratio(other.total * self.n - self.total * other.n, self.n * other.n)
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / (self.n + other.n))
        return Moments(self.n + other.n, self.total + other.total, scatter)


def _ratio(total: np.ndarray, n: int) -> np.ndarray:
    """total / n as doubles; Python rounds the quotient of whole numbers of any size only once."""
    return np.array([t / n for t in total], float)


def _combined(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Moments by length of vector."""
    return a | {d: a[d].merged(m) if d in a else m for d, m in b.items()}


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of each length of vector in the batch, CHUNK rows at most."""
    column = batch.column("x")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        for i in range(0, len(at), CHUNK):
            own = column.take(pa.array(at[i : i + CHUNK]))
            yield at[i : i + CHUNK], own.flatten().to_numpy().reshape(len(own), int(d))


def moments(vectors: DataFrame, change=lambda x: x) -> dict[int, Moments]:
    """The moments of change(x) over the rows of vectors, by length of x (array<long>): locally for each partition, then by treeReduce."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, Moments] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                out = _combined(out, {x.shape[1]: Moments.of(change(x))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["part"])
        give_back()

    parts = vectors.select("x").mapInArrow(local, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return parts.treeReduce(_combined, DEPTH) if parts.getNumPartitions() else {}


@dataclass
class Whitening:
    """A fit for vectors of one length: sums over n distinct vectors, and components by falling eigenvalue."""

    n: int
    total: np.ndarray
    values: np.ndarray
    shares: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, m: Moments, k: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        # the sign that makes the largest entry positive, so that two runs agree
        peak = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[peak, np.arange(len(values))] < 0, -1.0, 1.0)
        trace = float(np.trace(m.scatter)) / m.n
        # what is left of a direction without spread is rounding
        spread = values > trace * len(m.total) * np.finfo(float).eps
        return cls(m.n, m.total, np.where(spread, values, np.nan), np.where(spread, values, 0.0) / trace if trace else np.zeros(len(values)), vectors)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components, over the root of their eigenvalues; NaN for a component without spread."""
        return (x.astype(float) - _ratio(self.total, self.n)) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - total)^2 of each row, exact; null beyond 38 digits."""
        most = self.n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(abs(int(t)) for t in self.total)
        if most * most * x.shape[1] < _EXACT:
            away = x * np.int64(self.n) - self.total.astype(np.int64)
            return pa.array(np.einsum("ij,ij->i", away, away)).cast(pa.decimal128(38, 0))
        away = x.astype(object) * self.n - self.total
        return pa.array([Decimal(s) if s < 10**38 else None for s in (int((row * row).sum()) for row in away)], pa.decimal128(38, 0))


def fit(vectors: DataFrame, k: int = 4) -> tuple[dict[int, Whitening], dict[int, float]]:
    """A Whitening for each length of the distinct vectors in x (array<long>), and the largest absolute entry of the whitened covariance minus the identity.

    Equal vectors count once, so a vector with any number of copies has the weight of one; they are folded before they are shuffled.
    """
    space = Workspace(vectors.sparkSession, "whitening")
    distinct = space.keep(vectors.select("x").distinct(), "distinct")
    fits = {d: Whitening.of(m, k) for d, m in moments(distinct).items()}
    again = {d: w for d, w in fits.items() if np.isfinite(w.values).any()}

    def change(x: np.ndarray) -> np.ndarray:
        if x.shape[1] not in again:
            return np.zeros((len(x), 1))
        y = again[x.shape[1]].whitened(x)
        return y[:, np.isfinite(y[0])]

    errors = {d: float(np.abs(m.scatter / m.n - np.eye(len(m.total))).max()) for d, m in moments(distinct, change).items() if d in again} if again else {}
    space.drop(distinct)
    return fits, errors


def clean(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vector is not null and has neither null nor non-finite entries, with x = floor(scale * entry) as array<long>; beyond 64 bits the nearest long."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(2**63)
    whole = lambda c: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), c.cast("double") * scale)))
    return rows.where(fine).withColumn("x", F.transform(vector, lambda c: whole(c).cast("long")))


def whiten(rows: DataFrame, k: int = 4) -> DataFrame:
    """For each row of rows (vec_id, x) and each of the first k components: n, deviation (decimal, exact; null beyond 38 digits), whitened, explained and identity_error.

    Vectors of different lengths are whitened apart, each by a fit of its own; a vector without
    entries has no component and so no row. A component without spread (copies of one vector, or fewer
    vectors than components) has null whitened and explained 0, and takes no part in identity_error, which
    is null if no component has any. Repeated rows and null ids get rows of their own; an empty table gives none.
    Further columns are ignored.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fits, errors = fit(rows, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for at, x in _by_length(batch):
                w = fits[x.shape[1]]
                y, m = w.whitened(x), len(w.values)
                ids, far = batch.column("vec_id").take(pa.array(at)), w.deviations(x)
                each = pa.array(np.repeat(np.arange(len(x)), m))
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, w.n, np.int64)), far.take(each),
                    pa.array(y.ravel(), from_pandas=True), pa.array(np.tile(w.shares, len(x))), pa.array([errors.get(x.shape[1])] * (len(x) * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all embeddings on the four strongest components; deviation_exact has what deviation can't hold."""
    out = whiten(clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return out.withColumn("deviation_exact", F.col("deviation").cast("string")).withColumn("deviation", F.col("deviation").try_cast("long"))
