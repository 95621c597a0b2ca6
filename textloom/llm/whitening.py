"""Whitening of embeddings by Chan's merging of centred moments.

1. Each task computes count, sums, mean and centred scatter of its vectors, batch by batch. Two such states are merged by the pairwise formula
   M = Ma + Mb + (mb - ma)(mb - ma)' na nb / (na + nb), in ``treeReduce``; sums and counts are integers, so the difference of the means is exact before it is rounded.
   A state has the size of the square of the dimension, whatever the number of rows.
2. The driver takes the covariance's eigenvectors.
3. A second pass whitens all rows and merges the moments of the results in the same way: their covariance must be the identity. If it isn't, the job stops.
4. A third pass returns the rows.

Vectors of one dimension are one fit. Each entry c becomes floor(scale * c) + shift first.

Defined results: rows whose vector is null, empty or holds a null or an entry that isn't finite are dropped; all others, null and repeated ids as well, are fitted and returned, one
by one. Directions without variance (an eigenvalue below 1e-12 of the largest) can't be scaled and give no component, so a single row, or equal rows, have none.
Scaled entries must stay below 2**52, else the task fails. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches
from textloom.llm.vectors import whole_vectors
from textloom.session import ship

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LARGEST = 2.0**52
#: Greatest difference between the covariance of what is returned and the identity.
TOLERANCE = 1e-4
FLAT = 1e-12


@dataclass
class Moments:
    """Count, sums (Python integers, or floats) and centred scatter of some vectors."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, m: np.ndarray, whole: bool) -> Moments:
        n = len(m)
        if whole:
            # in two halves, whose sums doubles hold exactly
            low = np.mod(m, 1 << 20)
            sums = np.array([int(x) + (int(y) << 20) for x, y in zip(low.sum(axis=0), ((m - low) / (1 << 20)).sum(axis=0), strict=True)], object)
            mean = np.array([float(s // n) for s in sums])
            rest = np.array([float(s % n) / n for s in sums])
            centred = (m - mean) - rest
        else:
            sums = m.sum(axis=0)
            centred = m - sums / n
        return cls(n, sums, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = np.array((other.sums * self.n - self.sums * other.n), dtype=float) / (float(self.n) * other.n)
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (float(self.n) * other.n / n))


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {dim: a[dim].merged(b[dim]) if dim in a and dim in b else a.get(dim) or b[dim] for dim in {*a, *b}}


def _moments(df: DataFrame, of_batch) -> dict[int, Moments]:
    """Moments by dimension, merged in each task, then pairwise by a tree of tasks. ``of_batch``: from a batch, pairs of dimension and moments."""
    import pickle

    def run(batches):
        state: dict[int, Moments] = {}
        for batch in batches:
            if batch.num_rows:
                state = reduce(_merged, ({dim: m} for dim, m in of_batch(batch)), state)
        if state:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(state)]})

    states = df.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    # an empty state first, as a table may have no rows
    return states.union(df.sparkSession.sparkContext.parallelize([{}], 1)).treeReduce(_merged, 3)


@dataclass
class Fit:
    """Of the vectors of one dimension: their number, sums, the unit eigenvectors in columns with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, m: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers if these hold all squares' sums, else Python's."""
        low, high = m.min(axis=0), m.max(axis=0)
        bound = max((max(abs(int(a) * self.n - s), abs(int(b) * self.n - s)) for a, b, s in zip(low, high, self.sums, strict=True)), default=0)
        if bound**2 * m.shape[1] < 1 << 63 and max(abs(s) for s in self.sums) < 1 << 62:
            return m.astype(np.int64) * self.n - self.sums.astype(np.int64)
        return np.array([[int(x) for x in row] for row in m], object) * self.n - self.sums

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ (self.vectors / np.sqrt(self.values))


def fit(moments: Moments, components: int) -> Fit:
    """Components in the order of falling eigenvalues, signs so that the entry of the greatest size is positive."""
    covariance = moments.scatter / moments.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    steep = values > max(FLAT * values[0], 0)
    values, vectors = values[steep], vectors[:, steep]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Fit(moments.n, moments.sums, vectors * sign, values, float(np.trace(covariance)))


def _rows(fits, scale: int, shift: int, errors: dict[int, float]):
    def make():
        held = fits.value

        def each(batch: pa.RecordBatch):
            for at, m in whole_vectors(batch.column("v"), scale, shift, LARGEST):
                f = held[m.shape[1]]
                k = len(f.values)
                deviations = f.deviations(m)
                squares = (deviations * deviations).sum(axis=1)
                squares = pa.array(squares) if squares.dtype != object else pa.array([str(x) for x in squares])
                lists = lambda values, n=len(at), k=k: pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k) if k else np.zeros(n + 1), pa.int32()), pa.array(values))
                columns = [batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), f.n)), squares.cast(pa.decimal128(38, 0)), lists(f.whitened(deviations).reshape(-1)), lists(np.tile(f.values / f.trace if k else f.values, len(at))), pa.array(np.full(len(at), errors[m.shape[1]]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "deviation", "whitened", "explained", "identity_error"])

        return each

    return make


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vector_col: str = "embedding") -> tuple[dict[int, Fit], dict[int, float]]:
    """The fit of each dimension, and its identity error: the largest entry of the whitened vectors' covariance minus the identity, from a pass over all of them."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    moments = _moments(rows, lambda batch: ((m.shape[1], Moments.of(m, True)) for _, m in whole_vectors(batch.column("v"), scale, shift, LARGEST)))
    fits = {dim: fit(m, components) for dim, m in moments.items()}
    if not fits:
        return {}, {}
    sent = vectors.sparkSession.sparkContext.broadcast(fits)

    def whitened(batch: pa.RecordBatch):
        for _, m in whole_vectors(batch.column("v"), scale, shift, LARGEST):
            f = sent.value[m.shape[1]]
            yield m.shape[1], Moments.of(f.whitened(f.deviations(m)), False)

    errors = {}
    for dim, m in _moments(rows, whitened).items():
        off = m.scatter / m.n - np.eye(len(m.scatter))
        errors[dim] = float(np.abs(off).max(initial=0))
        if errors[dim] > TOLERANCE:
            raise ArithmeticError(f"the covariance of the whitened vectors differs from the identity by {errors[dim]}")
    return fits, errors


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n, deviation (decimal), whitened and explained (arrays by component), identity_error."""
    spark = vectors.sparkSession
    fits, errors = fit_whitening(vectors, components, scale, shift, vector_col)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = map_batches(rows, _rows(spark.sparkContext.broadcast(fits), scale, shift, errors), "id bigint, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    return out.withColumnRenamed("id", "vec_id")


def whiten(vectors: DataFrame, **options) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows = whiten_vectors(vectors, **options)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
