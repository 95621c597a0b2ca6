"""A stored index of vectors, searched exactly by the cells that can hold an answer.

Vectors, scaled to unit length, are dealt to cells by the nearest of some centroids, which k-means finds on a sample of bounded size. The index keeps a folder for each cell, and for
each cell the greatest distance of its vectors from the centroid. By the triangle inequality no vector of a cell is nearer to a query than their
centroid's distance less that radius, which bounds its cosine from above. A search reads the cells nearest to each query first, takes from them the k-th best similarity, and then reads
only those other cells that may hold a better one. Spark prunes the other folders.

What a search returns is what ``retrieval.most_similar`` returns from a scan of all rows. Vectors that aren't near to each other in groups let it prune little.

Defined results: rows whose vector is null or zero, holds a null or isn't finite, or has another dimension than most take no part. Rows that repeat a key are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.splits import mark
from textloom.session import ship
from textloom.storage import materialise

#: Rows to find centroids on, the most cells, and how many cells each query reads first.
SAMPLE, MOST_CELLS, PROBES = 100_000, 4096, 2
QUERIES_AT_ONCE = 4096
#: Similarities are told to five places, and ties go by key.
ROUNDING = 1e-5


def _vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("bigint").alias("key"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter("key is not null and v is not null").filter(whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one dimension."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _centroids(sample: DataFrame, cells: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = sample.select(array_to_vector(F.transform("v", lambda x: x / norm)).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(unit)
    return np.array(model.clusterCenters())


@dataclass
class VectorIndex:
    """centroids by number of cell, radii and sizes as stored; ``cells_read`` and ``cells`` tell of the last search."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    key: str
    cells_read: int = field(default=0)

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 0) -> VectorIndex:
        """Writes an index below ``path``, which must not exist yet. Without ``cells`` their number is the root of that of the rows, at most 4096."""
        spark = rows.sparkSession
        v = _vectors(rows, key, vector)
        dims = v.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        dim, n = (dims[0].dim, dims[0].n) if dims else (0, 0)
        centroids = np.zeros((0, dim))
        if n:
            few = v.filter(F.size("v") == dim)
            if n > sample:
                few = few.filter(mark("key", seed) < int(sample / n * 2**60)).limit(sample)
            centroids = _centroids(few, cells or max(1, min(MOST_CELLS, round(n**0.5))), seed)
        table = [(k, [float(x) for x in c]) for k, c in enumerate(centroids)]
        spark.createDataFrame(table, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        spark.createDataFrame([(key, dim)], "key string, dim int").coalesce(1).write.parquet(f"{path}/about")
        index = cls(spark, path, centroids, np.zeros(len(centroids)), np.zeros(len(centroids), np.int64), key)
        index.append(rows, vector)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most 4096
        about = spark.read.parquet(f"{path}/about").first()
        index = cls(spark, path, np.array([r.centroid for r in rows]).reshape(len(rows), about.dim), np.zeros(len(rows)), np.zeros(len(rows), np.int64), about.key)
        index._measure()
        return index

    def _measure(self) -> None:
        for r in self.spark.read.parquet(f"{self.path}/radii").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():
            self.radii[r.cell], self.sizes[r.cell] = r.radius, r.n

    def append(self, rows: DataFrame, vector: str = "embedding") -> None:
        """Adds rows to the cells of the index; radii grow where they must. Cells are dealt to tasks in ranges of cell and key, so that a large one has several files."""
        ship(self.spark)
        v = _vectors(rows, self.key, vector).filter(F.size("v") == self.centroids.shape[1])
        sent = self.spark.sparkContext.broadcast(self.centroids)

        def placed(batches):
            c = sent.value
            for b in batches:
                if b.num_rows and len(c):
                    m = _matrix(b.column("v"))
                    near = np.empty(len(m), np.int32)
                    far = np.empty(len(m))
                    for at in range(0, len(m), 1024):
                        part = m[at : at + 1024]
                        d = np.maximum((part * part).sum(axis=1)[:, None] - 2 * part @ c.T + (c * c).sum(axis=1)[None, :], 0)
                        near[at : at + 1024] = d.argmin(axis=1)
                        far[at : at + 1024] = np.sqrt(((part - c[near[at : at + 1024]]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), pa.array(near), pa.array(far)], ["key", "v", "cell", "far"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        cells = materialise(v.mapInArrow(placed, "key bigint, v array<double>, cell int, far double"), "index-rows")
        cells.drop("far").repartitionByRange(parts, "cell", "key").write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")
        radii = cells.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        radii.coalesce(1).write.mode("append").parquet(f"{self.path}/radii")
        self._measure()

    def _found(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
        """Similarities of queries with the rows of the cells that are wanted for each; about k for each query and batch."""
        some = np.nonzero(wanted.any(axis=0))[0]
        self.cells_read += len(some)
        by_cell = {int(c): np.nonzero(wanted[:, c])[0] for c in some}
        sent = self.spark.sparkContext.broadcast((ids, q, by_cell))

        def scored(batches):
            ids, q, by_cell = sent.value
            for b in batches:
                cells, keys = b.column("cell").to_numpy(), b.column("key").to_numpy()
                for c in np.unique(cells).tolist():
                    at = np.nonzero(cells == c)[0]
                    asking = by_cell[c]
                    s = q[asking] @ _matrix(b.column("v").take(pa.array(at))).T
                    if exclude_self:
                        s[ids[asking][:, None] == keys[at][None, :]] = -np.inf
                    floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - ROUNDING if s.shape[1] > k else np.full(len(s), -2.0)
                    i, j = np.nonzero(s >= np.maximum(floor, -2)[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asking][i]), pa.array(keys[at][j]), pa.array(s[i, j])], ["query_id", "key", "similarity"])

        if not by_cell:
            return self.spark.createDataFrame([], "query_id bigint, key bigint, similarity double")
        stored = self.spark.read.schema("key bigint, v array<double>, cell int").parquet(f"{self.path}/cells").filter(F.col("cell").isin(list(by_cell)))
        return stored.mapInArrow(scored, "query_id bigint, key bigint, similarity double")

    def search(self, queries: DataFrame, k: int = 3, query_id: str = "query_id", vector: str = "embedding", exclude_self: bool = False, least: float = -2.0, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
        """The k best rows for each query: query_id, rank, the key, similarity (5 places); ties to the smaller key. With ``least``, only similarities of so much or more, and only cells that can hold them are read."""
        ship(self.spark)
        asked = materialise(_vectors(queries, query_id, vector).filter(F.size("v") == self.centroids.shape[1]), "index-queries")
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
        top = lambda df: df.withColumn("similarity", F.round("similarity", 5)).withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("similarity") >= least))
        blocks, out = max(1, -(-asked.count() // at_once)), None
        self.cells_read = 0
        for block in range(blocks):
            held = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).toArrow()
            ids = held.column("key").to_numpy()
            q = _matrix(held.column("v").combine_chunks()) if len(ids) else np.zeros((0, self.centroids.shape[1]))
            distance = np.sqrt(np.maximum(1 + (self.centroids**2).sum(axis=1)[None, :] - 2 * q @ self.centroids.T, 0))
            bound = 1 - np.maximum(distance - self.radii[None, :] - 1e-9, 0) ** 2 / 2
            full = np.broadcast_to(self.sizes > 0, bound.shape)
            first = np.zeros(bound.shape, bool)
            if bound.size:
                order = np.argsort(np.where(full, distance, np.inf), axis=1, kind="stable")[:, :PROBES]
                np.put_along_axis(first, order, True, axis=1)
            first &= full & (bound >= least - ROUNDING)
            found = materialise(top(self._found(ids, q, first, k, exclude_self)), "index-near")
            kth = {r.query_id: r.similarity for r in found.filter(F.col("rank") == k).collect()}  # a number for each query of the block
            limit = np.array([max(kth.get(i, -2.0), least) for i in ids.tolist()])
            rest = full & ~first & (bound >= limit[:, None] - ROUNDING) if len(ids) else first
            part = top(found.drop("rank").unionByName(self._found(ids, q, rest, k, exclude_self)))
            part = materialise(part, "index-found") if blocks > 1 else part
            out = part if out is None else out.unionByName(part)
        return out.select("query_id", "rank", F.col("key").alias(self.key), "similarity")
