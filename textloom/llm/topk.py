"""Exact top-k inner products over norm buckets.

Vectors become integers, floor(scale * x), so that all scores are exact. A range shuffle puts the vectors in order of length, longest first,
and each task cuts its run into buckets of ``bucket`` vectors. Queries come in blocks of bounded size; a block is broadcast, and each task takes
the block through its buckets:

* A query's threshold is its k-th score so far; it starts with the k-th score in the bucket of the longest vectors.
* In a bucket of greatest length l, a vector reaches threshold t only at a cosine of t / (|q| l) or more. Above 1 the bucket is skipped.
* For a high local cosine the bucket is pruned by coordinates: the query's largest coordinates allow a narrow range of the vector's; the
  sorted lists of these coordinates give the candidates. For a low one it is pruned by length alone: candidates are the vectors long enough.
* Candidates are verified by their products.

A task returns at most k rows for each query, and the best k of these remain. Ties go to the smaller id.

Defined results: a vector that is null, empty or holds a null or a component that isn't finite takes no part, nor does a null id. Vectors are
compared with those of the same dimension. A query meets every row but those with its own id; repeated ids elsewhere count as rows of
their own. With fewer candidates than k all are returned. Scaled components must stay below 2**28, else the task fails. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches
from textloom.session import ship
from textloom.storage import materialise

SCALE = 1024
BUCKET = 2048
QUERIES_AT_ONCE = 8192
COORDINATES_FROM = 0.75
FOCUS = 4


def _scaled(scale: int):
    def make():
        def each(batch: pa.RecordBatch):
            ids, v = batch.column("id"), batch.column("v")
            offsets, flat = v.offsets.to_numpy().astype(np.int64), v.values.to_numpy(zero_copy_only=False).astype(float)  # a null component becomes NaN
            sizes = np.where(v.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.nonzero(sizes == dim)[0]
                m = flat[offsets[at][:, None] + np.arange(dim)]
                finite = np.isfinite(m).all(axis=1)
                at, m = at[finite], np.floor(scale * m[finite])
                if np.abs(m).max(initial=0) >= 1 << 28:
                    raise ValueError("a vector is too large to be scored exactly")
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(at), [None, pa.py_buffer(m.astype("<i4").tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), dim)), pa.array(np.sqrt((m * m).sum(axis=1))), raw], ["id", "dim", "norm", "raw"])

        return each

    return make


def _packed(limit: int):
    """Rows (id, dim, norm, raw) in order to rows of up to ``limit`` vectors of one dimension."""

    def run(batches):
        held: list[tuple] = []

        def closed():
            ids, dims, norms, raw = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dims[0]], pa.int64()), "top": pa.array([max(norms)]), "n": pa.array([len(ids)], pa.int64()), "ids": [np.array(ids, "<i8").tobytes()], "raw": [b"".join(raw)]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][1] != row[1] or len(held) >= limit):
                    yield closed()
                    held = []
                held.append(row)
        if held:
            yield closed()

    return run


PACKED = "dim bigint, top double, n bigint, ids binary, raw binary"


def _matrix(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["raw"], "<i4").reshape(row["n"], row["dim"]).astype(float)


def _exact(products: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Products as integers; below 2**53 doubles are exact, else they are made again in 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * m.shape[1] < 2.0**53:
        return products().astype(np.int64)
    return q.astype(np.int64) @ m.astype(np.int64).T


class Search:
    """Queries of one dimension with their best k so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norms = np.sqrt((q * q).sum(axis=1))
        self.least = np.full(len(ids), -np.inf)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        unit = np.where(self.norms[:, None] > 0, q / np.maximum(self.norms, 1)[:, None], 0)
        self.unit = unit
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]

    def floor(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Starts with the k-th scores in one bucket; its rows are not kept, they come again in their task."""
        if not len(self.ids) or not len(ids):
            return
        s = _exact(lambda: self.q @ m.T, self.q, m).astype(float)
        s[self.ids[:, None] == ids[None, :]] = -np.inf
        if len(ids) >= self.k:
            self.least = np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k]

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.least[i]) & (ids != self.ids[i])
        if hit.any():
            got = self.best[i] + list(zip((-scores[hit]).tolist(), ids[hit].tolist(), strict=True))
            got.sort()
            self.best[i] = got = got[: self.k]
            if len(got) == self.k:
                self.least[i] = max(self.least[i], -got[-1][0])

    def visit(self, ids: np.ndarray, m: np.ndarray) -> None:
        """One bucket, its vectors in descending order of length."""
        norms = np.sqrt((m * m).sum(axis=1))
        reach = self.norms * norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, self.least / reach, np.where(self.least > 0, np.inf, -np.inf)) * (1 - 1e-9)
        narrow = np.nonzero((cosine > COORDINATES_FROM) & (cosine <= 1))[0]
        wide = np.nonzero(cosine <= COORDINATES_FROM)[0]
        if len(narrow):
            unit = m / np.maximum(norms, 1e-300)[:, None]
            order: dict[int, np.ndarray] = {}
            for i in narrow:
                f = self.focus[i]
                c, u = cosine[i], self.unit[i, f]
                slack = np.sqrt((1 - c * c) * np.maximum(1 - u * u, 0)) + 1e-9
                # a vector's own length may ask for a higher cosine than the bucket's; the range for c holds them all
                low, high = np.where(u > 0, u * c - slack, -1.0), np.where(u < 0, u * c + slack, 1.0)
                spans = []
                for j, d in enumerate(f):
                    if d not in order:
                        order[d] = np.argsort(unit[:, d], kind="stable")
                    col = unit[order[d], d]
                    spans.append((np.searchsorted(col, low[j], "left"), np.searchsorted(col, high[j], "right")))
                j = min(range(len(f)), key=lambda j: spans[j][1] - spans[j][0])
                cand = order[f[j]][spans[j][0] : spans[j][1]]
                near = unit[cand][:, f]
                cand = cand[((near >= low) & (near <= high)).all(axis=1)]
                if len(cand):
                    part, one = m[cand], self.q[i][None]
                    self._take(i, ids[cand], _exact(lambda: one @ part.T, one, part)[0])  # noqa: B023
        if len(wide):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norms[wide] > 0, self.least[wide] / self.norms[wide], -np.inf) * (1 - 1e-9)
            long_enough = np.searchsorted(-norms, -need, side="right")
            part = m[: int(long_enough.max())]
            if len(part):
                q = self.q[wide]
                s = _exact(lambda: q @ part.T, q, part)
                for r, i in enumerate(wide):
                    self._take(i, ids[: len(part)], s[r])


def _visited(queries, k: int):
    def run(batches):
        searches = {}
        for dim, (ids, q, least) in queries.value.items():
            searches[dim] = Search(ids, q, k)
            searches[dim].least = least.copy()
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in searches:
                    searches[row["dim"]].visit(*_matrix(row))
        for s in searches.values():
            rows = [(int(q), v, -score) for q, best in zip(s.ids, s.best, strict=True) for score, v in best]
            if rows:
                q, v, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, bucket: int = BUCKET, queries_at_once: int = QUERIES_AT_ONCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its k best rows as query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = materialise(map_batches(rows, _scaled(scale), "id bigint, dim bigint, norm double, raw binary"), "topk-integers")
    ordered = whole.repartitionByRange(parts, "dim", F.col("norm").desc(), "id").sortWithinPartitions("dim", F.col("norm").desc(), "id")
    buckets = materialise(ordered.mapInArrow(_packed(bucket), PACKED), "topk-buckets")
    asked = whole.filter(F.col("id") % every == 0).distinct().repartitionByRange(parts, "dim", "id").sortWithinPartitions("dim", "id")
    asked = materialise(asked.mapInArrow(_packed(min(512, queries_at_once)), PACKED), "topk-queries").withColumn("block", F.monotonically_increasing_id())
    asked = materialise(asked, "topk-queries")
    # the longest vectors of each dimension: one bucket a dimension
    first = {r.dim: _matrix(r.asDict()) for r in buckets.withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("top"), "ids"))).filter("nth = 1").collect()} if asked.limit(1).count() else {}
    plan, size = [[]], 0
    for r in asked.select("block", "n").orderBy("block").collect():  # one number for each 512 queries
        if size + r.n > queries_at_once and plan[-1]:
            plan.append([])
            size = 0
        plan[-1].append(r.block)
        size += r.n
    found = None
    for group in plan:
        held: dict[int, list] = {}
        for r in asked.filter(F.col("block").isin(group)).collect() if group else []:
            held.setdefault(r.dim, []).append(_matrix(r.asDict()))
        sent = {}
        for dim, blocks in held.items():
            s = Search(np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]), k)
            s.floor(*first[dim])
            sent[dim] = (s.ids, s.q, s.least)
        part = buckets.mapInArrow(_visited(spark.sparkContext.broadcast(sent), k), "query_id bigint, vec_id bigint, score bigint")
        if len(plan) > 1:
            part = materialise(part, "topk-found")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
