"""Hard negatives by a search over norm buckets.

Vectors become integers, floor(scale * x), so that scores are exact. A range shuffle puts them in order of length, longest first, and each task cuts its
run into buckets. Anchors come in blocks of bounded size. A block goes through all buckets twice:

* First for its positives: an anchor's running ``positives``-th score among rows of its label bounds what is still wanted.
* Then for its windows, one for each positive: from ``low`` percent of the positive's score up to that score. What is wanted must reach both the window's lower
  limit and its running ``negatives``-th score.

By Cauchy-Schwarz no vector of a bucket scores above |anchor| times the bucket's greatest length, so an anchor skips the buckets that can't reach its
limit, and where none of a block's anchors wants a bucket it isn't multiplied at all. In a bucket that some want, vectors too short for all of these are left out.
Limits start from the bucket of the longest vectors. A task returns at most k rows for each anchor or window, and the best k of all tasks remain.

Defined results: rows with a null id, a null label, or a vector that is null, empty or holds a null or a component that isn't finite take no part. Vectors meet those of the same
dimension. An anchor's positives are rows with other ids; rows that repeat an id count each, as positives and as negatives. Anchors that repeat
id, label and vector are one; those that differ in them are anchors of their own. Windows of a negative score are empty. Scaled components must stay below
2**28, else the task fails. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches
from textloom.llm.vectors import fixed_bytes, products, whole_vectors
from textloom.session import ship
from textloom.storage import materialise

SCALE = 256
BUCKET = 2048
ANCHORS_AT_ONCE = 8192

VECTORS = "id bigint, label bigint, dim bigint, norm double, raw binary"
PACKED = "dim bigint, top double, n bigint, ids binary, labels binary, raw binary"


def _scaled(scale: int):
    def make():
        def each(batch: pa.RecordBatch):
            for at, m in whole_vectors(batch.column("v"), scale):
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(where), batch.column("label").take(where), pa.array(np.full(len(at), m.shape[1])), pa.array(np.sqrt((m * m).sum(axis=1))), fixed_bytes(m, "<i4")], ["id", "label", "dim", "norm", "raw"])

        return each

    return make


def _packed(limit: int):
    """Rows of VECTORS in order to rows of up to ``limit`` vectors of one dimension."""

    def packed(rows: pa.Table):
        cells = lambda c: [rows.column(c).to_numpy().astype("<i8").tobytes()]
        return pa.RecordBatch.from_pydict({"dim": [rows.column("dim")[0].as_py()], "top": [max(rows.column("norm").to_pylist())], "n": [rows.num_rows], "ids": cells("id"), "labels": cells("label"), "raw": [b"".join(rows.column("raw").to_pylist())]})

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            dims = held.column("dim").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(dims))[0] + 1).tolist(), held.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                last = b == held.num_rows
                while b - a > limit or (b > a and not last):
                    n = min(limit, b - a)
                    yield packed(held.slice(a, n))
                    a += n
                if last:
                    held = held.slice(a).combine_chunks()
        if held is not None and held.num_rows:
            yield packed(held)

    return run


def _matrix(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["raw"], "<i4").reshape(row["n"], row["dim"]).astype(float)


class Wanted:
    """What some anchors look for: for each, rows of its own label or of others, scores from ``least`` to ``most``, the best k."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, k: int, same: bool, least: np.ndarray | None = None, most: np.ndarray | None = None):
        self.ids, self.labels, self.q, self.k, self.same = ids, labels, q, k, same
        self.norms = np.sqrt((q * q).sum(axis=1))
        none = np.full(len(ids), np.iinfo(np.int64).min)
        self.least = none if least is None else least.copy()
        self.most = np.full(len(ids), np.iinfo(np.int64).max) if most is None else most
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.multiplied = 0

    def _fits(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        own = self.labels[i][:, None] == labels[None, :]
        meant = own & (self.ids[i][:, None] != ids[None, :]) if self.same else ~own
        return meant & (scores >= self.least[i][:, None]) & (scores <= self.most[i][:, None])

    def start(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        """Raises the limits to the k-th scores in one bucket; its rows are not kept, they come again in their task."""
        everyone = np.arange(len(self.ids))
        scores = products(self.q, m)
        scores = np.where(self._fits(everyone, scores, ids, labels), scores, np.iinfo(np.int64).min)
        if len(ids) >= self.k and len(everyone):
            self.least = np.maximum(self.least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])

    def visit(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        """One bucket, its vectors in descending order of length."""
        lengths = np.sqrt((m * m).sum(axis=1))
        reach = self.norms * lengths[0] * (1 + 1e-9) + 1e-9
        i = np.nonzero(reach >= self.least)[0]
        if not len(i):
            return
        # the shortest vector that still can reach one of their limits; a limit of 0 or less is reached by all
        need = np.where(self.norms[i] > 0, (self.least[i] - 1e-9) / np.maximum(self.norms[i], 1e-300) * (1 - 1e-9), -np.inf)
        n = int(np.searchsorted(-lengths, -need.min(), side="right"))
        ids, labels, m = ids[:n], labels[:n], m[:n]
        self.multiplied += len(i) * n
        scores = products(self.q[i], m)
        row, col = np.nonzero(self._fits(i, scores, ids, labels))
        bounds = np.searchsorted(row, np.arange(len(i) + 1))
        for r in np.unique(row).tolist():
            c = col[bounds[r] : bounds[r + 1]]
            s, at = scores[r, c], i[r]
            if len(c) > 4 * self.k:
                kept = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                c, s = c[kept], s[kept]
            best = sorted([*self.best[at], *zip((-s).tolist(), ids[c].tolist(), strict=True)])[: self.k]
            self.best[at] = best
            if len(best) == self.k:
                self.least[at] = max(self.least[at], -best[-1][0])


def _visited(sent, k: int, same: bool):
    """All buckets of a task; ``sent``: for each dimension numbers, ids, labels, vectors and limits."""

    def run(batches):
        searches = {dim: (number, Wanted(ids, labels, q, k, same, least, most)) for dim, (number, ids, labels, q, least, most) in sent.value.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["dim"] in searches:
                    searches[row["dim"]][1].visit(*_matrix(row))
        for number, s in searches.values():
            rows = [(int(at), v, -score) for at, best in zip(number, s.best, strict=True) for score, v in best]
            if rows:
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["number", "other", "score"])

    return run


def _searched(buckets: DataFrame, searches: dict, first: dict, k: int, same: bool) -> DataFrame:
    """number, other, score, rank: the k best for each number."""
    sent = {}
    for dim, (number, ids, labels, q, least, most) in searches.items():
        s = Wanted(ids, labels, q, k, same, least, most)
        if dim in first:
            s.start(*first[dim])
        sent[dim] = (number, ids, labels, q, s.least, s.most)
    found = buckets.mapInArrow(_visited(buckets.sparkSession.sparkContext.broadcast(sent), k, same), "number bigint, other bigint, score bigint")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _windows(anchors: dict, positives: list, low: int, high: int) -> tuple[dict, list]:
    """A search for each positive of a block's anchors, and for each of these its anchor, place among the positives, id and score."""
    where = {n: (dim, i) for dim, (number, *_) in anchors.items() for i, n in enumerate(number.tolist())}
    out: dict[int, list] = {}
    known = []
    for r in positives:
        if r.score * low > r.score * high:
            continue  # a window of a negative score
        dim, i = where[r.number]
        _, ids, labels, q, _, _ = anchors[dim]
        least, most = -(-low * r.score // 100), high * r.score // 100
        out.setdefault(dim, []).append((len(known), ids[i], labels[i], q[i], least, most))
        known.append((len(known), int(ids[i]), r.rank, r.other, r.score))
    searches = {dim: tuple(np.array(c) for c in zip(*rows, strict=True)) for dim, rows in out.items()}
    return searches, known


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE, bucket: int = BUCKET,
    anchors_at_once: int = ANCHORS_AT_ONCE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each row whose id is divisible by ``every`` and each of its ``positives`` best rows of the same label: the best ``negatives`` rows of other labels whose scores are ``low`` to ``high`` percent of the positive's.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, positive_rank (from 1).
    """
    spark = vectors.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and label is not null")
    whole = materialise(map_batches(rows, _scaled(scale), VECTORS), "negatives-integers")
    order = ["dim", F.col("norm").desc(), "id", "label"]
    buckets = materialise(whole.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_packed(bucket), PACKED), "negatives-buckets")
    asked = whole.filter(F.col("id") % every == 0).distinct().repartitionByRange(parts, "dim", "id", "label").sortWithinPartitions("dim", "id", "label")
    asked = materialise(asked.mapInArrow(_packed(min(512, anchors_at_once)), PACKED), "negatives-anchors")
    asked = materialise(asked.withColumn("block", F.monotonically_increasing_id()), "negatives-anchors")
    # one bucket for each dimension, that of its longest vectors
    longest = Window.partitionBy("dim").orderBy(F.desc("top"), "ids")
    first = {r.dim: _matrix(r.asDict()) for r in buckets.withColumn("nth", F.row_number().over(longest)).filter("nth = 1").collect()}
    blocks, size = [[]], 0
    for r in asked.select("block", "n").orderBy("block").collect():  # a number for each 512 anchors
        if size + r.n > anchors_at_once and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(r.block)
        size += r.n
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, positive_rank int"
    out = None
    for block in filter(None, blocks):
        anchors, total = {}, 0
        for r in asked.filter(F.col("block").isin(block)).orderBy("block").collect():
            anchors.setdefault(r.dim, []).append(_matrix(r.asDict()))
        for dim, held in anchors.items():
            ids, labels, q = (np.concatenate(x) for x in zip(*held, strict=True))
            anchors[dim] = (total + np.arange(len(ids)), ids, labels, q, None, None)
            total += len(ids)
        near = _searched(buckets, anchors, first, positives, True).orderBy("number", "rank").collect()  # so many for each anchor of the block
        searches, known = _windows(anchors, near, low, high)
        if not known:
            continue
        found = _searched(buckets, searches, first, negatives, False)
        window = spark.createDataFrame(known, "number bigint, anchor_id bigint, positive_rank int, positive_id bigint, positive_score bigint")
        part = found.join(F.broadcast(window), "number").select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank")
        if len(blocks) > 1:
            part = materialise(part, "negatives-found")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
