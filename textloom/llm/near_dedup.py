"""Near-duplicates by MinHash, banding, signature verification and connected components.

1. Each text becomes the set of its word shingles (64-bit hashes) and a signature: for each of bands * rows universal hash functions
   the least value over the set. Documents with the same set (a 128-bit hash) are one node, so copies cost nothing further.
2. Each band of a signature is a key. A range shuffle puts the nodes of a key in order of a hash, and every ``block`` of them are a block, so no bucket
   lands in one task, whatever its size. Keys that one node alone has are dropped.
3. Forest: within each block, signatures are compared and a maximum spanning forest of those that look similar enough is kept: fewer
   links than nodes. They are confirmed on the full sets and give first components.
4. Rest: nodes of one bucket that still are in different components meet once more, within blocks and between them, now with their full sets.
   All pairs that look similar enough are tested there, the likeliest first, and a block returns only links that join
   components: fewer than its nodes, however many pairs nearly are links. Pairs inside a component need no test, for
   they can't change it, so no link that banding finds is lost.

A pair at the threshold is missed by banding with a chance of (1 - t ** rows) ** bands (7e-7 for 30 bands of 6 at 0.85, 3e-6 for 32 of 5 at 0.80), and by
the signature estimate, which may err by ``slack`` deviations, with 3.4e-6 and 2.8e-6 (exact binomial tails); at a similarity higher by 0.01 with 6e-7.

Defined results: null and empty texts have no shingles and are linked with nothing; texts shorter than a shingle are one shingle.
A null id is linked with nothing, its component is null and it stays. Rows that repeat an id are one node. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.chunks import parts
from textloom.llm.common import fresh, map_batches, tidy, word_hashes
from textloom.llm.components import components
from textloom.session import ship
from textloom.storage import materialise

SEED = 7
BLOCK = 256
SLACK = 5.0
SKETCH_BITS = 2
PART_BYTES = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text, without nulls, the sorted distinct hashes of its runs of ``size`` words; the whole sequence if it is shorter."""
    unique, codes, sizes = word_hashes(texts)
    h, out, at = unique[codes], [], 0
    for n in sizes.tolist():
        own, at = h[at : at + n], at + n
        acc = np.zeros(max(0, min(n, 1), n - size + 1), np.uint64)
        for i in range(min(size, n)):
            acc = (acc ^ own[i : i + len(acc)]) * _MIX
            acc ^= acc >> np.uint64(29)
        out.append(np.unique(acc))
    return out


def _family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift: universal on 32-bit values, results in the upper half."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    x = (shingles ^ (shingles >> np.uint64(32))) & np.uint64(0xFFFFFFFF)
    least = None
    for i in range(0, len(x), 512):
        m = (a * x[None, i : i + 512] + b).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return (least >> np.uint64(32)).astype(np.uint32)


def _pack(sig: np.ndarray) -> bytes:
    """Two bits of each minimum, 32 to a word."""
    two = np.zeros(-(-len(sig) // 32) * 32, np.uint64)
    two[: len(sig)] = sig & np.uint32(3)
    return (two.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).tobytes()


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band, which differs from band to band for equal rows too."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for column in sig.reshape(bands, -1).T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _signatures(shingle: int, bands: int, rows: int, seed: int):
    def make():
        family = _family(bands * rows, seed)

        def each(batch: pa.RecordBatch):
            n, k1, k2, keys, packed = [], [], [], [], []
            for s in (s for texts in parts(batch.column("text"), PART_BYTES) for s in shingle_sets(texts, shingle)):
                n.append(len(s))
                if not len(s):
                    for x in (k1, k2, keys, packed):
                        x.append(None)
                    continue
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                k1.append(int(d[0]))
                k2.append(int(d[1]))
                sig = signature(s, family)
                keys.append(_band_keys(sig, bands))
                packed.append(_pack(sig))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "keys", "packed"])

        return each

    return make


def _sets(shingle: int):
    def make():
        def each(batch: pa.RecordBatch):
            at = 0
            for texts in parts(batch.column("text"), PART_BYTES):
                sets = [np.sort(s.view(np.int64)) for s in shingle_sets(texts, shingle)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["id", "shingles"])
                at += len(sets)

        return each

    return make


_EVEN = np.uint64(0x5555555555555555)


def _similar(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Estimated Jaccard similarities of all rows of x with all of y, from two-bit sketches."""
    differ = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        d = x[:, k][:, None] ^ y[:, k][None, :]
        differ += np.bitwise_count((d | (d >> np.uint64(1))) & _EVEN)
    return 1 - differ / count * (1 + 1 / (2**SKETCH_BITS - 1))


def _forest(ids: np.ndarray, rows: np.ndarray, count: int, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of the pairs that look similar enough."""
    est = _similar(rows, rows, count)
    i, j = np.nonzero(np.triu(est >= least, 1))
    parent = list(range(len(ids)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    out = []
    for k in np.argsort(-est[i, j], kind="stable"):
        p, q = root(int(i[k])), root(int(j[k]))
        if p != q:
            parent[q] = p
            out.append((int(ids[i[k]]), int(ids[j[k]])))
            if len(out) == len(ids) - 1:
                break
    return out


def _joining(ids: np.ndarray, rows: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], count: int, least: float, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Confirmed links that join components; between the two sides if there are two."""
    may = (_similar(rows, rows, count) >= least) & (comp[:, None] != comp[None, :])
    if side.any():
        may &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(may, 1))
    parent = {c: c for c in comp.tolist()}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    out = []
    for k in np.argsort(-_pairwise(rows, i, j, count), kind="stable"):
        x, y = int(i[k]), int(j[k])
        p, q = root(int(comp[x])), root(int(comp[y]))
        if p == q:
            continue
        s, t = sets[x], sets[y]
        if denominator * min(len(s), len(t)) < numerator * max(len(s), len(t)):
            continue
        both = int((np.searchsorted(t, s, "right") > np.searchsorted(t, s, "left")).sum())
        if denominator * both >= numerator * (len(s) + len(t) - both):
            parent[q] = p
            out.append((int(ids[x]), int(ids[y])))
    return out


def _pairwise(rows: np.ndarray, i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    d = rows[i] ^ rows[j]
    return 1 - np.bitwise_count((d | (d >> np.uint64(1))) & _EVEN).sum(axis=1) / count * (1 + 1 / (2**SKETCH_BITS - 1))


def _blocks(df: DataFrame, work) -> DataFrame:
    """Pairs (a < b) that ``work`` finds in each block. Rows come ordered by their first column, key; a block is bounded, so one is held at a time."""

    def run(batches):
        held: list[tuple] = []

        def packed(found):
            found = {(min(p), max(p)) for p in found if p[0] != p[1]}
            if found:
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            cols = [_slices(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if held and held[0][0] != row[0]:
                    found += work(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            yield from packed(found)
        if len(held) > 1:
            yield from packed(work(held))
        tidy()

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, "key").sortWithinPartitions("key", "id").mapInArrow(run, "a bigint, b bigint").distinct()


def _in_blocks(size: int):
    """Rows ordered by key get the number of their block. A node that is alone with its key goes, unless it is the first or last of a task, where the key may go on elsewhere."""

    def run(batches):
        held: pa.RecordBatch | None = None
        task, nth, before = TaskContext.get().partitionId() << 32, 0, None

        def numbered(batch: pa.RecordBatch, last: bool):
            nonlocal nth, before
            key = batch.column("key").to_numpy()
            first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            sizes = np.diff(first, append=len(key))
            within = np.arange(len(key)) - np.repeat(first, sizes)
            blocks = nth + np.cumsum(within % size == 0) - 1
            nth = int(blocks[-1]) + 1
            alone = np.repeat(sizes == 1, sizes)
            alone[0] &= before is not None and key[0] != before
            alone[-1] &= not last
            before = key[-1]
            keep = pa.array(~alone)
            return pa.RecordBatch.from_arrays([batch.column("key").filter(keep), pa.array(task + blocks).filter(keep), batch.column("id").filter(keep)], ["key", "blk", "id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # what has the last key waits for the next batch, but whole blocks of it go
            key = batch.column("key").to_numpy()
            start = int(np.searchsorted(key, key[-1]))
            end = start + (len(key) - start) // size * size
            if end:
                yield numbered(batch.slice(0, end), False)
            held = batch.slice(end) if end < len(key) else None
        if held is not None:
            yield numbered(held, True)
        tidy()

    return run


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _arrays(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([h[1] for h in held], np.int64), np.frombuffer(b"".join(h[2] for h in held), np.uint64).reshape(len(held), -1)


def _confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose full sets reach the similarity numerator / denominator."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    union = F.size("s") + F.size("t") - both
    return pairs.join(x, "a").join(y, "b").filter(denominator * both >= numerator * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_dedup(docs: DataFrame, shingle: int = 5, numerator: int = 80, denominator: int = 100, bands: int = 32, rows: int = 5, seed: int = SEED, block: int = BLOCK, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that id)."""
    ship(docs.sparkSession)
    count, t = bands * rows, numerator / denominator
    agree = t + (1 - t) / 2**SKETCH_BITS
    least = t - slack * math.sqrt(agree * (1 - agree) / count) / (1 - 1 / 2**SKETCH_BITS)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(map_batches(texts, _signatures(shingle, bands, rows, seed), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, keys array<bigint>, packed binary"), "near-signatures")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = materialise(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "near-sets")
    nodes = full.join(reps.select(F.col("rep").alias("doc_id"), F.col("k1").alias("r1"), F.col("k2").alias("r2")), "doc_id").filter("k1 = r1 and k2 = r2")

    banded = nodes.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    order = ("key", F.xxhash64("id", "key"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = banded.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_in_blocks(block), "key bigint, blk bigint, id bigint")
    members = blocks.join(nodes.select(F.col("doc_id").alias("id"), "packed"), "id")
    members = materialise(members, "near-buckets")

    seen = members.select("id").distinct()
    sets = materialise(map_batches(texts.join(seen.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi"), _sets(shingle), "id bigint, shingles array<bigint>"), "near-shingles")

    inner = members.select(F.col("blk").alias("key"), "id", "packed")
    links = _confirmed(_blocks(inner, lambda held: _forest(*_arrays(held), count, least)), sets, numerator, denominator)
    links = materialise(links, "near-links")
    first = materialise(components(links), "near-components")

    labelled = members.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    # pairs of blocks of one key, and blocks with themselves, that hold several components; only a key that the first links leave in parts has any
    spans = materialise(labelled.groupBy("key", "blk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "near-blocks")
    open_ = spans.groupBy("key").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l < h").select("key")
    spans = spans.join(open_, "key")
    x, y = (spans.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("blk", "lo", "hi")]) for n in "xy")
    met = x.join(y, "key").filter("blk_x <= blk_y and least(lo_x, lo_y) < greatest(hi_x, hi_y)").select("blk_x", "blk_y", F.xxhash64("blk_x", "blk_y").alias("pair"))
    sides = met.select(F.col("blk_x").alias("blk"), "pair", F.lit(0).cast("bigint").alias("side")).union(met.filter("blk_x < blk_y").select("blk_y", "pair", F.lit(1).cast("bigint")))
    blocked = labelled.join(sides, "blk").join(sets, "id").select(F.col("pair").alias("key"), "id", "packed", "comp", "side", "shingles")

    def joining(held):
        return _joining(*_arrays(held), np.array([h[3] for h in held]), np.array([h[4] for h in held]), [h[5] for h in held], count, least, numerator, denominator)

    more = materialise(_blocks(blocked, joining).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
    # what the second step adds joins components, so only these go through the stars again
    named = lambda c: F.coalesce(F.col(c), F.col({"cu": "u", "cv": "v"}[c]))
    step = more.join(first.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(first.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    merged = components(step.select(named("cu").alias("u"), named("cv").alias("v"))).select(F.col("node").alias("m"), F.col("component").alias("top"))
    final = reps.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("base", F.coalesce("component", "rep")).join(merged, F.col("base") == F.col("m"), "left")
    final = final.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.coalesce("top", "base").alias("component"))
    linked = signed.filter("doc_id is not null").select("doc_id", "n_shingles", "k1", "k2")
    out = linked.join(final, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.union(signed.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of which one of each component stays, with their own columns."""
    (d,) = fresh(docs, "near_id")
    kept = near_dedup(docs, id_col=id_col, **options).filter("kept").select(F.col("doc_id").alias(d)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(d)), "left_semi")
