"""Near-duplicate code by exact Jaccard similarity of token sets.

The join is exact: documents are posted under adaptive prefixes (``token_index``), and pairs that meet are verified on the full sets. ``mode="lsh"`` finds candidates by
banded MinHash signatures instead and may miss pairs: at its threshold one in twenty at most, above it fewer.

Documents with the same token set are one node of the join, so copies don't multiply the pairs. Stars keep large groups of near copies cheap: a few bands bring
each node together with the smallest of its bucket, its hub, if the two are similar. ``first_seen`` needs no more of such nodes; ``similar_pairs`` compares the members of a
star with each other in blocks, so their sets are shuffled once for each block, not once for each pair, and leaves only pairs across stars to the index.

Defined results: documents below the gate of ``MIN_TOKENS`` tokens, null texts among them, resemble nothing. Rows with a null id take no part; ``first_seen`` and ``extremes`` keep them.
Rows that repeat an id: equal token sets are one node, each other set is a node of its own, and sets of one id are no copies of each other; a link between two ids
is told once, with its greatest similarity. ``first_seen`` drops an id only if each of its rows resembles a smaller id. Nodes are ordered by their smallest id. Other columns are kept,
whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import memory, word_runs
from textloom.operators import token_index
from textloom.operators.joins import splittable_join
from textloom.operators.units import numbered, numbered_within
from textloom.session import ship
from textloom.storage import discard, materialise, mounted

MIN_TOKENS = 10
#: Slots of the filter of ids.
ID_SLOTS = 1 << 20
PERMUTATIONS = 256
#: What the LSH mode finds at least of the pairs right at the threshold.
RECALL = 0.95
#: Up to so many nodes their numbers are sent to all tasks, and up to so many words their outlines; more are joined.
SENT_NODES, SENT_WORDS = 500_000, 8_000_000
#: Up to so many words outlines are mapped.
MAPPED_WORDS = 1 << 27
#: Smaller ones that a document is compared with first, for each task that has some.
NEAREST = 4
#: Members of a star that are compared at once, and how many tokens these may have.
BLOCK, BLOCK_TOKENS = 256, 1 << 20


@functools.cache
def bands_and_rows(percent: int, permutations: int = PERMUTATIONS, recall: float = RECALL) -> tuple[int, int]:
    """The most selective bands that find pairs at the threshold with a chance of ``recall``: as many rows as that allows, and as many bands as there are permutations for."""
    for rows in range(permutations, 1, -1):
        bands = permutations // rows
        if 1 - (1 - (percent / 100) ** rows) ** bands >= recall:
            return bands, rows
    return permutations, 1


def _hub_bands(percent: int) -> tuple[int, int]:
    """A few short bands, which find most neighbours."""
    return 12, max(1, round(np.log(0.26) / np.log(min(percent, 99) / 100)))


def _spread(rows: DataFrame) -> DataFrame:
    """Input that comes in fewer pieces than there are cores (a single small file) is dealt out; larger inputs are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _set_rows(least: int):
    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for first, texts in word_runs.pieces(b.column("t")):
                tokens, n, occurrences = word_runs.token_sets(texts)
                passed = occurrences >= least
                inside = np.repeat(passed, n)
                tokens, n = tokens[inside], np.where(passed, n, 0)
                ends = np.cumsum(n)
                keys = np.zeros((len(n), 2), np.int64)
                kept = np.nonzero(passed)[0]
                digests = [xxhash.xxh3_128_digest(tokens[e - k : e].tobytes()) for e, k in zip(ends[kept].tolist(), n[kept].tolist(), strict=True)]
                keys[kept] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens))
                words, length = token_index.outlines_of(tokens, n)
                outline = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(words))
                columns = [b.column("id").slice(first, len(n)), pa.array(row + np.arange(len(n))), lists, pa.array(n.astype(np.int32)), outline, *(pa.array(keys[:, k].copy(), mask=~passed) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "tokens", "n", "outline", "k1", "k2"])
                row += len(n)
        memory.tidy()

    return run


def token_sets(docs: DataFrame, id_col: str, text_col: str, least: int = MIN_TOKENS) -> DataFrame:
    """For each row: id, row (a number of its own), tokens (distinct, as sorted 64-bit hashes), n, the set's outline (``token_index.outlines_of``) and a 128-bit key of the set in k1, k2.

    Rows below the gate have no tokens and a null key.
    """
    ship(docs.sparkSession)
    rows = _spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")))
    return rows.mapInArrow(_set_rows(least), f"id {dict(rows.dtypes)['id']}, row bigint, tokens array<bigint>, n int, outline array<bigint>, k1 bigint, k2 bigint")


def signature(tokens: Column, permutations: int = PERMUTATIONS, hash_=F.xxhash64) -> Column:
    """The least of each seeded hash over a token set; ``hash_`` gets a token and a seed."""
    return F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda s: F.array_min(F.transform(tokens, lambda t: hash_(t, s))))


#: What separates the words that ``md5_signatures`` takes.
NO_WORD = "[^A-Za-z0-9_]+"


def _md5_signed(permutations: int):
    def run(batches):
        from hashlib import md5

        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            for first, texts in word_runs.pieces(b.column("t"), 8_000_000):
                split = pc.split_pattern_regex(texts, NO_WORD)
                words, doc = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
                some = pc.greater(pc.binary_length(words), 0)
                doc, coded = doc[some.to_numpy(zero_copy_only=False)], words.filter(some).dictionary_encode()
                if not len(doc):
                    continue
                codes, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
                starts = np.nonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[0]
                least = np.empty((len(starts), permutations, 16), np.uint8)
                for s in range(permutations):
                    end = b":%d" % (s + 1)
                    digests = np.frombuffer(b"".join([md5(w + end).digest() for w in distinct]), np.uint8).reshape(-1, 16)
                    halves = np.ascontiguousarray(digests).view(">u8")
                    order = np.lexsort((halves[:, 1], halves[:, 0]))
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    least[:, s] = digests[order[np.minimum.reduceat(rank[codes], starts)]]
                text = least.tobytes().hex().encode()
                hexes = pa.StringArray.from_buffers(len(starts) * permutations, pa.py_buffer(np.arange(0, len(text) + 1, 32, dtype=np.int32)), pa.py_buffer(text))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(hexes) + 1, permutations, dtype=np.int32)), hexes)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(texts)).take(pa.array(doc[starts])), lists], ["id", "sig"])
        memory.tidy()

    return run


def md5_signatures(docs: DataFrame, permutations: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The least MD5 of "word:seed" over each text's words for the seeds from 1 on: id, sig (hex). Texts without a word have none.

    A word is hashed once for each piece of the table that a task takes at a time, however many texts hold it there.
    """
    ship(docs.sparkSession)
    rows = _spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")))
    return rows.mapInArrow(_md5_signed(permutations), f"id {dict(rows.dtypes)['id']}, sig array<string>")


def band_columns(signed: Column, bands: int, rows: int) -> Column:
    """Keys of the bands of a signature: the number of the band and its values."""
    value = lambda i: F.concat_ws(":", i.cast("string"), F.transform(F.slice(signed, i * rows + 1, rows), lambda x: x.cast("string")))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), value)


@dataclass
class Nodes:
    """Distinct token sets, numbered in the order of their smallest ids. known: (node, id, row, n, outline); members: (id, node, n) of all rows past the gate."""

    sets: DataFrame
    known: DataFrame
    members: DataFrame
    count: int
    _outlines: object = None
    _index: tuple | None = None
    _full: DataFrame | None = None

    def outlines(self):
        """A broadcast of all nodes' sizes and outlines if they take little, 64 MB at most; up to 1 GB one of their place in a mounted shared folder, whose files workers map; else nothing, and they are joined."""
        if self._outlines is None:
            spark, words = self.sets.sparkSession, self.known.agg(F.sum(F.size("outline"))).first()[0] or 0
            folder = mounted(spark, "outlines") if words <= MAPPED_WORDS else None
            table = self.known.select("node", "n", F.xxhash64("id").alias("owner"), "outline")
            if self.count <= SENT_NODES and words <= SENT_WORDS:
                table = table.toArrow()
                table = table.take(np.argsort(table.column("node").to_numpy())).combine_chunks()  # numbers are dense, so a node's place is its number
                sent = token_index.Outlines.of(*(table.column(c).combine_chunks() for c in ("n", "owner", "outline")))
                self._outlines = spark.sparkContext.broadcast(sent)
                del table, sent
                memory.tidy()
            elif folder:
                self._outlines = spark.sparkContext.broadcast(token_index.map_outlines(table, folder, self.count))
            else:
                self._outlines = False
        return self._outlines or None

    def tokens(self) -> DataFrame:
        """node, n, tokens. A row's number finds its node; few numbers are sent to all tasks, many are joined once and the result is stored."""
        few = self.known.select("row", "node")
        rows = self.sets.select("row", "n", "tokens")
        if self.count <= SENT_NODES:
            return rows.join(F.broadcast(few), "row").drop("row")
        if self._full is None:
            self._full = materialise(rows.join(few, "row").drop("row"), "node-tokens")
        return self._full

    def discard(self) -> None:
        discard(self.sets.stored_at, *([self._full.stored_at] if self._full is not None else []))


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> Nodes:
    sets = materialise(token_sets(docs, id_col, text_col), "token-sets")
    full = sets.filter("id is not null and k1 is not null")
    least = full.groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("f"))
    first = materialise(numbered(least.select("k1", "k2", "f.id", "f.row"), "id", "k1", "k2", name="node"), "token-nodes")
    count = first.count()
    members = splittable_join(full.select(F.col("id").alias("__id"), "n", "k1", "k2"), first.select("k1", "k2", "node"), "k1", "k2")
    members = materialise(members.select(F.col("__id").alias("id"), "node", "n"), "members")
    few = first.select("row", "node", F.col("id").alias("first"))
    known = full.select("row", "n", "outline").join(F.broadcast(few) if count <= SENT_NODES else few, "row")
    known = materialise(known.select("node", F.col("first").alias("id"), "row", "n", "outline"), "nodes")
    return Nodes(sets, known, members, count)


def _likely(pairs: DataFrame, nodes: Nodes, percent: int) -> DataFrame:
    """The pairs that sizes and outlines leave."""
    sent = nodes.outlines()

    def left(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            if sent is not None:
                known, at, other, to = sent.value, b.column("a").to_numpy(), sent.value, b.column("b").to_numpy()
            else:
                known, other = (token_index.Outlines.of(*(b.column(f"{c}{x}") for c in "nio")) for x in "ab")
                at = to = np.arange(b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(known.may_be_similar(at, other, to, percent)))
        memory.tidy()

    pairs = pairs.select("a", "b")
    if sent is None:
        for x in "ab":
            pairs = pairs.join(nodes.known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.xxhash64("id").alias(f"i{x}"), F.col("outline").alias(f"o{x}")), x)
    return pairs.mapInArrow(left, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, nodes: Nodes, percent: int) -> DataFrame:
    """The pairs that are similar on their full sets: a, b, both, union. Nodes of one id aren't compared.

    Bits in which two outlines differ are tokens that the sets don't share, so pairs that differ in too many bits are out before their tokens are fetched; and
    only tokens of nodes that are left are shuffled, as far as a filter of bounded size can tell them.
    """
    likely = materialise(_likely(pairs, nodes, percent), "likely")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_SLOTS)).cast("int").alias("slot")
    slots = likely.select(slot("a")).union(likely.select(slot("b"))).distinct()  # at most ID_SLOTS rows
    needed = nodes.tokens().select("node", "tokens", slot("node")).join(F.broadcast(slots), "slot", "left_semi")
    full = lambda i, t: needed.select(F.col("node").alias(i), F.col("tokens").alias(t))
    both = likely.join(full("a", "ta"), "a").join(full("b", "tb"), "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
    return both.withColumn("union", F.size("ta") + F.size("tb") - F.col("both")).filter(100 * F.col("both") >= percent * F.col("union")).select("a", "b", "both", "union")


def _labels(nodes: Nodes, percent: int, rounds: int = 1) -> DataFrame:
    """node, label: a similar node of smaller number, for most nodes that have one. Each bucket of a band offers the smallest of its nodes; later rounds offer the label of a node's label."""
    bands, rows = _hub_bands(percent)
    kinds = "node bigint, band bigint"

    def banded(batches):
        import pyarrow as pa

        for batch in batches:
            for part in token_index._slices(batch):
                keys = token_index.band_keys(part.column("tokens").flatten().to_numpy(), part.column("n").to_numpy().astype(np.int64), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("node").to_numpy(), bands)), pa.array(keys.reshape(-1).view(np.int64))], ["node", "band"])
        memory.tidy()

    buckets = materialise(nodes.tokens().mapInArrow(banded, kinds), "bands")
    hubs = buckets.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most").drop("most")
    offered = splittable_join(buckets, hubs, "band").select("a", F.col("node").alias("b")).filter("a < b").distinct()
    labels = materialise(_confirmed(offered, nodes, percent).groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("label")), "labels")
    for _ in range(rounds - 1):
        further = labels.select("node", F.col("label").alias("h")).join(labels.select(F.col("node").alias("h"), F.col("label").alias("a")), "h").select("a", F.col("node").alias("b"))
        further = materialise(further, "further")
        if further.isEmpty():
            break
        better = _confirmed(further, nodes, percent).select(F.col("b").alias("node"), F.col("a").alias("better"))
        labels = materialise(labels.join(better, "node", "left").select("node", F.least("label", "better").alias("label")), "labels")
    return labels


def _met(nodes: Nodes, percent: int, mode: str, told: DataFrame, across: bool, few: int | None = None) -> DataFrame:
    """Pairs of nodes (a < b) that an index brings together. ``told``: (node, open[, star]) of all nodes: pairs of open nodes with smaller ones, or ``across`` the stars; with ``few`` the nearest of each task."""
    spark = nodes.sets.sparkSession
    small = nodes.count <= SENT_NODES
    rows = nodes.tokens().join(F.broadcast(told) if small else told, "node")
    outlines = nodes.outlines()
    if mode == "lsh":
        bands, each = bands_and_rows(percent)
        parts = token_index.task_count(spark, nodes.count * bands)
        return token_index.meeting(rows.mapInArrow(token_index.by_bands(bands, each, parts), "part bigint, raw binary"), parts, False, percent, outlines, few)
    if nodes._index is None or nodes._index[0] != percent:
        sent, bits = token_index.sent_table(nodes.tokens(), nodes.known.agg(F.sum("n")).first()[0] or 1)
        nodes._index = (percent, sent, bits, *token_index.schemes(nodes.tokens(), sent, bits, percent, max(1, nodes.count), token_index.PAIR_COST if outlines is not None else token_index.JOINED_PAIR_COST))
        memory.tidy()
    _, sent, bits, chosen, postings = nodes._index
    parts = token_index.task_count(spark, postings)
    return token_index.meeting(rows.mapInArrow(token_index.by_prefixes(sent, bits, percent, chosen, parts, across), "part bigint, raw binary"), parts, across, percent, outlines, few)


def _within_stars(nodes: Nodes, stars: DataFrame, percent: int) -> DataFrame:
    """Similar pairs of nodes of one star: a, b, both, union. Members are compared block by block; a block holds fewer the larger their sets are."""
    sized = stars.join(nodes.known.select("node", "n", "id"), "node")
    hub = nodes.known.select(F.col("node").alias("star"), F.col("n").alias("hub_n"))
    per_block = F.greatest(F.least(F.floor(F.lit(BLOCK_TOKENS) / F.col("hub_n")), F.lit(BLOCK)), F.lit(1))
    placed = numbered_within(sized, "star", "node", name="at").join(hub, "star").withColumn("block", F.floor(F.col("at") / per_block).cast("int"))
    placed = materialise(placed.select("star", "node", "id", "block"), "stars")
    blocks = placed.groupBy("star").agg(F.max("block").alias("last"))
    dealt = splittable_join(placed, blocks, "star").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("star", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "id")
    full = nodes.tokens()
    rows = dealt.join(full, "node").select("star", "i", "j", "block", "node", F.xxhash64("id").alias("id"), "tokens")

    def compared(key, table):
        import pyarrow as pa

        i, j = key[1].as_py(), key[2].as_py()
        table = table.combine_chunks()
        node, block, ident = (table.column(c).to_numpy() for c in ("node", "block", "id"))
        lists = table.column("tokens").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        tokens = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(len(node)), sizes)
        _, place, often = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = often > 1  # others can't be in an intersection
        column = np.cumsum(shared) - 1
        some = shared[place]
        doc, place = doc[some], column[place[some]]
        both = np.zeros((len(node), len(node)), np.float32)
        order = np.argsort(place, kind="stable")
        doc, place = doc[order], place[order]
        total = int(shared.sum())
        width = min(max(1, total), max(1, (1 << 22) // max(1, len(node))))  # so many tokens at once
        for low in range(0, total, width):
            at, to = np.searchsorted(place, (low, low + width))
            m = np.zeros((len(node), width), np.float32)
            m[doc[at:to], place[at:to] - low] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        fits = (100 * both >= percent * union) & (node[:, None] < node[None, :]) & (ident[:, None] != ident[None, :])
        if i != j:
            fits &= block[:, None] != block[None, :]
        a, b = np.nonzero(fits)
        return pa.table({"a": node[a], "b": node[b], "both": both[a, b].astype(np.int32), "union": union[a, b].astype(np.int32)})

    return rows.groupBy("star", "i", "j").applyInArrow(compared, "a bigint, b bigint, both int, union int")


def _linked(docs: DataFrame, percent: int, mode: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Links between the smallest ids of equal sets (id_a < id_b, both, jaccard), and each document's first (id, node: the smallest id of its set, n)."""
    nodes = _nodes(docs, id_col, text_col)
    if mode == "lsh":
        told = nodes.known.select("node", F.lit(True).alias("open"))
        pairs = _confirmed(_met(nodes, percent, mode, told, False), nodes, percent)
    else:
        labels = _labels(nodes, percent, rounds=3)
        hubs = labels.select(F.col("label").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
        stars = labels.select("node", F.col("label").alias("star")).union(hubs.select("node", F.col("node").alias("star")))
        told = nodes.known.select("node").join(labels.withColumnRenamed("label", "star"), "node", "left").select("node", F.lit(True).alias("open"), F.coalesce("star", "node").alias("star"))
        pairs = _within_stars(nodes, stars, percent).union(_confirmed(_met(nodes, percent, mode, told, True), nodes, percent))
    first = nodes.known.select("node", "id")
    pairs = pairs.join(first.toDF("a", "id_a"), "a").join(first.toDF("b", "id_b"), "b")
    pairs = pairs.select("id_a", "id_b", F.struct((F.col("both") / F.col("union")).alias("s"), "both", "union").alias("x")).groupBy("id_a", "id_b").agg(F.max("x").alias("x"))
    pairs = materialise(pairs.select("id_a", "id_b", "x.both", F.round(F.col("x.both") / F.col("x.union"), 6).alias("jaccard")), "similar")
    members = materialise(nodes.members.join(first.select("node", F.col("id").alias("first")), "node").select("id", F.col("first").alias("node"), "n").distinct(), "members")
    nodes.discard()
    return pairs, members


def token_set_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The smallest id with the same token set for each document past the gate: id, node."""
    sets = token_sets(docs, id_col, text_col).select("id", "k1", "k2").filter("id is not null and k1 is not null")
    return splittable_join(sets, sets.groupBy("k1", "k2").agg(F.min("id").alias("node")), "k1", "k2").select("id", "node")


def similar_pairs(docs: DataFrame, percent: int = 80, mode: str = "exact", id_col: str = "doc_id", text_col: str = "text", expand: bool = False) -> DataFrame:
    """Pairs (id_a < id_b) with their shared tokens ``both`` and ``jaccard``, where 100 * both >= percent * union.

    The pairs are between the smallest ids of equal sets, and ``token_set_members`` has the others; ``expand=True`` spells out all pairs, which
    grows with the square of the number of copies.
    """
    pairs, members = _linked(docs, percent, mode, id_col, text_col)
    if not expand:
        return pairs
    across = pairs.join(members.select(F.col("node").alias("id_a"), F.col("id").alias("x")), "id_a").join(members.select(F.col("node").alias("id_b"), F.col("id").alias("y")), "id_b")
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "both", "jaccard")
    inside = members.join(members.select("node", F.col("id").alias("id_b")), "node").filter(F.col("id") < F.col("id_b"))
    return across.union(inside.select(F.col("id").alias("id_a"), "id_b", F.col("n").alias("both"), F.lit(1.0).alias("jaccard")))


def first_seen(docs: DataFrame, percent: int = 80, mode: str = "exact", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no document of smaller id resembles.

    A document goes as soon as one smaller is found: those with a hub are gone. The rest is compared with a few smaller ones of its keys, the nearest by their outlines,
    and only what these don't settle with all of them. So a large group of near copies costs about its size, not its square.
    """
    nodes = _nodes(docs, id_col, text_col)
    labels = _labels(nodes, percent).select("node")
    told = nodes.known.select("node").join(labels.withColumn("gone", F.lit(True)), "node", "left").select("node", F.col("gone").isNull().alias("open"))
    met = materialise(_met(nodes, percent, mode, told, False, NEAREST), "met")
    gone = materialise(labels.union(_confirmed(met, nodes, percent).select(F.col("b").alias("node"))).distinct(), "gone")
    left = materialise(met.filter("more").select(F.col("b").alias("node")).distinct().join(gone, "node", "left_anti"), "unsettled")
    if not left.isEmpty():
        told = nodes.known.select("node").join(left.withColumn("left", F.lit(True)), "node", "left").select("node", F.col("left").isNotNull().alias("open"))
        later = _confirmed(_met(nodes, percent, mode, told, False), nodes, percent).select(F.col("b").alias("node"))
        gone = materialise(gone.union(later).distinct(), "gone")
    first = nodes.known.select("node", F.col("id").alias("first"))
    rows = nodes.members.join(first, "node").join(gone.withColumn("gone", F.lit(True)), "node", "left").select("id", (F.coalesce("gone", F.lit(False)) | (F.col("first") < F.col("id"))).alias("gone"))
    short = nodes.sets.filter("id is not null and k1 is null").select("id", F.lit(False).alias("gone"))
    ids = materialise(rows.union(short).groupBy("id").agg(F.bool_and("gone").alias("gone")).filter("gone").select(F.col("id").alias("__gone_id")), "gone-ids")
    nodes.discard()
    return docs.join(ids, F.col(id_col) == F.col("__gone_id"), "left_anti")


def clusters(docs: DataFrame, percent: int = 80, mode: str = "exact", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, cluster (its base), is_extreme, copies for every document that has a neighbour; a base can be a member elsewhere too.

    In ascending order of id a document joins the smallest earlier neighbour that by then is a base, or else makes its smallest earlier
    neighbour one; a document with the token set of an earlier one joins that. All members resemble their base, so bases alone are
    extremes, and their copies are the sizes of their clusters. What each document does depends on smaller ids only, so repeating the rule for all at once, until
    nothing changes, gives the same as going through them one by one; each round is two aggregates over the links.
    """
    pairs, members = _linked(docs, percent, mode, id_col, text_col)
    copies = materialise(members.filter(F.col("id") > F.col("node")).select("id", F.col("node").alias("base")), "copies")
    earlier = pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("x"))
    choice = materialise(earlier.groupBy("id").agg(F.min("x").alias("base")), "bases")
    while True:
        since = choice.union(copies).groupBy("base").agg(F.min("id").alias("since"))
        open_ = earlier.join(since, F.col("x") == F.col("base"), "left").groupBy("id").agg(F.coalesce(F.min(F.when(F.col("since") < F.col("id"), F.col("x"))), F.min("x")).alias("next"))
        step = materialise(choice.join(open_, "id").select("id", F.col("next").alias("base"), (F.col("next") != F.col("base")).alias("moved")), "bases")
        last = choice.stored_at
        choice = step.select("id", "base")
        choice.stored_at = step.stored_at
        discard(last)
        if not step.filter("moved").limit(1).count():
            break
    joined = choice.union(copies)
    bases = joined.groupBy("base").agg((F.count(F.lit(1)) + 1).alias("copies"))
    rest = joined.select("id", F.col("base").alias("cluster"), F.lit(False).alias("is_extreme"), F.lit(None).cast("bigint").alias("copies"))
    return bases.select(F.col("base").alias("id"), F.col("base").alias("cluster"), F.lit(True).alias("is_extreme"), "copies").union(rest)


def extremes(docs: DataFrame, percent: int = 80, mode: str = "exact", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are clustered and extreme nowhere."""
    c = clusters(docs, percent, mode, id_col, text_col).groupBy("id").agg(F.bool_or("is_extreme").alias("kept"))
    gone = c.filter(~F.col("kept")).select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti")


def cluster_lists(clustered: DataFrame) -> DataFrame:
    """One row per cluster: its base, then its members by id, with their flags."""
    item = F.struct((F.col("id") != F.col("cluster")).alias("rest"), F.col("id").alias("base_index"), "is_extreme", "copies")
    return clustered.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["base_index"].alias("base_index"), x["is_extreme"].alias("is_extreme"), x["copies"].alias("copies"))).alias("members"))


def summary(docs: DataFrame, clustered: DataFrame) -> DataFrame:
    """original, clusters, clustered, extremes, kept."""
    each = clustered.groupBy("id").agg(F.bool_or("is_extreme").alias("kept"))
    c = each.agg(F.count(F.lit(1)).alias("clustered"), F.count_if("kept").alias("extremes"))
    n = docs.agg(F.count(F.lit(1)).alias("original"))
    k = clustered.agg(F.countDistinct("cluster").alias("clusters"))
    return n.crossJoin(k).crossJoin(c).withColumn("kept", F.col("original") - F.col("clustered") + F.col("extremes"))


def keyed_clusters(rows: DataFrame, *keys: str, percent: int = 80, mode: str = "exact", text_col: str = "text") -> DataFrame:
    """Clusters of rows that are known by several columns, such as a repository and a path, in their order: those columns with base_index, cluster, is_extreme, copies."""
    at = materialise(numbered(rows.select(*keys, F.col(text_col).alias("text")), *keys, name="base_index"), "keyed")
    c = clusters(at, percent, mode, "base_index", "text")
    return c.withColumnRenamed("id", "base_index").join(at.drop("text"), "base_index").select(*keys, "base_index", "cluster", "is_extreme", "copies")


def without_keyed_copies(rows: DataFrame, *keys: str, **options) -> DataFrame:
    """The rows without those that are clustered and extreme nowhere."""
    c = keyed_clusters(rows, *keys, **options).groupBy(*keys).agg(F.bool_or("is_extreme").alias("kept"))
    return rows.join(c.filter(~F.col("kept")).select(*keys), list(keys), "left_anti")
