"""An index of token sets under which all similar ones meet, though tokens may be common: adaptive prefixes.

Tokens have one order, rarest first, for all nodes. Two sets that share T tokens share the first j of these within their first n - T + j tokens. So similar sets share

* one token within a prefix of n - T + 1 (level 1), or
* g + 1 tokens within a prefix of n - T + g + 1; dealt to g groups by their hash, two of them fall into one (level 2), or
* 2 g + 1 tokens, of which three fall into one group (level 3).

At level m a node is posted under every combination of m tokens of one group of its prefix. With g near to the length of the first prefix that are some two, or
four to five, combinations for each of its tokens, while a key of two or three tokens is common to far fewer nodes than its tokens are. Which
level costs least is decided for each class of sizes (powers of two) from the table of frequencies: postings, and pairs of nodes that keys are expected to bring together.
The larger of two sets tells the class and so the keys by which a pair meets; a node is posted for each class in which it can be the larger, or meet one.

No pair is lost at any level; levels change the cost alone.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.memory import tidy

#: The table of token frequencies has at most 2 ** MOST_BITS counters of 4 bytes.
MOST_BITS = 22
LEVELS = (1, 2, 3)
#: What a pair that a key brings together costs, in postings: where the outlines of all sets are at hand, and where they must be joined.
PAIR_COST, JOINED_PAIR_COST = 1.0, 10.0
#: Postings that one task holds, pairs that it makes at once, and tokens that it takes at once.
POSTINGS_A_TASK, PAIRS_AT_ONCE, TOKENS_AT_ONCE = 2_000_000, 500_000, 150_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return ((tokens.view(np.uint64) * _M1) >> np.uint64(64 - bits)).astype(np.int64)


def table_bits(tokens: int) -> int:
    return min(MOST_BITS, max(14, int(tokens).bit_length() - 2))


def frequencies(nodes: DataFrame, bits: int) -> np.ndarray:
    """How many nodes have a token of each of 2 ** bits slots. The array is of that size whatever the input; tasks send their counts in pieces, which are summed piece by piece."""
    pieces = 1 << max(0, bits - 14)

    def counted(batches):
        n = np.zeros(1 << bits, np.int64)
        for b in batches:
            n += np.bincount(slots(b.column("tokens").flatten().to_numpy(), bits), minlength=1 << bits)
        some = [k for k, x in enumerate(np.split(n, pieces)) if x.any()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int32()), "counts": pa.array([n[k * len(n) // pieces : (k + 1) * len(n) // pieces].tobytes() for k in some], pa.binary())})
        del n
        tidy()

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.int32()), "counts": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    schema = "piece int, counts binary"
    out = np.zeros((pieces, (1 << bits) // pieces), np.int64)
    for r in nodes.select("tokens").mapInArrow(counted, schema).repartition(min(pieces, 64), "piece").mapInArrow(summed, schema).collect():
        out[r.piece] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


@dataclass(frozen=True)
class Scheme:
    """How the sets of a class are keyed: combinations of ``level`` tokens out of one of ``groups``."""

    level: int
    groups: int


def groups_of(size_class: int, level: int, percent: int) -> int:
    """Groups for a level in the class of sizes from 2 ** size_class on; 0 if its sets share too few tokens for it."""
    wanted = max(1, round(2 ** (size_class + 0.5) * (100 - percent) / 100))
    if level == 1:
        return 1
    shared = -(-(percent << size_class) // 100)
    return min(wanted, (shared - 1) // (level - 1))


def _classes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each size, and the greatest that a similar set can have."""
    whole = lambda x: np.frexp(x.astype(float))[1] - 1
    return whole(n), whole(n * 100 // percent)


def _slices(batch: pa.RecordBatch):
    """Parts of a batch with a bounded number of tokens."""
    ends, at = np.cumsum(batch.column("n").to_numpy().astype(np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


class _Ordered:
    """Some nodes with their tokens in order of rarity."""

    def __init__(self, batch: pa.RecordBatch, often: np.ndarray, bits: int, percent: int):
        self.n = batch.column("n").to_numpy().astype(np.int64)
        tokens = batch.column("tokens").flatten().to_numpy()
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        f = often[slots(tokens, bits)]
        order = np.lexsort((tokens, f, self.doc))
        self.tokens, self.often = tokens[order], f[order]
        self.first = np.cumsum(self.n) - self.n
        self.at = np.arange(len(self.doc)) - self.first[self.doc]
        self.prefix = self.n - -(-self.n * percent // 100) + 1
        self.own, self.reach = _classes(self.n, percent)

    def length(self, scheme: Scheme) -> np.ndarray:
        return np.minimum(self.n, self.prefix + (scheme.level - 1) * scheme.groups)

    def keys(self, which: np.ndarray, size_class: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
        """For the chosen nodes: the node of each posting, and its key."""
        chosen = np.zeros(len(self.n), bool)
        chosen[which] = True
        inside = chosen[self.doc] & (self.at < self.length(scheme)[self.doc])
        doc, tokens = self.doc[inside], self.tokens[inside]
        if scheme.level == 1:
            rare = self.often[inside] > 1  # a token that one node alone has meets none
            return doc[rare], mix(tokens[rare].view(np.uint64) + np.uint64(size_class))
        group = (mix(tokens.view(np.uint64) ^ np.uint64(0x5BD1E995)) % np.uint64(scheme.groups)).astype(np.int64)
        order = np.lexsort((self.at[inside], group, doc))
        doc, tokens, group = doc[order], tokens[order].view(np.uint64), group[order]
        begins = np.ones(len(doc), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | (group[1:] != group[:-1])
        starts = np.append(np.nonzero(begins)[0], len(doc))
        ends = np.repeat(starts[1:], np.diff(starts))
        last, key = np.arange(len(doc)), mix(tokens + np.uint64(size_class))
        for _ in range(scheme.level - 1):  # each combination with each later token of its group
            more = ends[last] - last - 1
            from_ = np.repeat(np.arange(len(last)), more)
            last = last[from_] + 1 + np.arange(len(from_)) - np.repeat(np.cumsum(more) - more, more)
            key = mix(key[from_] * _M2 + tokens[last])
        return doc[last], key


def schemes(nodes: DataFrame, sent, bits: int, percent: int, count: int, pair_cost: float = PAIR_COST) -> tuple[dict[int, Scheme], int]:
    """The cheapest scheme of each class of sizes, and how many postings all make. Costs are sums over all nodes; a row for each class, level and task goes to the driver as sums."""

    def run(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part in _slices(batch):
                o = _Ordered(part, sent.value, bits, percent)
                before = np.concatenate([[0.0], np.cumsum(o.often.astype(float))])
                for c in range(int(o.own.min(initial=64)), int(o.reach.max(initial=-1)) + 1):
                    which = np.nonzero((o.own <= c) & (o.reach >= c))[0]
                    for level in LEVELS:
                        g = groups_of(c, level, percent)
                        if not len(which) or not g:
                            continue
                        length = o.length(Scheme(level, g))[which].astype(float)
                        often = before[o.first[which] + length.astype(np.int64)] - before[o.first[which]]
                        ways = g ** (level - 1) * (1, 2, 6)[level - 1]
                        made, met = (length**level / ways).sum(), (often**level / ways / float(count) ** (level - 1)).sum()
                        held[c, level] = held.get((c, level), 0) + np.array([made, met])
        o = before = None
        tidy()
        if held:
            yield pa.RecordBatch.from_pydict({"c": [c for c, _ in held], "level": [m for _, m in held], "made": [float(x[0]) for x in held.values()], "met": [float(x[1]) for x in held.values()]})

    found = nodes.select("n", "tokens").mapInArrow(run, "c bigint, level bigint, made double, met double").groupBy("c", "level").agg(F.sum("made").alias("made"), F.sum("met").alias("met")).collect()
    best: dict[int, tuple[float, int, float]] = {}
    for r in found:
        best[r.c] = min(best.get(r.c, (np.inf, 0, 0.0)), (r.made + pair_cost * r.met, r.level, r.made))
    return {c: Scheme(level, groups_of(c, level, percent)) for c, (_, level, _) in best.items()}, int(sum(x[2] for x in best.values()))


#: A posting; the node's two lowest bits tell whether it is of the key's class, and whether it is open.
POSTING = np.dtype([("key", "<u8"), ("node", "<i8"), ("star", "<i8")])
PLAIN = np.dtype([("key", "<u8"), ("node", "<i8")])


def _dealt(node: np.ndarray, key: np.ndarray, own: np.ndarray, open_: np.ndarray, star: np.ndarray | None, parts: int):
    """Postings to rows of packed postings, one for each part."""
    rows = np.empty(len(key), PLAIN if star is None else POSTING)
    rows["key"], rows["node"] = key, node * 4 + own * 2 + open_
    if star is not None:
        rows["star"] = star
    part = (key >> np.uint64(40)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    cuts = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int64)), pa.array([rows[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["part", "raw"])


def by_prefixes(sent, bits: int, percent: int, chosen: dict[int, Scheme], parts: int, stars: bool):
    """Nodes (node, n, tokens, open[, star]) to dealt postings."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                o = _Ordered(part, sent.value, bits, percent)
                node, open_ = part.column("node").to_numpy(), part.column("open").to_numpy(zero_copy_only=False)
                star = part.column("star").to_numpy() if stars else None
                for c, scheme in chosen.items():
                    which = np.nonzero((o.own <= c) & (o.reach >= c))[0]
                    if len(which):
                        doc, key = o.keys(which, c, scheme)
                        if len(doc):
                            yield _dealt(node[doc], key, o.own[doc] == c, open_[doc], None if star is None else star[doc], parts)
                        doc = key = None
                o = None
        tidy()

    return run


def minhashes(tokens: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """The least of each of ``count`` hashes over each set; sets aren't empty."""
    first = np.cumsum(sizes) - sizes
    h = mix(tokens.view(np.uint64))
    factors = mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(sizes), count), np.uint64)
    for k, f in enumerate(factors):
        x = h * f
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)
    return out


def band_keys(tokens: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The key of each band of each set's signature."""
    signature = minhashes(tokens, sizes, bands * rows).reshape(len(sizes), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sizes), bands))
    for r in range(rows):
        key = mix(key * _M2 + signature[:, :, r])
    return key


def by_bands(bands: int, rows: int, parts: int):
    """Nodes (node, n, tokens, open) to dealt postings under the bands of their signatures."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                n = part.column("n").to_numpy().astype(np.int64)
                key = band_keys(part.column("tokens").flatten().to_numpy(), n, bands, rows).reshape(-1)
                node, open_ = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), bands) for c in ("node", "open"))
                yield _dealt(node, key, np.ones(len(key), bool), open_, None, parts)
        tidy()

    return run


def _pairs(rows: np.ndarray, across: bool):
    """Pairs (a < b) of nodes under one key, of which one at least is of the key's class: of each open node and all before it, or ``across`` stars only."""
    node = rows["node"] >> 2
    order = np.lexsort((node, rows["star"], rows["key"]) if across else (node, rows["key"]))
    rows, node = rows[order], node[order]
    new = np.ones(len(rows), bool)
    new[1:] = rows["key"][1:] != rows["key"][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    if across:
        new[1:] |= rows["star"][1:] != rows["star"][:-1]
        before = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) - start
    else:
        before = np.where(rows["node"] & 1, np.arange(len(rows)) - start, 0)
    own = (rows["node"] & 2).astype(bool)
    ends = np.cumsum(before)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, PAIRS_AT_ONCE):
        t = np.arange(low, min(total, low + PAIRS_AT_ONCE))
        j = np.searchsorted(ends, t, side="right")
        i = start[j] + t - (ends[j] - before[j])
        some = (own[i] | own[j]) & (node[i] != node[j])
        a, b = np.minimum(node[i[some]], node[j[some]]), np.maximum(node[i[some]], node[j[some]])
        if b.max(initial=0) < 1 << 31:
            both = np.unique(a << 32 | b)
            a, b = both >> 32, both & 0xFFFFFFFF
        yield a, b


def outline_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the outline of a set of n tokens: a power of two, 2 to 4 for each token, 64 at least."""
    return np.maximum(64, 1 << (np.frexp(np.maximum(n, 1).astype(float))[1].astype(np.int64) + 1))


def outlines_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outlines of some sets as 64-bit words end to end, and how many words each has. A token sets the bit that its lowest digits tell, so that an outline of half the length is the union of both halves."""
    bits = outline_bits(sizes)
    first = np.cumsum(bits) - bits
    marks = np.zeros(int(bits.sum()), bool)
    marks[np.repeat(first, sizes) + (tokens & np.repeat(bits - 1, sizes))] = True
    return np.packbits(marks).view(np.int64), bits // 64


@dataclass
class Outlines:
    """Of some nodes: sizes, owners (equal numbers for nodes of one id), and outlines as words end to end."""

    n: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    length: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, n: pa.Array, owner: pa.Array, outline: pa.ListArray) -> Outlines:
        ends = outline.offsets.to_numpy().astype(np.int64)
        return cls(n.to_numpy().astype(np.int64), owner.to_numpy(), ends[:-1] - ends[0], np.diff(ends), outline.flatten().to_numpy().view(np.uint64))

    def of_each(self, name: str, at: np.ndarray) -> np.ndarray:
        return getattr(self, name)[at]

    def _words(self, at: np.ndarray, length: int) -> np.ndarray:
        return self.words[self.first[at][:, None] + np.arange(length)]

    def _folded(self, at: np.ndarray, length: int, to: int) -> np.ndarray:
        return np.bitwise_or.reduce(self._words(at, length).reshape(len(at), length // to, to), axis=1)

    def may_be_similar(self, a: np.ndarray, other: Outlines, b: np.ndarray, percent: int, apart: np.ndarray | None = None) -> np.ndarray:
        """Which pairs (one from here, one of the others) are left by their sizes and by the bits in which their outlines differ, each of which is a token that they don't share.

        ``apart``, an array for all pairs, gets these bits as a share of both sizes.
        """
        na, nb = self.of_each("n", a), other.of_each("n", b)
        fits = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (self.of_each("owner", a) != other.of_each("owner", b))
        shape = self.of_each("length", a) << 32 | other.of_each("length", b)
        for kind in np.unique(shape[fits]).tolist():
            la, lb = kind >> 32, kind & 0xFFFFFFFF
            to, some = min(la, lb), np.nonzero(fits & (shape == kind))[0]
            step = max(1, (1 << 21) // max(la, lb))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                differ = np.bitwise_count(self._folded(a[part], la, to) ^ other._folded(b[part], lb, to)).sum(axis=1, dtype=np.int64)
                fits[part] = (100 + percent) * differ <= (100 - percent) * (na[part] + nb[part])
                if apart is not None:
                    apart[part] = differ / (na[part] + nb[part])
        return fits


#: Nodes of one file of mapped outlines, as a power of two.
MAPPED_BITS = 16


class MappedOutlines(Outlines):
    """Outlines of all nodes in files of the shared folder, one for each 2 ** MAPPED_BITS nodes, which workers map: those of one machine share the pages."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    @functools.cached_property
    def files(self) -> dict[int, Outlines]:
        return {}

    def __getstate__(self):
        return {"folder": self.folder, "bits": self.bits}

    def _file(self, k: int) -> Outlines:
        if k not in self.files:
            data = pa.memory_map(f"{self.folder}/{k}.outlines").read_buffer()
            count = int(np.frombuffer(data, "<i8", 1)[0])
            n, owner, length = (np.frombuffer(data, "<i8", count, 8 + 8 * count * i) for i in range(3))
            self.files[k] = Outlines(n, owner, np.cumsum(length) - length, length, np.frombuffer(data, "<u8", -1, 8 + 24 * count))
        return self.files[k]

    def _gathered(self, at: np.ndarray, out: np.ndarray, take) -> np.ndarray:
        place = at >> self.bits
        order = np.argsort(place, kind="stable")
        cuts = np.nonzero(np.concatenate([[True], np.diff(place[order]) > 0, [True]]))[0] if len(at) else [0]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            some = order[low:high]
            out[some] = take(self._file(int(place[some[0]])), at[some] & ((1 << self.bits) - 1))
        return out

    def of_each(self, name: str, at: np.ndarray) -> np.ndarray:
        return self._gathered(at, np.empty(len(at), np.int64), lambda o, i: getattr(o, name)[i])

    def _words(self, at: np.ndarray, length: int) -> np.ndarray:
        return self._gathered(at, np.empty((len(at), length), np.uint64), lambda o, i: o._words(i, length))


def map_outlines(known: DataFrame, folder: str, count: int, bits: int = MAPPED_BITS) -> MappedOutlines:
    """Writes the outlines of nodes (node, n, owner, outline), numbered from 0 without gaps, a file for each range of numbers."""
    import os
    import uuid

    def run(key, table):
        table = table.take(np.argsort(table.column("node").to_numpy())).combine_chunks()
        o = Outlines.of(*(table.column(c).combine_chunks() for c in ("n", "owner", "outline")))
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for x in (np.array([len(o.n)]), o.n, o.owner, o.length, o.words):
                f.write(np.ascontiguousarray(x).view("<u8").tobytes())
        os.replace(part, f"{folder}/{key[0].as_py()}.outlines")
        return pa.table({"k": [key[0].as_py()]})

    done = known.withColumn("k", F.shiftright("node", bits)).groupBy("k").applyInArrow(run, "k bigint").count()
    if done != -(-count // (1 << bits)):
        raise ValueError("nodes aren't numbered without gaps")
    return MappedOutlines(folder, bits)


def _nearest(pairs: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """For each b the few pairs whose outlines are nearest, and the b of which there are more."""
    pairs = pairs[np.lexsort((pairs["apart"], pairs["a"], pairs["b"]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    pairs = pairs[new]
    pairs = pairs[np.lexsort((pairs["a"], pairs["apart"], pairs["b"]))]
    first = np.ones(len(pairs), bool)
    first[1:] = pairs["b"][1:] != pairs["b"][:-1]
    starts = np.maximum.accumulate(np.where(first, np.arange(len(pairs)), 0))
    kept = np.arange(len(pairs)) - starts < few
    return pairs[kept], np.unique(pairs["b"][~kept])


def meeting(dealt: DataFrame, parts: int, across: bool, percent: int, outlines=None, few: int | None = None) -> DataFrame:
    """The distinct pairs (a, b), a < b, that the postings bring together; with a broadcast of ``outlines`` only those that these leave.

    With outlines and ``few``, each task tells for each b no more than so many a, those of the nearest outlines, and in ``more`` whether there were others.
    """
    kind = POSTING if across else PLAIN
    found = np.dtype([("a", "<i8"), ("b", "<i8"), ("apart", "<f8")])

    def run(batches):
        held = [raw for batch in batches for raw in batch.column("raw").to_pylist()]
        rows = np.frombuffer(b"".join(held), kind)
        held.clear()
        best, more = np.empty(0, found), np.empty(0, np.int64)
        for a, b in _pairs(rows, across):
            if outlines is not None:
                apart = np.zeros(len(a))
                fits = outlines.value.may_be_similar(a, outlines.value, b, percent, apart)
                a, b, apart = a[fits], b[fits], apart[fits]
                if few:
                    new = np.empty(len(a), found)
                    new["a"], new["b"], new["apart"] = a, b, apart
                    best, others = _nearest(np.concatenate([best, new]), few)
                    more = np.union1d(more, others)
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], ["a", "b", "more"])
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best["a"]), pa.array(best["b"]), pa.array(np.isin(best["b"], more))], ["a", "b", "more"])
        rows = a = b = None
        tidy()

    met = dealt.repartition(parts, "part").mapInArrow(run, "a bigint, b bigint, more boolean")
    return met.groupBy("a", "b").agg(F.max("more").alias("more"))


def task_count(spark, postings: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // POSTINGS_A_TASK))


def sent_table(nodes: DataFrame, total: int):
    """The table of frequencies, broadcast: at most 16 MB."""
    bits = table_bits(total)
    return nodes.sparkSession.sparkContext.broadcast(frequencies(nodes, bits)), bits


