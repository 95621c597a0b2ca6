"""Language-model scoring with a log-frequency Bloom filter.

Training counts all words and all runs of two and three neighbouring words of the training documents. The count of a run is quantised on a
logarithmic scale: level q holds counts from 2 ** (q - 1) on. A run enters the filter once for each of its levels, so its level is read
by asking for level 1, 2, ... until one is missing (Talbot and Osborne, "Smoothed Bloom Filter Language Models"). All probes of an
entry fall into one word of 64 bits. Words are counted exactly: a sorted table of 64-bit hashes and counts.

The model interpolates by Dirichlet priors, from one order to the next: P(w | u v) = (c(uvw) + m P(w | v)) / (c(uv) + m), P(w | v) = (c(vw) + m P(w)) / (c(v) + m),
P(w) = (c(w) + 1) / (N + V + 1). In a numerator a run has the least count of its level, in a denominator the greatest, so the sum over w
never exceeds 1 but for false positives of the filter. A text is its words and one end; its first two tokens have shorter histories.

Scale. Tasks count their own texts and deal the counts out in a few binary rows each, by the hash of the whole run, so that no word, however frequent, makes
a large shard. What a shard sums up is about ``shard_entries`` counts, as there are as many shards as the input needs. Each shard becomes a word table
and a segment of the filter, written as one file in the shared folder.

* ``train_and_score`` deals the words and runs of all texts once, those of held-out ones with a count of 0. A shard's task, which has the runs of each batch of texts before
  it, builds its segment of the filter and returns the levels it finds there in the same order, in about half a byte a run, and the counts of the words. The answers
  of a batch become one file, named by a digest of its words and runs, which the task that scores the batch looks up. Texts aren't moved or stored, runs are moved once, and
  no worker holds the model, so each GB costs the same at every size. Where rows come in another order when they are read again, their batches find no file; these are scored by ``score``.
* ``score`` has only the model. Up to ``broadcast_bytes`` it goes to every worker whole: it is packed into one file of the shared folder, which tasks map, so workers of one machine
  share its pages where the folder is mounted, and nothing passes through the driver. Beyond that the corpus is tokenised once; each batch of texts sends its distinct
  words and runs to their shards, each shard's task probes its own segment, and the answers meet the batch again. That moves a fixed amount for each token, but several times as much.

All ways give the same scores. Defined results: a null text is an empty one and scores its end token. A null id counts as a training row, as its
text "" has remainder 0. Rows that repeat an id each have their own result. Without training tokens N = V = 0. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import files
from textloom.llm.chunks import parts
from textloom.llm.common import tidy, word_hashes
from textloom.session import ship
from textloom.storage import discard, materialise, new_path

#: The end of a text, which no word can equal, as it is white space.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
PRIOR = 100.0
BITS_PER_ENTRY = 12
PROBES = 4
SHARD_ENTRIES = 2_000_000
BROADCAST_BYTES = 1 << 29
COUNTED_TOKENS = 700_000
SCORED_BYTES = 1_500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
#: Within its shard a run is told from others by the lowest five bytes of its hash.
RUN_BYTES = 5
_RUN = np.uint64((1 << 8 * RUN_BYTES) - 1)
#: Bytes of a sorted run or word that are kept as they are; bits of counts and levels, the last for those that don't fit the ones before.
RUN_LOW, WORD_LOW = 4, 6
DEALT_BITS, COUNT_BITS, LEVEL_BITS = (2, 8, 64), (8, 16, 64), (4, 8)


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> _HALF)


class Tokens:
    """The tokens of some texts: ``h``, their hashes end to end; ``starts`` and ``sizes`` of the texts; ``nth``, each token's place in its text."""

    def __init__(self, texts: pa.Array):
        unique, codes, sizes = word_hashes(texts)
        ends = np.cumsum(sizes)
        self.unique = np.append(unique, END)
        self.codes = np.insert(codes, ends, len(unique))
        self._place(sizes + 1)

    @classmethod
    def of(cls, unique: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> Tokens:
        self = cls.__new__(cls)
        self.unique, self.codes = unique, codes
        self._place(sizes)
        return self

    def _place(self, sizes: np.ndarray) -> None:
        self.sizes, self.h = sizes, self.unique[self.codes]
        self.starts = np.cumsum(sizes) - sizes
        self.nth = np.arange(len(self.h)) - np.repeat(self.starts, sizes)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of two and of three tokens that end at each token; where there is none, whatever comes out."""
        two = np.zeros(len(self.h), np.uint64)
        two[1:] = _mixed((self.h[:-1] * _ODD) ^ self.h[1:])
        three = np.zeros(len(self.h), np.uint64)
        three[2:] = _mixed((two[1:-1] * _ODD) ^ self.h[2:])
        return two, three


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards follow the order of the hashes."""
    return (((h >> _HALF) * np.uint64(shards)) >> _HALF).astype(np.int64)


def _bounds(h: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted hashes."""
    return np.searchsorted(shard_of(h, shards), np.arange(shards + 1))


def _squeezed(v: np.ndarray, low: int, high: int) -> bytes:
    """Sorted numbers below ``high << 8 * low``: their ``low`` lowest bytes, then a bit for each number and for each step of what is above (Elias and Fano)."""
    bits = np.zeros(len(v) + high, bool)
    bits[np.arange(len(v)) + (v >> np.uint64(8 * low)).astype(np.int64)] = True
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes() + np.packbits(bits).tobytes()


def _unsqueezed(data, low: int, high: int) -> np.ndarray:
    n = (8 * len(data) - high) // (8 * low + 1)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(data[: n * low], np.uint8).reshape(n, low)
    above = np.flatnonzero(np.unpackbits(np.frombuffer(data[n * low :], np.uint8))) - np.arange(n)
    return out.view("<u8").reshape(-1) + (above.astype(np.uint64) << np.uint64(8 * low))


def _small(n: np.ndarray, *widths: int) -> bytes:
    """Numbers that mostly are small, in so many bits each; those that don't fit follow in the next width. The last width must hold any."""
    width, rest = widths[0], widths[1:]
    top = (1 << width) - 1
    few = np.minimum(n, top) if rest else n
    if width >= 8:
        data = few.astype(f"<u{width // 8}").tobytes()
    else:
        per = 8 // width
        held = np.zeros(-(-len(few) // per) * per, np.uint8)
        held[: len(few)] = few
        data = np.bitwise_or.reduce([held[k::per] << (width * k) for k in range(per)]).tobytes()
    more = n[n >= top] if rest else n[:0]
    return data + (_small(more, *rest) if len(more) else b"")


def _unsmall(data, n: int, *widths: int) -> np.ndarray:
    width, rest = widths[0], widths[1:]
    top, size = (1 << width) - 1, -(-n * width // 8)
    if width >= 8:
        out = np.frombuffer(data[:size], f"<u{width // 8}").astype(np.int64)
    else:
        held = np.frombuffer(data[:size], np.uint8)
        out = np.stack([(held >> (width * k)) & top for k in range(8 // width)], axis=1).reshape(-1)[:n].astype(np.int64)
    if rest and len(more := np.flatnonzero(out == top)):
        out[more] = _unsmall(data[size:], len(more), *rest)
    return out


def _word_range(shards: int) -> tuple[list[int], int]:
    """The least hash of each shard, and how many values what stands above the kept bytes of a word's distance from it can take."""
    return [-(-(k << 32) // shards) << 32 for k in range(shards)], (-(-(1 << 32) // shards) >> (8 * WORD_LOW - 32)) + 1


def _run_keys(h: np.ndarray, shards: int) -> np.ndarray:
    """By these runs are told from others: shard and lowest bytes."""
    return (shard_of(h, shards).astype(np.uint64) << np.uint64(8 * RUN_BYTES)) | (h & _RUN)


def _digest(words: np.ndarray, keys: np.ndarray) -> bytes:
    """The name of a batch, by its sorted distinct words and runs."""
    h = xxhash.xxh3_128(words.tobytes())
    h.update(keys.tobytes())
    return h.digest()


def _gathered(batches):
    """Neighbouring rows with about COUNTED_TOKENS tokens, as lists of tokens and the rows they come from. Rows in the same order give the same lists."""
    held, size = [], 0
    for batch in batches:
        at = 0
        for texts in parts(batch.column("text")):
            t = Tokens(texts)
            held.append((t, batch.slice(at, len(texts))))
            at, size = at + len(texts), size + len(t.h)
            if size >= COUNTED_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    if not len(h):
        return h, n.astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    return h[first], np.add.reduceat(n, first)


DEALT = "shard bigint, batch binary, words binary, word_n binary, runs binary, run_n binary"


def _dealt(shards: int):
    """The distinct words and runs of a few MB of text at a time, with their counts in rows that are learned from, as one row for each shard."""
    least, above = _word_range(shards)

    def run(batches):
        for held in _gathered(batches):
            words, runs = [], []
            for t, rows in held:
                learned = np.repeat(rows.column("learned").to_numpy(zero_copy_only=False), t.sizes)
                words.append((t.unique, np.bincount(t.codes[learned], minlength=len(t.unique))))
                for h, at in zip(t.runs(), (t.nth > 0, t.nth > 1), strict=True):
                    runs.append((_run_keys(h[at], shards) << np.uint64(1)) | learned[at])
            one, n = _summed(*map(np.concatenate, zip(*words, strict=True)))
            many = np.concatenate(runs)
            many.sort()
            m, many = (many & np.uint64(1)).astype(np.int64), many >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], many[1:] != many[:-1]])) if len(many) else np.empty(0, np.int64)
            many, m = many[first], np.add.reduceat(m, first) if len(many) else m
            a, b = _bounds(one, shards), np.searchsorted(many, np.arange(shards + 1, dtype=np.uint64) << np.uint64(8 * RUN_BYTES))
            name, low = _digest(one, many), many & _RUN
            some = [k for k in range(shards) if a[k] < a[k + 1] or b[k] < b[k + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([name] * len(some), pa.binary()),
                    pa.array([_squeezed(one[a[k] : a[k + 1]] - np.uint64(least[k]), WORD_LOW, above) for k in some], pa.binary()),
                    pa.array([_small(n[a[k] : a[k + 1]], *DEALT_BITS) for k in some], pa.binary()),
                    pa.array([_squeezed(low[b[k] : b[k + 1]], RUN_LOW, 1 << 8 * (RUN_BYTES - RUN_LOW)) for k in some], pa.binary()),
                    pa.array([_small(m[b[k] : b[k + 1]], *DEALT_BITS) for k in some], pa.binary()),
                ],
                ["shard", "batch", "words", "word_n", "runs", "run_n"],
            )
        tidy()

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def least_count(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.ldexp(0.5, level), 0)


def greatest_count(level: np.ndarray) -> np.ndarray:
    return np.ldexp(1.0, level) - 1


def _places(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry at a level a hash that tells its word of the filter, and the bits of its probes there."""
    x = _mixed(h ^ np.uint64((level * 0xA24BAED4963EE407) & 0xFFFFFFFFFFFFFFFF))
    y, mask = x * _ODD, np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << ((y >> np.uint64(58 - 6 * k)) & np.uint64(63))
    return x >> _HALF, mask


def build_filter(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The filter's words of 64 bits, and how many entries went in. ``h``: the runs' hashes, cut to their lowest bytes."""
    q = levels(counts) if len(h) else np.empty(0, np.int64)
    entries = int(q.sum())
    size = max(1, -(-entries * BITS_PER_ENTRY // 64))
    out = np.zeros(size, np.uint64)
    for level in range(1, int(q.max(initial=0)) + 1):
        where, mask = _places(h[q >= level], level)
        where = (where * np.uint64(size) >> _HALF).astype(np.int64)
        order = np.argsort(where, kind="stable")
        where, mask = where[order], mask[order]
        first = np.nonzero(np.concatenate([[True], where[1:] != where[:-1]]))[0]
        out[where[first]] |= np.bitwise_or.reduceat(mask, first)
    return out, entries


class Model:
    """Word tables and filter segments of some neighbouring shards, from ``first`` on, of ``shards`` in all."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, filter_: np.ndarray, size: np.ndarray, shards: int, first: int = 0):
        self.words, self.counts, self.filter = words, counts, filter_
        self.shards, self.first, self.size = shards, first, size.astype(np.uint64)
        self.base = (np.cumsum(size) - size).astype(np.int64)

    @classmethod
    def packed(cls, data: pa.Buffer) -> Model:
        """From the bytes that _packed writes; the arrays are views of them."""
        n, shards = np.frombuffer(data, "<i8", 2).tolist()
        size, at = np.frombuffer(data, "<i8", shards, 16), 16 + 8 * shards
        return cls(np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n), np.frombuffer(data, "<u8", int(size.sum()), at + 16 * n), size, shards)

    def count(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)

    def level(self, runs: np.ndarray) -> np.ndarray:
        """The level of each run, 0 for those not in the filter."""
        return self.from_level(shard_of(runs, self.shards) - self.first, runs & _RUN, np.zeros(len(runs), np.uint8))

    def from_level(self, shard: np.ndarray, low: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The same of runs cut to their lowest bytes, of which some levels are known to be in the filter."""
        out, base, size = known.copy(), self.base[shard], self.size[shard]
        level = 1
        while len(left := np.flatnonzero(out == level - 1)) or level <= out.max(initial=0):
            where, mask = _places(low[left], level)
            where = base[left] + (where * size[left] >> _HALF).astype(np.int64)
            out[left[self.filter[where] & mask == mask]] = level
            level += 1
        return out


SEGMENT = "shard bigint, path string, tokens bigint, distinct bigint, size bigint"


class Shard:
    """What was dealt to one shard: the sorted distinct words and runs with the sums of their counts, and those of each batch."""

    def __init__(self, shard: int, shards: int, rows: list[tuple]):
        least, above = _word_range(shards)
        self.names, self.batches, counts = [], [], []
        for name, *data in rows:
            words, word_n, runs, run_n = map(memoryview, data)
            w = _unsqueezed(words, WORD_LOW, above) + np.uint64(least[shard])
            h = _unsqueezed(runs, RUN_LOW, 1 << 8 * (RUN_BYTES - RUN_LOW))
            self.names.append(name)
            self.batches.append((w, h))
            counts.append((_unsmall(word_n, len(w), *DEALT_BITS), _unsmall(run_n, len(h), *DEALT_BITS)))
        (words, runs), (n, m) = (map(np.concatenate, zip(*x, strict=True)) for x in (self.batches, counts))
        (self.words, self.n), (self.runs, self.m) = _summed(words, n), _summed(runs, m)
        self.filter = build_filter(self.runs[self.m > 0], self.m[self.m > 0])[0]


def _by_shard(batches):
    """Rows of one shard stand together: the shard and its rows, which are views of the batches that they came in."""
    shard, held = None, []
    for batch in batches:
        columns = [batch.column(c) for c in ("words", "word_n", "runs", "run_n")]
        for i, (s, name) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("batch").to_pylist(), strict=True)):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append((name, *(c[i].as_buffer() for c in columns)))
    if held:
        yield shard, held


def _segments(folder: str, shards: int):
    """The sums of a shard become a word table and a segment of the filter, in one file."""

    def run(batches):
        for shard, rows in _by_shard(batches):
            x = Shard(shard, shards, rows)
            data = b"".join([len(x.words).to_bytes(8, "little"), x.words.tobytes(), x.n.astype("<i8").tobytes(), x.filter.tobytes()])
            path = f"{folder}/{shard:08d}.lm"
            files.write(path, data)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "tokens": [int(x.n.sum())], "distinct": [len(x.words)], "size": [len(data)]})
        tidy()

    return run


REPLIED = "batch binary, shard bigint, tokens bigint, distinct bigint, counts binary, levels binary"


def _replies(shards: int):
    """From what was dealt to a shard: for each batch the counts of its words and the levels of its runs, each with their number before them; and in a row of an empty name the shard's tokens and distinct words."""

    def run(batches):
        for shard, rows in _by_shard(batches):
            x = Shard(shard, shards, rows)
            model = Model(x.words, x.n, x.filter, np.array([len(x.filter)]), shards, shard)
            # up to its own level each run is in the filter, so only what lies above is looked up
            level = model.from_level(np.zeros(len(x.runs), np.int64), x.runs, levels(x.m).astype(np.uint8) if len(x.m) else np.empty(0, np.uint8))
            counts = [len(w).to_bytes(4, "little") + _small(x.n[np.searchsorted(x.words, w)], *COUNT_BITS) for w, _ in x.batches]
            found = [len(h).to_bytes(4, "little") + _small(level[np.searchsorted(x.runs, h)], *LEVEL_BITS) for _, h in x.batches]
            more = [None] * len(x.names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b"", *x.names], pa.binary()),
                    pa.array([shard] * (1 + len(more)), pa.int64()),
                    pa.array([int(x.n.sum()), *more], pa.int64()),
                    pa.array([int((x.n > 0).sum()), *more], pa.int64()),
                    pa.array([None, *counts], pa.binary()),
                    pa.array([None, *found], pa.binary()),
                ],
                ["batch", "shard", "tokens", "distinct", "counts", "levels"],
            )
        tidy()

    return run


def _replied(folder: str, name: bytes) -> str:
    return f"{folder}/{name.hex()}.lm"


def _filed(folder: str):
    """Replies to one batch stand together, in the order of shards, and become one file; batches of one name got the same. Returns tokens and distinct words."""

    def run(batches):
        now, shard, counts, found = b"", None, [], []

        def closed():
            counts_, found_ = (np.concatenate(x) for x in (counts, found))
            data = b"".join([len(counts_).to_bytes(8, "little"), counts_.astype("<i8").tobytes(), found_.astype(np.uint8).tobytes()])
            files.write(_replied(folder, now), len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True))

        for batch in batches:
            tokens, distinct = (batch.column(c).to_pylist() for c in ("tokens", "distinct"))
            for i, (name, s) in enumerate(zip(batch.column("batch").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
                if name != now:
                    if now:
                        closed()
                    now, shard, counts, found = name, None, [], []
                if not name:
                    yield pa.RecordBatch.from_pydict({"tokens": [tokens[i]], "distinct": [distinct[i]]})
                elif s != shard:
                    for out, column, widths in ((counts, "counts", COUNT_BITS), (found, "levels", LEVEL_BITS)):
                        data = memoryview(batch.column(column)[i].as_buffer())
                        out.append(_unsmall(data[4:], int.from_bytes(data[:4], "little"), *widths))
                    shard = s
        if now:
            closed()
        tidy()

    return run


def _segment(path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and filter of a segment; those of an empty one without a path."""
    if path is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1, np.uint64)
    data = files.read(path)
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n), np.frombuffer(data, "<u8", -1, 8 + 16 * n)


def _learned_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.when(F.col("learned"), F.octet_length("text")))).first()[0] or 0


def _by_shards(rows: DataFrame, size: int, shard_entries: int) -> tuple[DataFrame, int]:
    """The words and runs of some rows (text, learned) dealt to shards, and the number of these; ``size``: bytes of text to learn from."""
    # about three runs for each ten bytes at most are new
    runs = size * 0.3
    # very large inputs get larger shards, up to what a task can sum up, so that batches and shards don't multiply to more rows than need be
    shards = 32 * max(1, math.ceil(runs / min(4 * shard_entries, max(shard_entries, runs / 20_000)) / 32))
    return rows.mapInArrow(_dealt(shards), DEALT).repartition(_shuffled(rows, shards), "shard").sortWithinPartitions("shard"), shards


def _shuffled(rows: DataFrame, shards: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 4)


def train(docs: DataFrame, text_col: str = "text", shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """The segments of the model: one row per shard that isn't empty, with the number of shards; the files are in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.lit(True).alias("learned"))
    dealt, shards = _by_shards(rows, _learned_bytes(rows), shard_entries)
    folder = new_path(spark, "lm-segments")
    model = materialise(dealt.mapInArrow(_segments(folder, shards), SEGMENT).withColumn("shards", F.lit(shards).cast("bigint")), "lm-model")
    model.segments = folder
    return model


def _packed(path: str, shards: int):
    """One task writes all segments as one file, no more than the broadcast limit lets through."""

    def run(batches):
        paths: list[str | None] = [None] * shards
        for batch in batches:
            for k, p in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist(), strict=True):
                paths[k] = p
        words, counts, filters = zip(*map(_segment, paths), strict=True)
        head = [sum(map(len, words)), shards, *map(len, filters)]
        files.write(path, b"".join([np.array(head, "<i8").tobytes(), *(x.tobytes() for part in (words, counts, filters) for x in part)]))
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return run


SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"
NAMES = ("doc_id", "n_tokens", "n_known", "base_score", "score")


def _scores(doc_ids: pa.Array, t: Tokens, counts: np.ndarray, two: np.ndarray, three: np.ndarray, total: int, distinct: int, prior: float) -> pa.RecordBatch:
    """The documents' results, from the counts of their distinct words and the levels of the runs that end at each token."""
    c = counts[t.codes]
    p1 = (c + 1) / (total + distinct + 1)
    p = p1.copy()
    i = np.nonzero(t.nth > 0)[0]
    p[i] = (least_count(two[i].astype(np.int32)) + prior * p1[i]) / (c[i - 1] + prior)
    i = np.nonzero(t.nth > 1)[0]
    p[i] = (least_count(three[i].astype(np.int32)) + prior * p[i]) / (greatest_count(two[i - 1].astype(np.int32)) + prior)
    sums = [np.add.reduceat(x, t.starts) for x in (np.log10(p1), np.log10(p))]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(t.sizes), pa.array(np.add.reduceat(c > 0, t.starts, dtype=np.int64)), *map(pa.array, sums)], NAMES)


def _scored(path: str, total: int, distinct: int, prior: float):
    """Against the whole model."""

    def run(batches):
        model = Model.packed(files.mapped(path))
        for batch in batches:
            at = 0
            for texts in parts(batch.column("text"), SCORED_BYTES):
                t = Tokens(texts)
                two, three = t.runs()
                level = [np.zeros(len(t.h), np.uint8) for _ in range(2)]
                for out, h, least in ((level[0], two, 1), (level[1], three, 2)):
                    i = t.nth >= least
                    out[i] = model.level(h[i])
                yield _scores(batch.column("doc_id").slice(at, len(texts)), t, model.count(t.unique), *level, total, distinct, prior)
                at += len(texts)
        del model
        tidy()

    return run


ASKED = "batch bigint, shard bigint, doc_ids array<bigint>, sizes array<bigint>, words binary, runs binary"
ANSWERED = "batch bigint, shard bigint, doc_ids array<bigint>, sizes array<bigint>, words binary, runs binary, counts binary, levels binary"


def _asked(shards: int):
    """For each batch of texts a row of its own, with shard -1 and its tokens, and a row for each shard with the words and runs it must be asked for."""
    schema = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("runs", pa.binary())])

    def run(batches):
        nth = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for texts in parts(batch.column("text"), SCORED_BYTES):
                t = Tokens(texts)
                words, runs = _questions(t)
                a, b = _bounds(words, shards), _bounds(runs, shards)
                some = [k for k in range(shards) if a[k] < a[k + 1] or b[k] < b[k + 1]]
                none = [None] * len(some)
                yield pa.RecordBatch.from_pydict(
                    {
                        "batch": [nth] * (1 + len(some)),
                        "shard": [-1, *some],
                        "doc_ids": [batch.column("doc_id").slice(at, len(texts)).to_pylist(), *none],
                        "sizes": [t.sizes, *none],
                        "words": [t.unique.tobytes(), *(words[a[k] : a[k + 1]].tobytes() for k in some)],
                        "runs": [t.codes.astype("<i4").tobytes(), *(runs[b[k] : b[k + 1]].tobytes() for k in some)],
                    },
                    schema,
                )
                nth, at = nth + 1, at + len(texts)

    return run


def _questions(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and runs of some tokens, in the order of shards."""
    two, three = t.runs()
    return np.unique(t.unique), np.unique(np.concatenate([two[t.nth > 0], three[t.nth > 1]]))


def _answers(shards: int):
    """Rows of one shard stand together, its segment's path first, with batch -1: the words and runs asked for become counts and levels."""
    none = pa.array([None], pa.list_(pa.int64()))

    def run(batches):
        model, shard = None, None
        for batch in batches:
            for i, (b, s) in enumerate(zip(batch.column("batch").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
                if s != shard:
                    shard = s
                    words, counts, filter_ = _segment(batch.column("words")[i].as_py().decode() if b < 0 else None)
                    model = Model(words, counts, filter_, np.array([len(filter_)]), shards, s)
                if b >= 0:
                    words, runs = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in ("words", "runs"))
                    found = (pa.array([x.tobytes()], pa.binary()) for x in (model.count(words).astype("<i8"), model.level(runs)))
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([s]), none, none, pa.array([None], pa.binary()), pa.array([None], pa.binary()), *found], names=["batch", "shard", "doc_ids", "sizes", "words", "runs", "counts", "levels"])

    return run


def _met(total: int, distinct: int, prior: float):
    """Rows of one batch stand together, its tokens first, then the answers in the order of shards."""

    def run(batches):
        held: tuple | None = None
        counts, found = [], []

        def closed():
            doc_ids, t = held
            words, runs = _questions(t)
            at = np.searchsorted(words, t.unique)
            levels_ = np.append(np.frombuffer(b"".join(found), np.uint8), np.uint8(0))
            two, three = (levels_[np.minimum(np.searchsorted(runs, h), len(runs))] for h in t.runs())
            return _scores(doc_ids, t, np.frombuffer(b"".join(counts), "<i8")[at], two, three, total, distinct, prior)

        for batch in batches:
            for i, s in enumerate(batch.column("shard").to_pylist()):
                if s < 0:
                    if held:
                        yield closed()
                    counts, found = [], []
                    t = Tokens.of(*(np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("words", "<u8"), ("runs", "<i4"))), batch.column("sizes")[i].values.to_numpy())
                    held = (batch.column("doc_ids")[i].values, t)
                else:
                    counts.append(batch.column("counts")[i].as_py())
                    found.append(batch.column("levels")[i].as_py())
        if held:
            yield closed()

    return run


def score(docs: DataFrame, model: DataFrame, prior: float = PRIOR, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", last: bool = False) -> DataFrame:
    """Per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score. With ``last`` the model's segments go once they are packed."""
    spark = docs.sparkSession
    ship(spark)
    n, v, size, shards = model.agg(F.sum("tokens"), F.sum("distinct"), F.sum("size"), F.max("shards")).first()
    n, v, size, shards = n or 0, v or 0, size or 0, shards or 1
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if size <= broadcast_bytes:
        path = f"{new_path(spark, 'lm-model')}/model.lm"
        model.select("shard", "path").coalesce(1).mapInArrow(_packed(path, shards), "path string").collect()
        if last:
            discard(model.segments)
        out = rows.mapInArrow(_scored(path, n, v, prior), SCORED)
    else:
        asked = materialise(rows.mapInArrow(_asked(shards), ASKED), "lm-asked")
        no = F.lit(None)
        segments = model.select(F.lit(-1).cast("bigint").alias("batch"), "shard", no.cast("array<bigint>").alias("doc_ids"), no.cast("array<bigint>").alias("sizes"), F.col("path").cast("binary").alias("words"), no.cast("binary").alias("runs"))
        shuffled = _shuffled(rows, shards)
        dealt = segments.union(asked.filter("shard >= 0")).repartition(shuffled, "shard").sortWithinPartitions("shard", "batch")
        answered = materialise(dealt.mapInArrow(_answers(shards), ANSWERED), "lm-answers")
        own = asked.filter("shard < 0").select("*", no.cast("binary").alias("counts"), no.cast("binary").alias("levels"))
        out = own.union(answered).repartition(shuffled, "batch").sortWithinPartitions("batch", "shard").mapInArrow(_met(n, v, prior), SCORED)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def _scored_by_files(folder: str, shards: int, total: int, distinct: int, prior: float):
    """Against the replies to the batches; rows whose batch has none come back with their text, which is null in all others."""

    def run(batches):
        for held in _gathered(batches):
            runs = [_run_keys(h[at], shards) for t, _ in held for h, at in zip(t.runs(), (t.nth > 0, t.nth > 1), strict=True)]
            words = np.unique(np.concatenate([t.unique for t, _ in held]))
            many, place = np.unique(np.concatenate(runs), return_inverse=True)
            path = _replied(folder, _digest(words, many))
            if not files.there(path):
                for _, rows in held:
                    none = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *none, pc.fill_null(rows.column("text"), "")], [*NAMES, "text"])
                continue
            data = files.read(path)
            data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
            n = int.from_bytes(data[:8], "little")
            counts, found, at = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, np.uint8, -1, 8 + 8 * n)[place] if len(many) else np.empty(0, np.uint8), 0
            for t, rows in held:
                level = [np.zeros(len(t.h), np.uint8) for _ in range(2)]
                for out, least in zip(level, (1, 2), strict=True):
                    i = t.nth >= least
                    size = int(i.sum())
                    out[i] = found[at : at + size]
                    at += size
                scores = _scores(rows.column("doc_id"), t, counts[np.searchsorted(words, t.unique)], *level, total, distinct, prior)
                yield pa.RecordBatch.from_arrays([*scores.columns, pa.nulls(rows.num_rows, pa.string())], [*NAMES, "text"])
        tidy()

    return run


def _train_and_score_at_once(rows: DataFrame, size: int, shard_entries: int, prior: float) -> DataFrame:
    """Rows (doc_id, text, learned) scored by the replies of shards to their batches."""
    spark = rows.sparkSession
    folder = new_path(spark, "lm-replies")
    dealt, shards = _by_shards(rows, size, shard_entries)
    replies = dealt.mapInArrow(_replies(shards), REPLIED).repartition(_shuffled(rows, shards), "batch").sortWithinPartitions("batch", "shard")
    n, v = replies.mapInArrow(_filed(folder), "tokens bigint, distinct bigint").agg(F.sum("tokens"), F.sum("distinct")).first()
    n, v = n or 0, v or 0
    out = materialise(rows.mapInArrow(_scored_by_files(folder, shards, n, v, prior), f"{SCORED}, text string"), "lm-scores")
    discard(folder)
    scored = out.filter("text is null").select(*NAMES, F.lit(n).cast("bigint").alias("train_tokens"))
    late = out.filter("text is not null").select("doc_id", "text")
    if late.isEmpty():
        return scored
    model = train(rows.filter("learned"), "text", shard_entries)
    return scored.unionByName(score(late, model, prior))


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_entries: int = SHARD_ENTRIES, prior: float = PRIOR, broadcast_bytes: int = 0) -> DataFrame:
    """Learns from the rows that aren't held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts to learn from of up to ``broadcast_bytes`` are scored by a model that goes to every worker whole.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col)).alias("learned"))
    size = _learned_bytes(rows)
    if 0 < size <= broadcast_bytes:  # a model takes less than its text
        model = train(docs.filter(~held_out(id_col)), text_col, shard_entries)
        scored = score(docs, model, prior, broadcast_bytes, id_col, text_col, last=True)
    else:
        scored = _train_and_score_at_once(rows, size, shard_entries, prior)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
