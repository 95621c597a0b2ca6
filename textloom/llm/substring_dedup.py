"""Repeated passages: content-defined chunks by a gear rolling hash find them, hashes of whole windows of words confirm them.

``repeated_passages`` finds every run of ``least_words`` words (51: a passage of over 50) whose bytes, with the white space between the words, a document of smaller
id has too.

1. Chunks. A gear hash rolls over the bytes. In every run of half as many words the place of its least value is a cut. So cuts come back after
   insertions, they are about as dense as the words, and a passage has one in its first half and another in its second: equal passages
   have the same cuts from the first of these to the last, and at least one whole chunk between them.
2. Digests. Chunks are keyed by a 64-bit digest. Those that only one text has are out; the table of shared digests is joined back to the chunks.
3. Confirmation. A window of ``least_words`` words may repeat only if all chunks between its first and its last sure cut are shared. The
   windows left are hashed whole and counted; repeated windows that overlap are one passage.

Nothing is lost whatever the length of the words. Two different windows, or whole texts, are taken for one only if their 64-bit hashes agree.
Of equal texts only the one of the smallest id goes through steps 2 and 3; each other is one passage from its first word to its last.

Digests and windows are counted with partial aggregation and joined back, joins that Spark splits where one passage is very common. Passages are formed
within a document, whose size bounds them.

Defined results: null and empty texts have no passages. Repeats inside one document count only with ``within``. Rows that repeat an id are documents of their own, each
compared with those of smaller ids; equal ones are one. A null id takes no part. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.chunks import parts
from textloom.llm.common import fresh, map_batches
from textloom.operators.joins import splittable_join
from textloom.session import ship
from textloom.storage import materialise

#: A passage of over 50 words.
PASSAGE_WORDS = 51
PART_BYTES = 1_500_000
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.uint64(0xFFFFFFFF)


def gear(data: np.ndarray, size: int) -> np.ndarray:
    """h = 2 h + G[byte] in 32 bits, rolled over the ``size`` bytes (a power of two up to 32) from each place on, by doubling the stretch."""
    h, k = _GEAR[data], 1
    while k < size:
        h = (h[:-k] << np.uint32(k)) + h[k:]
        k *= 2
    return h


def least_places(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range from a start to an end (exclusive) the place of the least hash inside it; the last of equal ones."""
    n = ends - starts
    level = (h.astype(np.uint64) << np.uint64(32)) | (_LOW - np.arange(len(h), dtype=np.uint64))
    log = np.frexp(n.astype(np.float64))[1] - 1
    out = np.empty(len(n), np.uint64)
    for j in range(int(log.max(initial=-1)) + 1):  # level[i] is the least of the 2 ** j from i on
        if j:
            half = 1 << (j - 1)
            level = np.minimum(level[:-half], level[half:])
        pick = np.nonzero(log == j)[0]
        out[pick] = np.minimum(level[starts[pick]], level[ends[pick] - (1 << j)])
    return (_LOW - (out & _LOW)).astype(np.int64)


class Cut:
    """Some texts, cut. ``data``: their bytes end to end; ``at``: where each begins there; ``starts``, ``ends``, ``doc``: words and their texts; ``first_word``, ``words``: of each
    text; ``cuts``: all cuts, in order; ``first_cut``: of each text; ``surely``: the cut that each run of half as many words has, -1 for runs that leave their text."""

    def __init__(self, texts: list[bytes], least_words: int):
        if least_words < 2:
            raise ValueError("a passage has two words at least")
        self.least, self.half = least_words, least_words // 2
        self.raw = b"".join(texts)
        self.data = data = np.frombuffer(self.raw, np.uint8)
        self.at = np.cumsum([0, *map(len, texts)])
        blank = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.at] = True
        self.starts = np.nonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])[: len(data)]))[0]
        self.ends = np.nonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]])[: len(data)]))[0] + 1
        self.doc = np.searchsorted(self.at, self.starts, side="right") - 1
        self.first_word = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.words = np.diff(self.first_word)
        half = self.half
        runs = max(0, len(self.starts) - half + 1)
        inside = np.nonzero((self.doc[:runs] == self.doc[half - 1 :][:runs]) & (self.words[self.doc[:runs]] >= least_words))[0]
        size = min(32, 1 << ((2 * half - 1).bit_length() - 1))  # no run of half as many words is shorter
        places = least_places(gear(data, size), self.starts[inside], self.ends[inside + half - 1] - size + 1) if len(inside) else inside
        self.cuts, nth = np.unique(places, return_inverse=True)
        self.surely = np.full(runs, -1)
        self.surely[inside] = nth
        self.first_cut = np.searchsorted(self.cuts, self.at)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of each chunk: its text, its number there, its digest."""
        doc = np.searchsorted(self.at, self.cuts, side="right") - 1
        whole = np.nonzero(doc[:-1] == doc[1:])[0]
        digests = [xxhash.xxh3_64_intdigest(self.raw[a:b]) for a, b in zip(self.cuts[whole].tolist(), self.cuts[whole + 1].tolist(), strict=True)]
        return doc[whole], whole - self.first_cut[doc[whole]], digests

    def windows(self, shared: list[np.ndarray]) -> np.ndarray:
        """First words of the windows whose chunks, from their first sure cut to their last, all are shared. ``shared``: the chunks' numbers, for each text."""
        some = np.zeros(len(self.cuts), bool)
        some[np.concatenate([s + c for s, c in zip(shared, self.first_cut, strict=False)]).astype(np.int64)] = True
        missing = np.concatenate([[0], np.cumsum(~some)])
        n = max(0, len(self.starts) - self.least + 1)
        first, last = self.surely[:n], self.surely[self.least - self.half :][:n]
        inside = (self.doc[:n] == self.doc[self.least - 1 :][:n]) & (first >= 0) & (last >= 0)
        return np.nonzero(inside & (missing[last] == missing[first]))[0]


CHUNK = "doc_id bigint, key bigint, nth int, digest bigint, first int, last int"


def _texts(batch: pa.RecordBatch):
    """Parts of a batch: the place of its first row, and its texts as bytes."""
    at = 0
    for texts in parts(batch.column("text"), PART_BYTES):
        yield at, texts.cast(pa.binary()).to_pylist()
        at += len(texts)


def _chunked(least_words: int):
    """One row for each chunk, and for each text of enough words one with nth = -words and the bytes where its first word begins and its last one ends."""
    kinds = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("nth", pa.int32()), ("digest", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def make():
        def each(batch: pa.RecordBatch):
            for at, texts in _texts(batch):
                cut = Cut(texts, least_words)
                keys, ids = batch.column("key").slice(at, len(texts)), batch.column("doc_id").slice(at, len(texts))
                long = np.nonzero(cut.words >= least_words)[0]
                first, last = cut.starts[cut.first_word[long]] - cut.at[long], cut.ends[cut.first_word[long + 1] - 1] - cut.at[long]
                none = pa.nulls(len(long), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(long)), keys.take(pa.array(long)), pa.array(-cut.words[long].astype(np.int32)), none, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], schema=kinds)
                doc, nth, digests = cut.chunks()
                none = pa.nulls(len(doc), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), keys.take(pa.array(doc)), pa.array(nth.astype(np.int32)), pa.array(np.array(digests, np.uint64).view(np.int64)), none, none], schema=kinds)

        return each

    return make


def _hashed(least_words: int):
    """The windows that may repeat, by the shared chunks of their text."""

    def make():
        def each(batch: pa.RecordBatch):
            for at, texts in _texts(batch):
                cut = Cut(texts, least_words)
                i = cut.windows([batch.column("shared")[at + k].values.to_numpy() for k in range(len(texts))])
                starts, ends, doc = cut.starts[i], cut.ends[i + least_words - 1], cut.doc[i]
                h = [xxhash.xxh3_64_intdigest(cut.raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids, keys = (batch.column(c).slice(at, len(texts)).take(pa.array(doc)) for c in ("doc_id", "key"))
                ints = [pa.array(x.astype(np.int32)) for x in (i - cut.first_word[doc], starts - cut.at[doc], ends - cut.at[doc])]
                yield pa.RecordBatch.from_arrays([ids, keys, *ints, pa.array(np.array(h, np.uint64).view(np.int64))], ["doc_id", "key", "nth", "start", "end", "hash"])

        return each

    return make


def _passages(docs: DataFrame, least_words: int, within: bool, id_col: str, text_col: str) -> DataFrame:
    """Passages with the ``key`` of their text: an id may have several."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    cut = materialise(map_batches(rows, _chunked(least_words), CHUNK), "chunks")
    texts = cut.filter("nth < 0").select("doc_id", "key", "first", "last", -F.col("nth")).toDF("doc_id", "key", "first", "last", "words").distinct()
    reps = texts.groupBy("key").agg(F.min("doc_id").alias("rep"))

    chunks = cut.filter("nth >= 0").select("key", "nth", "digest")
    shared = chunks.groupBy("digest").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n > 1" if within else "lo < hi").select("digest")
    met = splittable_join(chunks, shared, "digest").groupBy("key").agg(F.collect_set("nth").alias("shared"))
    seeds = met.join(reps, "key").select(F.col("rep").alias("doc_id"), "key", "shared")
    windows = map_batches(rows.join(seeds.hint("merge"), ["doc_id", "key"]), _hashed(least_words), "doc_id bigint, key bigint, nth int, start int, end int, hash bigint")
    windows = materialise(windows, "windows")
    least = windows.groupBy("hash").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_id")).filter(F.lit(within) | (F.col("first_doc_id") < F.col("last_id"))).drop("last_id")
    known = splittable_join(windows, least, "hash")
    if within:
        # or else the document itself has it, so far before that the two don't overlap
        own = windows.groupBy("doc_id", "key", "hash").agg(F.min("nth").alias("first_nth"), F.max("nth").alias("last_nth")).filter(F.col("last_nth") - F.col("first_nth") >= least_words).drop("last_nth")
        known = splittable_join(known, own, "doc_id", "key", "hash", how="left").filter((F.col("first_doc_id") < F.col("doc_id")) | (F.col("nth") - F.col("first_nth") >= least_words)).drop("first_nth")
    else:
        known = known.filter("first_doc_id < doc_id")
    hits = known.drop("hash")

    w = Window.partitionBy("doc_id", "key").orderBy("nth")
    begins = F.coalesce(F.col("nth") - F.lag("nth").over(w) >= least_words, F.lit(True)).cast("int")
    runs = hits.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w)).groupBy("doc_id", "key", "run")
    words = (F.max("nth") - F.min("nth") + least_words).alias("words")
    runs = runs.agg(F.min("start").cast("bigint").alias("start"), F.max("end").cast("bigint").alias("end"), words.cast("bigint"), F.min_by("first_doc_id", "nth").alias("first_doc_id"))
    firsts = splittable_join(windows.filter("nth = 0"), least, "hash").filter("first_doc_id < doc_id").groupBy(F.col("doc_id").alias("rep"), "key").agg(F.min("first_doc_id").alias("first_doc_id"))
    copies = splittable_join(splittable_join(texts, reps, "key").filter("doc_id > rep"), firsts, "rep", "key", how="left")
    copies = copies.select("doc_id", "key", F.col("first").cast("bigint").alias("start"), F.col("last").cast("bigint").alias("end"), F.col("words").cast("bigint").alias("words"), F.coalesce("first_doc_id", "rep").alias("first_doc_id"))
    return runs.drop("run").union(copies)


def repeated_passages(docs: DataFrame, least_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """Passages of at least ``least_words`` words that a document of smaller id has too: doc_id, start, end (bytes of the text in UTF-8), words, first_doc_id (the least that has the first words).

    ``within``: those too that the document itself has before, without overlap; its own id then is the first.
    """
    return _passages(docs, least_words, within, id_col, text_col).drop("key")


def without_repeats(docs: DataFrame, least_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """The documents with their own columns, repeated spans cut out of the text; the first holder keeps each passage."""
    k, h, s = fresh(docs, "span_id", "span_key", "spans")
    spans = _passages(docs, least_words, within, id_col, text_col).groupBy(F.col("doc_id").alias(k), F.col("key").alias(h)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(s))
    joined = docs.join(spans, (F.col(id_col) == F.col(k)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(h)), "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        def one(t, sp):
            if t is None or sp is None:
                return t
            raw, out, last = t.encode(), [], 0
            for x in sp:
                out.append(raw[last : x["start"]])
                last = x["end"]
            return b"".join([*out, raw[last:]]).decode("utf-8", "ignore")

        return pd.Series([one(t, sp) for t, sp in zip(texts, spans, strict=True)], dtype=object)

    return joined.withColumn(text_col, cut(F.col(text_col), F.col(s))).select(*docs.columns)
