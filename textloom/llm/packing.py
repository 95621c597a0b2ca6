"""Packing documents into sequences of fixed length: shortest pack first, over the histogram of lengths.

1. Documents are encoded, get the end id, and are cut into full sequences and a rest. Each piece is stored with its ids and their CRC-32.
2. The histogram of lengths, at most ``size`` rows, gives the packing. Lengths go longest first; each goes to the packs with the most space left, and
   opens new packs where it doesn't fit. Packs of one pattern are one entry with a count, which a placement splits at most once, so the work depends on
   the number of lengths, not of documents.
3. Packs left with ``least_cut`` ids of space or more are filled: the emptiest are dissolved, as many as the others have room for, and their pieces are cut to
   fit. Most corpora hold enough short pieces and need next to no such cuts.
4. Pieces are numbered in order of length by a range shuffle (of numbers, not ids). A pattern's places for one length take a run of these numbers, so a
   piece finds its sequence and offset by a search in a table whose size depends on ``size`` alone.
5. Pieces that step 3 cut meet their ids again for the checksums of their parts. ``sequences`` joins all of them and gives the rows to train on.

A sequence is padded to ``size``, unless it ends at a power of two.

Defined results: null and empty texts have the end id alone. A null id is an id like any other, rows that repeat an id are packed each on their own (a
document's ids are found by ``row``, a number of its row). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.chunks import parts
from textloom.llm.common import map_batches, tidy
from textloom.llm.token_files import encoder
from textloom.operators.units import numbered
from textloom.session import ship
from textloom.storage import discard, materialise

SIZE = 2048
END = 1
LEAST_CUT = 64
SLOTS = 1 << 20

PIECES = "row bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


def _crc(raw: memoryview, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())


def _pieces(spec, size: int, end: int):
    """Texts to pieces of at most ``size`` ids."""

    def run(batches):
        encode = encoder(spec.value)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for texts in parts(batch.column("text")):
                ids, n = encode.of(texts)
                ids, n = np.insert(ids, np.cumsum(n), end), n + 1
                count = -(-n // size)
                first = np.cumsum(n) - n
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(size, n[doc] - start)
                begin = first[doc] + start
                crc = _crc(memoryview(ids.astype("<u4").tobytes()), begin, begin + length)
                small = ids.astype("<u4", copy=False) if ids.dtype.itemsize > 2 else ids.astype("<u2", copy=False)
                width = small.dtype.itemsize
                # pieces lie end to end, as the documents do
                if small.nbytes > 1 << 30:
                    cells = pa.array([small[b : b + k].tobytes() for b, k in zip(begin.tolist(), length.tolist(), strict=True)], pa.binary())
                else:
                    cells = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(begin, len(small)).astype(np.int32) * np.int32(width)), pa.py_buffer(small.tobytes())])
                cols = [pa.array(row + doc), batch.column("doc_id").slice(at, len(texts)).take(pa.array(doc)), pa.array(start), pa.array(length), crc, pa.array(n[doc]), cells]
                out = pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
                for i in range(0, out.num_rows, 2000):
                    yield out.slice(i, 2000)
                row += len(texts)
                at += len(texts)
        tidy()

    return run


class Packs:
    """Packs by the space they have left; equal ones are an entry with a count. An entry's places are (length of the piece, start in it, length of the part)."""

    def __init__(self, size: int):
        self.size, self.by_space, self.heap = size, {}, []

    def add(self, space: int, count: int, places: tuple) -> None:
        if not self.by_space.setdefault(space, []):
            heapq.heappush(self.heap, -space)
        self.by_space[space].append((count, places))

    def most_space(self) -> int:
        while self.heap and not self.by_space[-self.heap[0]]:
            heapq.heappop(self.heap)
        return -self.heap[0] if self.heap else 0

    def take(self, space: int, most: int) -> tuple[int, tuple]:
        """Up to ``most`` packs of one entry."""
        count, places = self.by_space[space].pop()
        if count > most:
            self.by_space[space].append((count - most, places))
        return min(count, most), places

    def put(self, piece: int, start: int, length: int, count: int, least_cut: int | None = None) -> list[tuple[int, int, int]]:
        """Places ``count`` equal parts, shortest packs first. With ``least_cut``, a part that fits nowhere is cut as long as there is as much space; returns (start, length, count) of what the cuts left."""
        rest = []
        while count:
            space = self.most_space()
            if space >= length:
                n, places = self.take(space, count)
                self.add(space - length, n, (*places, (piece, start, length)))
            elif least_cut and space >= least_cut:
                n, places = self.take(space, count)
                self.add(0, n, (*places, (piece, start, space)))
                rest.append((start + space, length - space, n))
            else:
                # one after the other they fill a new pack before the next is opened
                each = min(count, self.size // length)
                n = count // each * each
                self.add(self.size - each * length, n // each, ((piece, start, length),) * each)
            count -= n
        return rest

    def entries(self) -> list[tuple[int, int, tuple]]:
        """(space, count, places) of all packs, the fullest first."""
        return [(space, n, places) for space in sorted(self.by_space) for n, places in sorted(self.by_space[space], key=lambda e: (e[1], e[0]))]


def patterns(histogram: dict[int, int], size: int = SIZE, least_cut: int = LEAST_CUT) -> list[tuple[int, tuple]]:
    """The packing of pieces of these lengths: (number of sequences, places in each)."""
    packs = Packs(size)
    for length in sorted(histogram, reverse=True):
        packs.put(length, 0, length, histogram[length])
    entries = packs.entries()
    room = sum(space * n for space, n, _ in entries if space >= least_cut)
    packs, again = Packs(size), {}
    for space, n, places in reversed(entries):
        # each dissolved pack takes its own space from the room and needs what it holds
        gone = min(n, room // size) if space >= least_cut else 0
        room -= gone * size
        if gone:
            for piece, start, length in places:
                again[length, piece, start] = again.get((length, piece, start), 0) + gone
        if n > gone:
            packs.add(space, n - gone, places)
    queue = [(-length, piece, start) for length, piece, start in again]
    heapq.heapify(queue)
    while queue:
        length, piece, start = heapq.heappop(queue)
        for at, left, n in packs.put(piece, start, -length, again.pop((-length, piece, start)), least_cut):
            if (left, piece, at) not in again:
                heapq.heappush(queue, (-left, piece, at))
            again[left, piece, at] = again.get((left, piece, at), 0) + n
    return [(n, places) for _, n, places in packs.entries()]


def slots(histogram: dict[int, int], packed: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """The packing as a table: from the number of a piece in order of length to where its parts go.

    Pieces ``first`` to ``first + count`` have the same parts, of which ``at`` to ``at + n`` are theirs: part_start and part_length in the piece, and the first one's sequence and offset;
    the sequences of the others follow.
    """
    base, held = {}, {}
    total = 0
    for length in sorted(histogram):
        base[length], total = total, total + histogram[length]
    # the parts of one length, cut alike, in the order of their starts: whole runs of pieces are matched with whole runs of sequences
    sequence = 0
    ends = []
    for n, places in packed:
        offset = 0
        for piece, start, length in places:
            held.setdefault(piece, {}).setdefault(start, []).append([length, n, sequence, offset])
            offset += length
        ends += [(sequence, offset)]
        sequence += n
    rows = []
    for piece, by_start in held.items():
        number = base[piece]
        while by_start.get(0):
            # one part after the other until the piece is whole; as many pieces as the shortest run allows
            chain, at = [], 0
            while at < piece:
                run = by_start[at][-1]
                chain.append((at, run))
                at += run[0]
            n = min(run[1] for _, run in chain)
            rows.append((number, n, [(at, run[0], run[2], run[3]) for at, run in chain]))
            for at, run in chain:
                run[1] -= n
                run[2] += n
                if not run[1]:
                    by_start[at].pop()
            number += n
    rows.sort()
    flat = [p for _, _, chain in rows for p in chain]
    sizes = np.array([len(chain) for _, _, chain in rows], np.int64)
    column = lambda values: np.array(list(values), np.int64)
    out = {"first": column(r[0] for r in rows), "n": sizes, "at": np.cumsum(sizes) - sizes}
    out |= {name: column(p[i] for p in flat) for i, name in enumerate(("part_start", "part_length", "sequence", "offset"))}
    return out | {"from": column(s for s, _ in ends), "tokens": column(t for _, t in ends)}


def _placed(sent, size: int):
    def make():
        table = sent.value

        def each(batch: pa.RecordBatch):
            number = batch.column("number").to_numpy()
            slot = np.searchsorted(table["first"], number, side="right") - 1
            n = table["n"][slot]
            row = np.repeat(np.arange(len(number)), n)
            part = np.repeat(table["at"][slot] - np.cumsum(n) + n, n) + np.arange(len(row))
            sequence = table["sequence"][part] + (number - table["first"][slot])[row]
            tokens = table["tokens"][np.searchsorted(table["from"], sequence, side="right") - 1]
            padded = np.where(tokens & (tokens - 1) == 0, tokens, size)
            start, length = batch.column("start").to_numpy()[row] + table["part_start"][part], table["part_length"][part]
            taken = batch.select(["row", "doc_id", "ids_crc32", "doc_tokens"]).take(pa.array(row))
            cut = pa.array(n[row] > 1)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(start), pa.array(length), pa.array(sequence), pa.array(table["offset"][part]), pa.array(padded), cut, batch.column("start").take(pa.array(row))], [*taken.schema.names, "start", "length", "sequence_id", "offset", "sequence_length", "cut", "piece"])

        return each

    return make


PLACES = "row bigint, doc_id bigint, ids_crc32 bigint, doc_tokens bigint, start bigint, length bigint, sequence_id bigint, offset bigint, sequence_length bigint, cut boolean, piece bigint"


def _with_crc(width: int):
    """Parts of cut pieces beside the ids of the whole piece: their own checksums."""

    def make():
        def each(batch: pa.RecordBatch):
            ids, at, length = batch.column("ids"), (batch.column("start").to_numpy() - batch.column("piece").to_numpy()).tolist(), batch.column("length").to_pylist()
            crc = [zlib.crc32(np.frombuffer(raw, f"<u{width}")[a : a + n].astype("<u4").tobytes()) for raw, a, n in zip(ids.to_pylist(), at, length, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("ids_crc32"), "ids_crc32", pa.array(crc, pa.int64())).drop_columns(["ids"])

        return each

    return make


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, least_cut: int = LEAST_CUT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Places and pieces.

    Places: one row per part: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id (from 0), offset, sequence_length (with padding), and row, piece (the start of the
    stored piece it is cut from). Pieces: row, doc_id, start, length, ids_crc32, doc_tokens and the ids, in 2 bytes each if the vocabulary allows, else 4. ``vocabulary``: path of the tokenizer file on the driver.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    text = Path(vocabulary).read_text()
    width = 2 if Tokenizer.from_str(text).get_vocab_size() <= 1 << 16 else 4
    spec = spark.sparkContext.broadcast(text)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(spec, size, end), PIECES), "pack-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    table = spark.sparkContext.broadcast(slots(histogram, patterns(histogram, size, least_cut)))
    order = numbered(pieces.drop("ids"), "length", "doc_id", "row", "start", name="number")
    places = materialise(map_batches(order, _placed(table, size), PLACES), "pack-places")
    cut = places.filter("cut")
    # only ids of cut pieces are shuffled, as far as a filter of bounded size can tell them
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int").alias("slot")
    slots_ = cut.select(slot).distinct()  # at most SLOTS rows
    held = pieces.select("row", F.col("start").alias("piece"), "ids", slot).join(F.broadcast(slots_), "slot", "left_semi").drop("slot")
    again = cut.join(held, ["row", "piece"])
    again = map_batches(again.select(*cut.columns, "ids"), _with_crc(width), PLACES)
    out = places.filter("not cut").unionByName(again)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "row", "piece"), pieces


def sequences(places: DataFrame, pieces: DataFrame, pad: int = END, width: int = 2) -> DataFrame:
    """The rows to train on: sequence_id, input_ids (padded), documents (number of the part within its sequence for each id, from 1, and 0 for padding)."""
    joined = places.select("row", "piece", "start", "length", "sequence_id", "offset", "sequence_length").join(pieces.select("row", F.col("start").alias("piece"), "ids"), ["row", "piece"])
    # a part's own ids, so that a sequence's group holds no more than its length
    part = joined.select("sequence_id", "offset", "sequence_length", F.substring("ids", ((F.col("start") - F.col("piece")) * width + 1).cast("int"), (F.col("length") * width).cast("int")).alias("ids"))
    grouped = part.groupBy("sequence_id").agg(F.max("sequence_length").alias("sequence_length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def make():
        def each(batch: pa.RecordBatch):
            size, found = batch.column("sequence_length").to_pylist(), batch.column("parts").to_pylist()
            ids, numbers = [], []
            for n, rows in zip(size, found, strict=True):
                held = [np.frombuffer(r["ids"], f"<u{width}").astype(np.int32) for r in rows]
                filled = np.concatenate(held)
                left = n - len(filled)
                ids.append(np.concatenate([filled, np.full(left, pad, np.int32)]))
                numbers.append(np.concatenate([np.repeat(np.arange(1, len(held) + 1, dtype=np.int32), [len(x) for x in held]), np.zeros(left, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32()))], ["sequence_id", "input_ids", "documents"])

        return each

    return map_batches(grouped, make, "sequence_id bigint, input_ids array<int>, documents array<int>")
