"""Token ids in binary files: canonical Huffman codes from global counts, in blocks that decode on their own.

1. Documents are put in order of id by a range shuffle. Each task encodes its run of documents with the tokenizer and appends the end
   id to each. What it makes goes to the shared folder in chunks of about ``tokens_per_file`` ids.
2. The counts of all ids, which stand beside each chunk, are summed (one row per id, whatever the input) and give one code for all files.
3. Each chunk becomes one file. Its name is its place in the order, and a task that runs again writes the same bytes.
4. Reading: each file is decoded by its own header alone. ``start`` adds the ids of all files before it, from one row per file.

File: magic "TLH1"; header size (u32); a JSON header with dtype, docs, tokens, block and the sizes of the sections; then sections: code lengths
(zlib), document ids (zlib of i64; a null id by the bitmap before them), document sizes (zlib of u32), block offsets (zlib of i64
differences), bits, and CRC-32 of the bits.

Defined results: null and empty texts have the end id alone. Null ids come first, rows that repeat an id stand side by side (their mutual
order follows the text), and no row is lost. An empty table gives no files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import files
from textloom.llm.chunks import Coded, Pieces, parts
from textloom.llm.common import map_batches
from textloom.llm.huffman import Code, code_lengths
from textloom.session import ship
from textloom.storage import materialise, new_path

MAGIC = b"TLH1"
BLOCK = 1024
TOKENS_PER_FILE = 4_000_000
END = 0
#: How the vocabulary files of byte-level BPE spell a space and a newline.
OPENING = ("\u0120", "\u010a")
_encoders: dict[str, Pieces] = {}


def encoder(spec: str) -> Pieces:
    """The tokenizers library, asked once for each piece that a worker meets, and for a thousand pieces at a time.

    A piece begins with its space or newline and holds no other, so in the ids of many pieces end to end those whose token begins with
    one of the two tell where each piece begins.
    """
    if spec not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        dtype = _dtype(tokenizer.get_vocab_size())
        opens = np.array([(tokenizer.id_to_token(i) or "")[:1] in OPENING for i in range(tokenizer.get_vocab_size())])

        def whole(texts: pa.Array) -> Coded:
            got = [np.array(e.ids, dtype) for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)] if len(texts) else []
            return np.concatenate([np.empty(0, dtype), *got]), np.fromiter(map(len, got), np.int64, len(got))

        def pieces(texts: pa.Array) -> Coded:
            n = len(texts)
            bounds = pa.array(np.append(np.arange(0, n, 1000), n).astype(np.int32))
            ids, _ = whole(pc.binary_join(pa.ListArray.from_arrays(bounds, texts), ""))
            at = np.nonzero(opens[ids])[0]
            return (ids, np.diff(at, append=len(ids))) if len(at) == n else whole(texts)

        _encoders.clear()
        _encoders[spec] = Pieces(whole, pieces, dtype)
    return _encoders[spec]


def _dtype(symbols: int) -> np.dtype:
    return np.dtype("<u2" if symbols <= 1 << 16 else "<u4")


CHUNK = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("width", pa.int64()), ("found", pa.binary()), ("n", pa.binary())])


def _chunks(spec, per_file: int):
    """Documents in order to rows of CHUNK; the end of the task closes its last chunk."""

    def run(batches):
        pieces = encoder(spec.value)
        part, nth, docs, sizes, held, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed():
            ids = np.concatenate(held)
            n = np.bincount(ids)
            found = np.nonzero(n)[0]
            row = {"part": part, "nth": nth, "doc_ids": pa.concat_arrays(docs).to_pylist(), "sizes": np.concatenate(sizes), "ids": ids.tobytes(), "width": pieces.dtype.itemsize, "found": found.astype("<i8").tobytes(), "n": n[found].astype("<i8").tobytes()}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, CHUNK)

        for batch in batches:
            at = 0
            for texts in parts(batch.column("text")):
                ids, size = pieces.of(texts)
                ends = np.cumsum(size)
                ids, size = np.insert(ids, ends, END), size + 1
                ends = np.cumsum(size)
                i = before = 0
                while i < len(size):
                    j = min(len(size), 1 + int(np.searchsorted(ends, before + per_file - total)))  # the document that fills the chunk is its last
                    docs.append(batch.column("doc_id").slice(at + i, j - i))
                    sizes.append(size[i:j])
                    held.append(ids[before : ends[j - 1]].copy())  # not a view, which would keep the whole part
                    total += int(ends[j - 1]) - before
                    i, before = j, int(ends[j - 1])
                    if total >= per_file:
                        yield closed()
                        nth, docs, sizes, held, total = nth + 1, [], [], [], 0
                at += len(texts)
        if docs:
            yield closed()

    return run


def _counted():
    """The counts of a batch of chunks, one row for each id."""

    def each(batch: pa.RecordBatch):
        found, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("found", "n"))
        ids, place = np.unique(found, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, place, n)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["token", "n"])

    return each


def pack_file(code: Code, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    bits, offsets = code.encode(ids, block)
    present = np.array([d is not None for d in doc_ids])
    sections = [
        zlib.compress(code.lengths.tobytes()),
        zlib.compress(np.packbits(present).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        zlib.compress(np.array(sizes, "<u4").tobytes()),
        zlib.compress(np.diff(offsets, prepend=0).astype("<i8").tobytes()),
        bits,
        zlib.crc32(bits).to_bytes(4, "little"),
    ]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "block": block, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *sections])


def _sections(data: bytes):
    """Document ids, sizes, bits, block offsets, header and code of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(data[4:8], "little")
    header = json.loads(data[8 : 8 + size])
    at, sections = 8 + size, []
    for n in header["sections"]:
        sections.append(data[at : at + n])
        at += n
    lengths, docs, sizes, offsets, bits, crc = sections
    if zlib.crc32(bits).to_bytes(4, "little") != crc:
        raise ValueError("the bits of a token file are damaged")
    n = header["docs"]
    docs = zlib.decompress(docs)
    present = np.unpackbits(np.frombuffer(docs[: -(-n // 8)], np.uint8), count=n).astype(bool)
    doc_ids = pa.array(np.frombuffer(docs[-(-n // 8) :], "<i8"), mask=~present)
    sizes = np.frombuffer(zlib.decompress(sizes), "<u4").astype(np.int64)
    return doc_ids, sizes, bits, np.cumsum(np.frombuffer(zlib.decompress(offsets), "<i8")), header, Code(np.frombuffer(zlib.decompress(lengths), np.uint8))


def unpack_file(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, sizes and all ids of a file."""
    doc_ids, sizes, bits, offsets, header, code = _sections(data)
    return doc_ids, sizes, code.decode(bits, header["tokens"], offsets, header["block"])


def document_ids(path: str, nth: int) -> np.ndarray:
    """The ids of one document of a file, by its place there: only the blocks that hold them are decoded."""
    _, sizes, bits, offsets, header, code = _sections(files.read(path))
    end = int(sizes[: nth + 1].sum())
    start, block = end - int(sizes[nth]), header["block"]
    first, last = start // block, -(-end // block)
    at = offsets[first:last] - offsets[first] // 32 * 32
    got = code.decode(bits[offsets[first] // 32 * 4 :], min(last * block, header["tokens"]) - first * block, at, block)
    return got[start - first * block : end - first * block]


def _written(lengths, folder: str, block: int):
    def make():
        code = Code(lengths.value)

        def each(batch: pa.RecordBatch):
            for row in batch.to_pylist():
                path = f"{folder}/part-{row['part']:06d}-{row['nth']:06d}.tlh"
                data = pack_file(code, row["doc_ids"], row["sizes"], np.frombuffer(row["ids"], f"<u{row['width']}").astype(np.int64), block)
                files.write(path, data)
                yield pa.RecordBatch.from_pydict({"part": [row["part"]], "nth": [row["nth"]], "path": [path], "tokens": [sum(row["sizes"])], "bytes": [len(data)]})

        return each

    return make


def write_tokens(docs: DataFrame, vocabulary: str, tokens_per_file: int = TOKENS_PER_FILE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their list: part, nth, path, tokens, bytes. ``vocabulary``: path of the tokenizer file on the driver."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(Path(vocabulary).read_text())
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    chunks = materialise(ordered.mapInArrow(_chunks(spec, tokens_per_file), "part bigint, nth bigint, doc_ids array<bigint>, sizes array<bigint>, ids binary, width bigint, found binary, n binary"), "token-chunks")
    counts = map_batches(chunks.select("found", "n"), _counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    n = np.zeros(max([r.token for r in counts], default=0) + 1, np.int64)
    n[[r.token for r in counts]] = [r.n for r in counts]
    lengths = spark.sparkContext.broadcast(code_lengths(n))
    folder = new_path(spark, "token-files")
    return materialise(map_batches(chunks.drop("found", "n"), _written(lengths, folder, block), "part bigint, nth bigint, path string, tokens bigint, bytes bigint"), "token-list")


def _unpacked(digests: bool):
    def make():
        def each(batch: pa.RecordBatch):
            for base, path in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist(), strict=True):
                doc_ids, sizes, ids = unpack_file(files.read(path))
                ends = np.cumsum(sizes)
                cols = {"doc_id": doc_ids, "start": pa.array(base + ends - sizes), "n_tokens": pa.array(sizes)}
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols["ids_crc32"] = pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64())
                else:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

        return each

    return make


def read_tokens(listed: DataFrame, digests: bool = False) -> DataFrame:
    """Reads the files of a list back: doc_id, start, n_tokens and the ids, or with ``digests`` their CRC-32 instead.

    The windows run over one row per part and over the files of one part.
    """
    totals = listed.groupBy(F.col("part").alias("p")).agg(F.sum("tokens").alias("t"))
    totals = totals.select("p", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = listed.withColumn("inner", inner).join(totals, F.col("part") == F.col("p")).select("path", (F.col("inner") + F.col("before")).alias("base"))
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(placed.repartition(parts), _unpacked(digests), "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digests else "ids array<int>"))
