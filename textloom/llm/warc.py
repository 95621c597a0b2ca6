"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records up to about ``frame_bytes``; two skippable frames end it:
an index from record identifiers to (frame, offset in the frame, size), and the seek table of the Zstandard seekable format
(compressed and plain size of each frame, their number, its magic). One record is read by fetching the tail and one frame.

Equal payloads (same SHA-256) form a group. The record of the largest page_id is its response, the others are revisits that refer to
it and carry no payload, if the payload has at least ``least_bytes``; smaller payloads are all responses. The group-by moves digests
alone and folds copies before the shuffle; the pages move once, when each meets what is known of its page_id, url and payload, a key that
no group of equal payloads makes hot.

Identifiers come from what a record holds, so tasks that run again give the same ones and no two records share one: the response that revisits refer to (of equal ids
the one of the greatest url) is named by page and payload, any other also by its url and, where whole rows repeat, by a number. Rows that repeat as a whole are folded
to one with their count, and written from it in runs. ``record_index`` is one map over all bundles, by which ``fetch`` reads single records.

Defined results: a null html is an empty payload. A null page_id never is the response if another row can be; among null ids alone all are
responses. Rows that repeat the response's page_id and payload are responses too. A null url is written as an empty target, but is another than an empty one. Other columns
are not read. An empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import files
from textloom.llm.common import map_batches, tidy
from textloom.operators.joins import splittable_join
from textloom.session import ship
from textloom.storage import materialise, new_path

#: Fixed values of the Zstandard frame format, its seekable form, and WARC 1.1.
SKIPPABLE = 0x184D2A50
SEEK_FRAME = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
#: Payloads that a task holds at once, and copies of a row that are written in one run.
PART_BYTES, COPIES = 4_000_000, 1000
DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6f0e9c1c-5a0b-5c55-9d1f-2a4b6c8d0e1f")


def record_id(page_id: int | None, payload_digest: str, again: str = "") -> str:
    """The identifier of a page's record; ``again`` tells apart records of one page and payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {payload_digest} {again}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, again: str = "", date: str = DATE) -> tuple[str, bytes]:
    """The identifier and the bytes of a response record, or of a revisit if ``refers_to`` names the page that holds the payload."""
    said = digest(payload)
    identifier = record_id(page_id, said, again)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", identifier),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{said}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, said)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return identifier, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(fields, HTTP headers, payload) of each record in turn."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(fields["Content-Length"])
        block = data[head + 4 : head + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, http, payload
        at = head + 4 + size + 4


class Bundle:
    """Collects records and closes them to the bytes of a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.plain: list[int] = []
        self.index: dict[str, tuple[int | None, int, int, int]] = {}
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, again: str = "") -> None:
        """The record that revisits know by page and payload alone, or with ``again`` another one."""
        identifier, record = make_record(page_id, url, payload, refers_to, again)
        self.index[identifier] = (page_id, len(self.frames), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)
        if self.size >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.held:
            self.frames.append(self.packer.compress(b"".join(self.held)))
            self.plain.append(self.size)
            self.held, self.size = [], 0

    def close(self) -> bytes:
        self._close_frame()
        index = self.packer.compress(json.dumps([[k, *v] for k, v in self.index.items()]).encode())
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.plain, strict=True)) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(index)), index, struct.pack("<II", SEEK_FRAME, len(table)), table])


class Reader:
    """Random access to a bundle; ``fetch(start, size)`` gives bytes of the file."""

    def __init__(self, fetch, size: int):
        self.fetch = fetch
        n, _, magic = struct.unpack("<IBI", fetch(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("not a seekable bundle")
        table = fetch(size - 9 - 8 * n, 8 * n)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.tail = size - 9 - 8 * n - 8

    def frame(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.fetch(self.starts[i], self.sizes[i][0]), max_output_size=self.sizes[i][1])

    def index(self) -> dict[str, tuple[int | None, int, int, int]]:
        """From each identifier to its page, frame, offset in the frame and size."""
        start = self.starts[-1]
        return {x[0]: tuple(x[1:]) for x in json.loads(zstandard.ZstdDecompressor().decompress(self.fetch(start + 8, self.tail - start - 8)))}

    def records(self, pages: set[int | None]):
        """The records of some pages; only frames that hold one are read."""
        by_frame: dict[int, list[tuple[int, int]]] = {}
        for page, frame, offset, size in self.index().values():
            if page in pages:
                by_frame.setdefault(frame, []).append((offset, size))
        for frame, places in by_frame.items():
            data = self.frame(frame)
            for offset, size in places:
                yield next(parse_records(data[offset : offset + size]))

    def record(self, identifier: str):
        """One record by its identifier, from one frame; None if the bundle lacks it."""
        place = self.index().get(identifier)
        if place is None:
            return None
        _, frame, offset, size = place
        return next(parse_records(self.frame(frame)[offset : offset + size]))


def _parts(column: pa.Array, size: int):
    """Where slices of about ``size`` bytes of a binary column begin and end; a longer value is a slice of its own."""
    ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, end
        at = end


def _bundled(folder: str, frame_bytes: int, bundle_bytes: int):
    """Rows (page_id, url, payload, refers_to, canonical, first, last): copies ``first`` to ``last`` of a record, of which the first of a canonical one has the name that revisits know."""

    def run(batches):
        task, nth, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes)

        def closed():
            # a name of its own for each attempt: the list names the files of the attempt that counted
            path = f"{folder}/part-{task:06d}-{nth:04d}-{uuid.uuid4().hex[:8]}.warc.zst"
            data = bundle.close()
            files.write(path, data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(bundle.index)], "bytes": [len(data)]})

        for batch in batches:
            for start, end in _parts(batch.column("payload"), PART_BYTES):
                part = batch.slice(start, end - start)
                for page_id, url, payload, refers_to, canonical, first, last in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "canonical", "first", "last")), strict=True):
                    for n in range(first, last + 1):
                        bundle.add(page_id, url, payload, refers_to, "" if canonical and not n else f"{'-' if url is None else '+' + url} {n}")
                        if bundle.total >= bundle_bytes:
                            yield closed()
                            nth, bundle = nth + 1, Bundle(frame_bytes)
        if bundle.index:
            yield closed()
        tidy()

    return run


def write_warc(pages: DataFrame, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes one record per row of (page_id, url, html) and returns the list of bundles: path, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    whole = F.md5(F.concat_ws("|", F.hex("key"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.when(F.col("url").isNull(), "-").otherwise(F.concat(F.lit("+"), "url"))).cast("binary"))
    rows = rows.withColumn("row_key", F.unhex(whole))
    counts = rows.groupBy("row_key").agg(F.first("key").alias("key"), F.first("page_id").alias("id"), F.first("url").alias("u"), F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "warc-rows")
    top = counts.groupBy("key").agg(F.max(F.struct(F.col("id").alias("top"), F.col("u").alias("top_url"))).alias("t")).select("key", "t.*")
    told = splittable_join(counts, top, "key").select("row_key", "n", "top", (F.col("id").isNotNull() & F.col("id").eqNullSafe(F.col("top")) & F.col("u").eqNullSafe(F.col("top_url"))).alias("canonical"))
    told = materialise(told, "warc-groups")
    joined = splittable_join(rows, told, "row_key")
    once = joined.filter("n = 1").withColumns({"first": F.lit(0).cast("bigint"), "last": F.lit(0).cast("bigint")})
    if not told.filter("n > 1").isEmpty():
        # rows that repeat as a whole: one of them, and runs of its copies
        some = joined.filter("n > 1").groupBy("row_key").agg(*[F.first(c).alias(c) for c in joined.columns if c != "row_key"])
        some = some.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(COPIES).cast("bigint")))).withColumn("last", F.least(F.col("first") + COPIES, F.col("n")) - 1)
        once = once.unionByName(some.select(*once.columns))
    small = F.octet_length("payload") < least_bytes
    refers = F.when(~small & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    out = once.select("page_id", "url", "payload", refers.alias("refers_to"), "canonical", "first", "last")
    return materialise(out.mapInArrow(_bundled(new_path(spark, "warc"), frame_bytes, bundle_bytes), "path string, records bigint, bytes bigint"), "warc-list")


INDEX = "record_id string, page_id bigint, path string, frame int, offset int, size int"


def _indexed():
    def each(batch: pa.RecordBatch):
        for path in batch.column("path").to_pylist():
            rows = [(identifier, page, path, *place) for identifier, (page, *place) in opened(path).index().items()]
            if rows:
                columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["record_id", "page_id", "path", "frame", "offset", "size"])

    return each


def record_index(listed: DataFrame) -> DataFrame:
    """One map over all bundles, read from their ends: record_id, page_id, path, frame, offset, size."""
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(listed.select("path").repartition(parts), _indexed, INDEX)


def _fetched():
    readers: dict[str, Reader] = {}
    held: dict[tuple[str, int], bytes] = {}

    def each(batch: pa.RecordBatch):
        for path, frame, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "frame", "offset", "size")), strict=True):
            if (path, frame) not in held:
                held.clear()
                if path not in readers:
                    readers.clear()
                    readers[path] = opened(path)
                held[path, frame] = readers[path].frame(frame)
            yield _rows([next(parse_records(held[path, frame][offset : offset + size]))])

    return each


def fetch(places: DataFrame) -> DataFrame:
    """The records at some places of ``record_index``, as ``read_warc`` gives them. Only frames that hold one are read, each once."""
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.repartition(parts, "path", "frame").sortWithinPartitions("path", "frame", "offset")
    return map_batches(ordered.select("path", "frame", "offset", "size"), _fetched, RECORDS)


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"


def opened(path: str) -> Reader:
    return Reader(lambda start, size: files.read(path, start, size), files.size(path))


def _rows(records) -> pa.RecordBatch:
    out = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html")}
    for fields, http, payload in records:
        kind = fields["WARC-Type"]
        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != said:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
        headers = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        out["page_id"].append(int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None)
        out["url"].append(fields["WARC-Target-URI"])
        out["payload_bytes"].append(int(headers["Content-Length"]))
        out["payload_digest"].append(said)
        out["record_type"].append(kind)
        out["refers_to"].append(int(fields["X-Refers-To-Page-Id"]) if kind == "revisit" else None)
        out["html"].append(payload.decode() if kind == "response" else None)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})


def _read(pages: set[int | None] | None):
    def make():
        def each(batch: pa.RecordBatch):
            for path in batch.column("path").to_pylist():
                reader = opened(path)
                if pages is not None:
                    yield _rows(reader.records(pages))
                    continue
                for i in range(len(reader.sizes)):
                    yield _rows(parse_records(reader.frame(i)))

        return each

    return make


def read_warc(listed: DataFrame, pages: set[int | None] | None = None) -> DataFrame:
    """Records of the bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits).

    All of them, frame by frame, or with ``pages`` those of some pages, found by the index of each bundle.
    """
    parts = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(listed.select("path").repartition(parts), _read(pages), RECORDS)
