"""What several operators here share: words, folded texts and column names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space of the contracts, [\x20\x09-\x0D].
SPACES = ("\x20", "\x09", "\x0a", "\x0b", "\x0c", "\x0d")
#: A word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without_spaces(col: Column) -> Column:
    for c in SPACES:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def count_words(df: DataFrame, text_col: str = "text", name: str = "size") -> DataFrame:
    """``df`` with the number of words of each text, 0 for null."""
    return df.withColumn(name, F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint"))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without nulls: the 64-bit hashes of their distinct lower-cased (A-Z only) words; the words of all texts end to end, as places in these; how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets, values = split.offsets.to_numpy().astype(np.int64), split.flatten()
    some = pc.greater(pc.binary_length(values), 0)
    coded = values.filter(some).dictionary_encode()
    unique = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    total = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique)), coded.indices.to_numpy(), np.diff(total[offsets - offsets[0]])


def tidy() -> None:
    """Gives freed memory back, at the end of a task: its worker may idle beside other work for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function that ``make`` sets up once per task."""

    def run(batches):
        each = make()
        for b in batches:
            if b.num_rows:
                yield from each(b)
        del each
        tidy()

    return df.mapInArrow(run, schema)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as bytes in UTF-8."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

