"""Hashes of runs of words, for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts end to end, cut at ASCII white space, and how many each text has; none for null."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    offsets, values = split.offsets.to_numpy().astype(np.int64), split.flatten()
    some = pc.greater(pc.binary_length(values), 0)
    coded = values.filter(some).dictionary_encode()
    unique = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    total = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return unique[coded.indices.to_numpy()], np.diff(total[offsets - offsets[0]])


#: The bytes of code tokens; all others are blanks.
_TOKEN = np.full(256, 32, np.uint8)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_0123456789":
    _TOKEN[_c] = _c


def pieces(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a string column of about so many bytes, with where each begins; nulls become empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends, at = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64)), 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, column.slice(at, end - at)
        at = end


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without nulls: the sorted distinct hashes of the code tokens of each, end to end; how many each has; and how many tokens with repeats."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    blanked = _TOKEN[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None else np.empty(0, np.uint8)
    h, sizes = word_hashes(pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(blanked)))
    doc, h = np.repeat(np.arange(len(sizes)), sizes), h.view(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(sizes)), sizes


def run_hashes(h: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the text of each."""
    n = max(0, len(h) - k + 1)
    acc = np.full(n, k, np.uint64)
    for i in range(k):
        acc = (acc ^ h[i : i + n]) * _MIX
        acc ^= acc >> np.uint64(29)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    whole = doc[:n] == doc[k - 1 :][:n]
    return acc[whole], doc[:n][whole]


def anchors(texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of words of its anchor, its second word to the one before its last but no more than ``most``, and their hash; 0 words for texts without one."""
    h, sizes = word_hashes(texts)
    n = np.clip(sizes - 2, 0, most)
    first = np.cumsum(sizes) - sizes + 1
    out = np.zeros(len(sizes), np.uint64)
    for k in np.unique(n[n > 0]).tolist():
        at = np.nonzero(n == k)[0]
        words = h[first[at][:, None] + np.arange(k)]
        out[at] = run_hashes(words.reshape(-1), np.full(len(at), k), k)[0]
    return n, out
