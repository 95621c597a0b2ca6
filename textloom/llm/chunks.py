"""Cutting texts where a byte-level BPE tokenizer surely cuts them, so that results can be kept by piece.

A single space or newline between two characters that aren't white space always is a border of pre-tokens: " ?X+" takes the space with what
follows, a newline stands alone, and no pre-token goes on over either. So a text splits at them into pieces that are encoded on their own, and
the pieces of a corpus recur. A text with any other arrangement of spaces and newlines is encoded as a whole.

Texts are split a few megabytes at a time. Arrow splits them, finds the distinct pieces and looks them up among the known ones; numpy gathers their
ids. Only pieces that are new to a worker reach the tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Upper bounds of the pieces that a worker keeps, and of a kept piece's bytes.
KEPT, KEPT_BYTES = 1_000_000, 64
PART_BYTES = 6_000_000

#: The ids of some strings end to end, and how many each string has.
Coded = tuple[np.ndarray, np.ndarray]


def parts(column: pa.Array, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column of about ``size`` bytes; a longer text is a slice of its own. Nulls become empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield column.slice(at, end - at)
        at = end


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` that begin at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    kind = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(ends[-1], dtype=kind)
    return pool[at]


class Pieces:
    """Ids of texts by way of their pieces. ``whole`` encodes each of some texts, ``pieces`` each of some pieces, which come with their space or newline."""

    def __init__(self, whole: Callable[[pa.Array], Coded], pieces: Callable[[pa.Array], Coded], dtype: np.dtype, kept: int = KEPT):
        self.whole, self.pieces, self.dtype, self.kept = whole, pieces, np.dtype(dtype), kept
        self._forget()

    def _forget(self) -> None:
        # what is known: pieces, whether each stands alone, their ids end to end and how many each has
        self.known, self.good = pa.array([], pa.string()), np.empty(0, bool)
        self.ids, self.sizes = np.empty(0, self.dtype), np.empty(0, np.int64)

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces without the space before them: which stand alone, the ids of these and how many each has.

        White space at an end, but for one newline at the start, shows that a text must not be split there.
        """
        core = pc.if_else(pc.starts_with(pieces, "\n"), pc.utf8_slice_codeunits(pieces, 1), pieces)
        good = pc.and_(pc.greater(pc.binary_length(core), 0), pc.equal(core, pc.utf8_trim_whitespace(core)))
        some = pieces.filter(good)
        ids, found = self.pieces(pc.if_else(pc.starts_with(some, "\n"), some, pc.binary_join_element_wise("", some, " ")))
        good = good.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(pieces), np.int64)
        sizes[good] = found
        return good, ids, sizes

    def _looked_up(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each piece where its ids start there, how many there are, and whether it stands alone."""
        at = pc.fill_null(pc.index_in(unique, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = at < 0
        fresh = unique.filter(pa.array(new))
        good, ids, sizes = self._coded(fresh)
        at[new] = len(self.known) + np.arange(len(fresh))
        pool, all_good, all_sizes = np.concatenate([self.ids, ids]), np.concatenate([self.good, good]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(all_sizes) - all_sizes
        if len(self.known) + len(fresh) > self.kept:
            self._forget()
        short = pc.less(pc.binary_length(fresh), KEPT_BYTES).to_numpy(zero_copy_only=False)
        if not short.all():
            ids = gathered(ids, (np.cumsum(sizes) - sizes)[short], sizes[short])
        self.known, self.good = pa.concat_arrays([self.known, fresh.filter(pa.array(short))]), np.concatenate([self.good, good[short]])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes[short]])
        return pool, starts[at], all_sizes[at], all_good[at]

    def of(self, texts: pa.Array) -> Coded:
        """The ids of all texts, which have no nulls. The texts are held at once with what is made of them."""
        n = len(texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        first, values = offsets[:-1], split.flatten()
        later = np.ones(len(values), bool)
        later[first] = False
        coded = values.filter(pa.array(later)).dictionary_encode()
        codes = coded.indices.to_numpy()
        pool, starts, sizes, good = self._looked_up(coded.dictionary)

        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        heads = values.take(pa.array(first))
        # a first piece may begin with white space, but not end with it
        together = ~pc.and_(pc.greater(pc.binary_length(heads), 0), pc.equal(heads, pc.utf8_rtrim_whitespace(heads))).to_numpy(zero_copy_only=False)
        together |= np.diff(offsets) == 1
        if not good.all():
            together[owner[later][~good[codes]]] = True
        head_ids, head_sizes = self.whole(pc.if_else(pa.array(together), texts, heads))

        start, size = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        start[later], size[later] = starts[codes], sizes[codes]
        start[first], size[first] = len(pool) + np.cumsum(head_sizes) - head_sizes, head_sizes
        if together.any():
            size[later & together[owner]] = 0
        return gathered(np.concatenate([pool, head_ids]), start, size), np.add.reduceat(size, first) if n else size

    def one(self, text: str) -> np.ndarray:
        return self.of(pa.array([text], pa.string()))[0]


def in_turn(encode: Callable[[str], bytes], dtype: np.dtype) -> Callable[[pa.Array], Coded]:
    """An encoder of one string as one of many."""
    dtype = np.dtype(dtype)

    def coded(texts: pa.Array) -> Coded:
        got = list(map(encode, texts.to_numpy(zero_copy_only=False).tolist()))
        return np.frombuffer(b"".join(got), dtype), np.fromiter(map(len, got), np.int64, len(got)) // dtype.itemsize

    return coded
