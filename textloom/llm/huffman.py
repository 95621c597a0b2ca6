"""Canonical, length-limited Huffman codes for token ids; encoding and table-driven decoding in numpy.

A stream is cut into blocks of a fixed number of symbols. The bit offset at which each block begins is kept, so blocks decode
independently of each other: all blocks of a file advance together, one symbol a step.
"""

from __future__ import annotations

import numpy as np

LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 for symbols that don't occur."""
    counts = np.asarray(counts, np.int64)
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(float)
    merged, levels = leaves, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        merged = both[order]
    # the first 2n - 2 items of the last level, and of each level below it those that the packages chosen above hold
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        chosen = int(leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    depth[:take] += 1
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.nonzero(lengths)[0]
    used = used[np.argsort(lengths[used], kind="stable")]
    code, last = 0, 0
    for s, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
        code <<= n - last
        codes[s] = code
        code, last = code + 1, n
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical(self.lengths)
        self.longest = int(self.lengths.max(initial=1))
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """For each window of ``longest`` bits: symbol * 32 + length."""
        if self._table is None:
            used = np.nonzero(self.lengths)[0]
            used = used[np.lexsort((used, self.lengths[used]))]
            span = 1 << (self.longest - self.lengths[used].astype(np.int64))
            table = np.repeat(used.astype(np.int64) * 32 + self.lengths[used], span)
            self._table = np.concatenate([table, np.zeros((1 << self.longest) - len(table), np.int64)])
        return self._table

    def encode(self, ids: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
        """The bits, most significant first, and the bit offset of each block of ``block`` symbols."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        size = self.lengths[ids].astype(np.int64)
        if not size.all():
            raise ValueError("a symbol has no code")
        ends = np.cumsum(size)
        at = ends - size
        word, place = at >> 5, at & 31
        value = self.codes[ids] << (64 - place - size).astype(np.uint64)
        # every word of 32 bits has a code that begins in it, since codes are shorter
        first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        got = np.bitwise_or.reduceat(value, first)
        out = np.zeros(int(word[-1]) + 3, np.uint64)
        out[: len(got)] = got >> np.uint64(32)
        out[1 : len(got) + 1] |= got & np.uint64(0xFFFFFFFF)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], at[::block]

    def decode(self, data: bytes, count: int, offsets: np.ndarray, block: int) -> np.ndarray:
        """All ``count`` symbols; ``offsets`` as encode gave them."""
        if not count:
            return np.empty(0, np.int64)
        words = np.frombuffer(data + b"\0" * (16 + -len(data) % 4), ">u4").astype(np.uint64)
        at = offsets.astype(np.int64).copy()
        sizes = np.full(len(at), block)
        sizes[-1] = count - block * (len(at) - 1)
        out = np.empty((min(block, count), len(at)), np.int64)
        shift = np.uint64(64 - self.longest)
        for k in range(out.shape[0]):
            live = len(at) if k < sizes[-1] else len(at) - 1
            a = at[:live]
            w = a >> 5
            window = ((words[w] << np.uint64(32)) | words[w + 1]) << (a & 31).astype(np.uint64) >> shift
            hit = self.table[window.astype(np.int64)]
            out[k, :live] = hit >> 5
            at[:live] += hit & 31
        return out.T.reshape(-1)[:count] if sizes[-1] == out.shape[0] else np.concatenate([out[:, :-1].T.reshape(-1), out[: sizes[-1], -1]])
