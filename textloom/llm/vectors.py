"""Vectors as integer matrices: what the searches and the whitening share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Greatest size of a scaled component, which keeps products exact.
LARGEST = 1 << 28


def whole_vectors(v: pa.Array, scale: int, shift: int = 0, largest: float = LARGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each dimension of a list column of doubles: the places of the vectors that are whole and finite, and their components floor(scale * x) + shift."""
    offsets, flat = v.offsets.to_numpy().astype(np.int64), v.values.to_numpy(zero_copy_only=False).astype(float)  # a null component becomes NaN
    sizes = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.nonzero(sizes == dim)[0]
        m = flat[offsets[at][:, None] + np.arange(dim)]
        finite = np.isfinite(m).all(axis=1)
        at, m = at[finite], np.floor(scale * m[finite])
        if np.abs(m).max(initial=0) >= largest:
            raise ValueError("a vector is too large for exact integers")
        if len(at):
            yield at, m + shift


def fixed_bytes(m: np.ndarray, kind: str) -> pa.Array:
    """Each row of a matrix as one binary cell."""
    raw = np.ascontiguousarray(m.astype(kind))
    width = raw.dtype.itemsize * raw.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles as long as these hold every sum, else in 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * m.shape[1] < 2.0**53:
        return (q @ m.T).astype(np.int64)
    return q.astype(np.int64) @ m.astype(np.int64).T
