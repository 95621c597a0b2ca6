"""Memory of workers that other tasks will use."""

from __future__ import annotations

import ctypes


def tidy() -> None:
    """Gives freed memory back at the end of a task: its worker may stand idle beside other work for long."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call
