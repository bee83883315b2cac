"""What a Python worker keeps between tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa

_owner: list[str | None] = [None]
_kept: dict = {}


def kept(owner: str) -> dict:
    """State that the worker keeps for one operator, such as encoders and their dictionaries.

    Spark uses a worker again for later stages.  When another operator asks,
    what the last one kept goes, and free memory returns to the system, so a
    pipeline's workers hold one operator's state at a time.
    """
    if _owner[0] != owner:
        _owner[0] = owner
        if _kept:
            _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    return _kept
