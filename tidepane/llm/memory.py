"""Memory that a Python worker has freed but still holds."""

from __future__ import annotations

import ctypes
import gc


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on from stage to stage."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
