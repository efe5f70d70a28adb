"""Position-independent polynomial hashes of byte spans, computed with numpy over whole texts.

The hash of ``data[s:e]`` is a difference of two prefix sums, moved back to position 0 by the
inverse power of an odd base, so equal spans have equal hashes wherever they stand. Hashes only
find candidates: users compare the bytes afterwards.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longest run of bytes hashed with one pair of power tables; longer texts are cut by the users.
CHUNK = 1 << 20
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    table = _tables.get(base)
    if table is None or len(table) < size:
        steps = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        table = _tables[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(prefix))[starts])


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = min(n, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    behind = np.cumsum(sizes + 1)
    out, first = [], 0
    while first + n <= len(words):
        before = int(behind[first - 1]) if first else 0
        last = min(max(int(np.searchsorted(behind, before + CHUNK)) + 1, first + n), len(words))
        joined = np.frombuffer(b" ".join(words[first:last]), dtype=np.uint8)
        lengths = sizes[first:last]
        ends = behind[first:last] - before - 1
        starts = ends - lengths
        out.append(span_hashes(prefix_sums(joined), starts[: last - first - n + 1], ends[n - 1 :]))
        first = last - n + 1
    return np.concatenate(out) if len(out) > 1 else out[0]
