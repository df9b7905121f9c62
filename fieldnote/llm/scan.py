"""Words of Arrow string columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from fieldnote.llm.ranges import Bytes

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (n + 1 numbers); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (n + 1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~IS_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    apart = ~inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= apart[:-1] | fresh[1:-1]
    last[:-1] &= apart[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finalizer of splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rising(x: np.ndarray) -> np.ndarray:
    """A stable order of numbers.  64-bit ones are sorted by their leading bits with their places in the others, which is
    several times as fast; where leading bits agree and the numbers do not, they are put in order after that."""
    if x.dtype != np.uint64 or len(x) < 2:
        return np.argsort(x, kind="stable")
    low = np.uint64((1 << (len(x) - 1).bit_length()) - 1)
    packed = np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    ranked = x[order]
    torn = np.flatnonzero(ranked[1:] < ranked[:-1])
    if len(torn):
        lead = packed & ~low
        group = np.cumsum(np.concatenate(([False], lead[1:] != lead[:-1])))
        held = np.zeros(group[-1] + 1, bool)
        held[group[torn]] = True
        at = np.flatnonzero(held[group])
        order[at] = order[at][np.lexsort((ranked[at], group[at]))]
    return order


def lexical(columns: list[np.ndarray]) -> np.ndarray:
    """A stable order by the columns, the first before the others."""
    order = rising(columns[0])
    if len(columns) > 1 and len(order) > 1:
        ranked = columns[0][order]
        same = ranked[1:] == ranked[:-1]
        group = np.cumsum(np.concatenate(([False], ~same)))
        at = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
        tied = order[at]
        order[at] = tied[np.lexsort([*(c[tied] for c in columns[:0:-1]), group[at]])]
    return order


def _powers_of(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, CHUNK + 1), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums (n + 1) from which ``between`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers_of(_BASE, len(values)), out=out[1:])
    return out


def between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [lo, hi); they depend on the content alone.  For runs of few, well-spread
    values: long runs of two values can be built whose sums agree."""
    return mix64((sums[hi] - sums[lo]) * _powers_of(_INVERSE, len(sums))[lo] + (hi - lo).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of words."""
    return Bytes(data).hashes(starts, ends - starts, seed)
