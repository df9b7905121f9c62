"""XXH64 and equality of many ranges of a buffer at once, without a Python object per range."""

from __future__ import annotations

import numpy as np
import xxhash

# Length from which a range is hashed by the C library.
LONG = 256


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


# Fixed values of XXH64.
P1, P2, P3, P4, P5 = map(_u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _u(by)) | (x >> _u(64 - by))


def _round(acc, lane):
    return _turn(acc + lane * P2, 31) * P1


class Bytes:
    """A buffer whose 8- and 4-byte words can be read at any place."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        n = len(self.data)
        self.by8 = np.ndarray((n - 7,), "<u8", self.data.data, strides=(1,))
        self.by4 = np.ndarray((n - 3,), "<u4", self.data.data, strides=(1,))

    def hashes(self, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
        """XXH64 of the ranges."""
        with np.errstate(over="ignore"):
            return self._hashes(start, size, _u(seed))

    def _hashes(self, start, size, seed):
        h = np.full(len(start), seed + P5)
        at = start.copy()
        stripes = size >> 5
        stripes[size > LONG] = 0
        wide = np.flatnonzero(stripes)
        if len(wide):
            acc = [np.full(len(wide), s) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            left, where = stripes[wide], at[wide]
            live = np.arange(len(wide))
            while len(live):
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], self.by8[where[live] + 8 * i])
                where[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            m = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for a in acc:
                m = (m ^ _round(_u(0), a)) * P1 + P4
            h[wide], at[wide] = m, where
        h += size.astype(np.uint64)
        rest = np.where(size > LONG, 0, size & 31)
        live = np.flatnonzero(rest >= 8)
        while len(live):
            h[live] = _turn(h[live] ^ _round(_u(0), self.by8[at[live]]), 27) * P1 + P4
            at[live] += 8
            rest[live] -= 8
            live = live[rest[live] >= 8]
        live = np.flatnonzero(rest >= 4)
        h[live] = _turn(h[live] ^ (self.by4[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        rest[live] -= 4
        live = np.flatnonzero(rest)
        while len(live):
            h[live] = _turn(h[live] ^ (self.data[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            rest[live] -= 1
            live = live[rest[live] > 0]
        h = (h ^ (h >> _u(33))) * P2
        h = (h ^ (h >> _u(29))) * P3
        h = h ^ (h >> _u(32))
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh64_intdigest(self.data[start[i] : start[i] + size[i]].data, int(seed))
        return h

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ranges from ``a`` and from ``b`` hold the same bytes."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero(a != b)
        done = 0
        while len(live):
            left = size[live] - done
            mask = np.where(left >= 8, _u(-1), (_u(1) << (np.clip(left, 0, 7) * 8).astype(np.uint64)) - _u(1))
            same = ((self.by8[a[live] + done] ^ self.by8[b[live] + done]) & mask) == 0
            out[live[~same]] = False
            live = live[same & (left > 8)]
            done += 8
        return out
