"""Distinct word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from plumbline.llm.common import LOWER

_LOW = np.frombuffer(LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: An odd base and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word; a word is a run of bytes other than space and 9 to 13, A-Z lower-cased."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOW[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
    return h, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each text its distinct n-word shingles ascending; a text of fewer words is one shingle."""
    texts = len(offsets) - 1
    h, of = words(data, offsets)
    count = np.bincount(of, minlength=texts)
    first = np.cumsum(count) - count

    def joined(at: np.ndarray, length: int) -> np.ndarray:
        s = mix(h[at] + np.uint64(length))
        for i in range(1, length):
            s = mix(s * np.uint64(_BASE) + h[at + i])
        return s

    full = np.maximum(count - n + 1, 0)
    at = np.repeat(first, full) + (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
    size = np.where(count >= n, full, (count > 0).astype(np.int64))
    bounds = np.r_[0, np.cumsum(size)]
    out = np.empty(bounds[-1], np.uint64)
    out[np.repeat(count >= n, size)] = joined(at, n)
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        out[bounds[few]] = joined(first[few], k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][size > 0]] = True
    kept = np.r_[0, np.cumsum(keep)]
    return out[keep], kept[bounds]
