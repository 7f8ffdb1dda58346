"""Minimizers of all windows of a byte text: the place in each window whose k-gram has the least hash."""

from __future__ import annotations

import numpy as np

from plumbline.llm.shingles import mix

LENGTH, K = 50, 16


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 16 bytes from each place on; places without 16 bytes have none."""
    n = len(data)
    if n < K:
        return np.zeros(0, np.uint64)
    raw = data.tobytes()
    words = np.empty(n - 7, "<u8")
    for o in range(8):
        part = np.frombuffer(raw, "<u8", (n - o) // 8, o)
        words[o::8] = part[: len(words[o::8])]
    return mix(words[: n - 15] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xC2B2AE3D27D4EB4F))


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(text, first window, windows, minimizer's hash) for each run of windows with one minimizer, none across texts.
    A window is the place where it starts in data. Windows of equal bytes have minimizers of equal hash."""
    n = len(data)
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 0)
    total = int(count.sum())
    none = np.zeros(0, np.int64)
    if not total:
        return none, none, none, np.zeros(0, np.uint64)
    h = kgram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    bits = max(1, int(n).bit_length())
    m = (h >> np.uint64(bits) << np.uint64(bits)) | place
    wide, have = length - K + 1, 1
    while 2 * have <= wide:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < wide:
        m = np.minimum(m[: len(m) - (wide - have)], m[wide - have :])
    of = np.repeat(np.arange(len(size)), count)
    start = np.repeat(offsets[:-1], count) + (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
    at = (m[start] & np.uint64((1 << bits) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    return of[edge], start[edge], np.diff(np.r_[edge, total]), h[at[edge]]
