"""Arrays, queues and sorted rows of one task under a memory bound; what exceeds it lies in unlinked files.

The files belong to the task alone, as a shuffle's spill files do: they stand in the folder that Spark gives its Python workers
for spilling (SPARK_LOCAL_DIRS), are unlinked as soon as they are open, and a lost executor's task writes its own again."""

from __future__ import annotations

import os
import tempfile
from collections import deque

import numpy as np

BLOCK = 1 << 17


class Disk:
    """held: bytes of queue blocks and arrays in memory; spilled: bytes that went to files."""

    def __init__(self, memory: int):
        self.memory, self.held, self.spilled = memory, 0, 0
        self._file, self._end, self._waiting = None, 0, deque()

    @staticmethod
    def _open():
        return tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0])

    def array(self, n: int, kind) -> np.ndarray:
        """An array of zeros: in memory where half of the bound still holds it, else mapped from a file."""
        size = n * np.dtype(kind).itemsize
        if self.held + size <= self.memory // 2 or not size:
            self.held += size
            return np.zeros(n, kind)
        return self._mapped(n, kind)

    def _mapped(self, n: int, kind) -> np.ndarray:
        with self._open() as f:
            f.truncate(n * np.dtype(kind).itemsize)
            self.spilled += n * np.dtype(kind).itemsize
            return np.memmap(f, kind, "r+", shape=(n,))

    def free(self, a: np.ndarray) -> None:
        """Counts an array of `array` as gone; its owner drops it."""
        if not isinstance(a, np.memmap):
            self.held -= a.nbytes

    def kept(self, a: np.ndarray) -> np.ndarray:
        """a in a file."""
        out = self._mapped(len(a), a.dtype)
        out[:] = a
        return out

    def put(self, queue: list, *columns: np.ndarray) -> None:
        """Appends a block of columns to a queue; the oldest blocks of all queues go to disk first."""
        block = list(columns)
        queue.append(block)
        self._waiting.append(block)
        self.held += sum(c.nbytes for c in columns)
        while self.held > self.memory and self._waiting:
            old = self._waiting.popleft()
            for k, c in enumerate(old):
                if isinstance(c, np.ndarray):
                    self._file = self._file or self._open()
                    self._file.seek(self._end)
                    self._file.write(c.tobytes())
                    old[k] = self._end, len(c), c.dtype
                    self._end += c.nbytes
                    self.held -= c.nbytes
                    self.spilled += c.nbytes

    def get(self, block: list) -> list[np.ndarray]:
        out = []
        for c in block:
            if isinstance(c, tuple):
                at, n, kind = c
                self._file.seek(at)
                c = np.frombuffer(self._file.read(n * kind.itemsize), kind)
            out.append(c)
        return out

    def drop(self, queue: list) -> None:
        for block in queue:
            for k, c in enumerate(block):
                if isinstance(c, np.ndarray):
                    self.held -= c.nbytes
                block[k] = None
        queue.clear()
        while self._waiting and self._waiting[0][0] is None:
            self._waiting.popleft()


class Sorter:
    """Rows of columns in the order of the first column, then the second: runs sorted in a quarter of the bound, merged by blocks."""

    def __init__(self, disk: Disk):
        self.disk, self.parts, self.size, self.runs = disk, [], 0, []

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += sum(c.nbytes for c in columns)
            if self.size > self.disk.memory // 4:
                self._cut(True)

    @staticmethod
    def _sorted(columns):
        a, b = columns[0], columns[1]
        order = np.argsort(b, kind="stable")
        if len(a) and (a[0] != a).any():
            order = order[np.argsort(a[order], kind="stable")]
        return [c[order] for c in columns]

    def _cut(self, spill: bool) -> None:
        run = self._sorted([np.concatenate(c) for c in zip(*self.parts, strict=True)])
        self.runs.append([self.disk.kept(c) for c in run] if spill else run)
        self.parts, self.size = [], 0

    def __bool__(self) -> bool:
        return bool(self.parts or self.runs)

    def blocks(self):
        if self.parts:
            self._cut(bool(self.runs))
        at = [0] * len(self.runs)
        while any(x < len(r[0]) for x, r in zip(at, self.runs, strict=True)):
            pieces = [[c[x : x + BLOCK] for c in r] for x, r in zip(at, self.runs, strict=True)]
            # rows above the least last key of a piece that has more behind it must wait
            ends = [(p[0][-1], p[1][-1]) for x, p, r in zip(at, pieces, self.runs, strict=True) if x + BLOCK < len(r[0])]
            if ends:
                a, b = min(ends)
                for k, p in enumerate(pieces):
                    low, high = np.searchsorted(p[0], a, "left"), np.searchsorted(p[0], a, "right")
                    end = low + int(np.searchsorted(p[1][low:high], b, "right"))
                    pieces[k] = [c[:end] for c in p]
            at = [x + len(p[0]) for x, p in zip(at, pieces, strict=True)]
            some = [p for p in pieces if len(p[0])]
            yield [np.asarray(c) for c in some[0]] if len(some) == 1 else self._sorted([np.concatenate(c) for c in zip(*some, strict=True)])
