"""Token ids of documents as one wavelet matrix for each shard file.

A shard holds the ids of its documents one after another. Plane k holds bit (top - k) of each id after the ids were
stably parted by the higher bits, zeros first. Planes are cut into blocks of BLOCK bytes, each a zstd frame of its own, and the file
holds the count of ones before each block, so access, rank, select, counts and occurrences read only the blocks that they touch.
File: MAGIC, header (n, bits, documents, block bytes, sizes of the next three frames as little-endian u64), then zstd frames: the
documents' starts, their ids, the index (a size and a count of ones for each block of each plane), then the blocks. Document ids stand
in the manifest rows beside the files and in the file.

Defined cases: null texts count as empty and give the end id alone; repeated doc_ids stay separate documents, in the
order of their text's hash; an id that `bits` don't hold is refused; an empty table gives no files and no rows; extra columns are
ignored."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import encoder, ended, flat, lean, parts_for, runs_of, scratch, stored, text_bytes, write_file

MAGIC = b"WMTX0002"
SHARD_BYTES = 24 << 20
CHUNK = 2 << 20
#: Bytes of a plane's block: 2**19 ids.
BLOCK = 1 << 16
#: Ids that are parted at a time, a multiple of 8.
STRIP = 1 << 16


def planes_of(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Packed bit-planes, highest bit first. Ids are parted a STRIP at a time, which stays in the processor's cache."""
    planes, ids = [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in range(bits - 1, -1, -1):
        packed, zeros, ones = [np.zeros(0, np.uint8)], [ids[:0]], []
        for a in range(0, len(ids), STRIP):
            some = ids[a : a + STRIP]
            bit = (some & ids.dtype.type(1 << k)) != 0
            packed.append(np.packbits(bit, bitorder="little"))
            zeros.append(some[np.flatnonzero(~bit)])
            ones.append(some[np.flatnonzero(bit)])
        planes.append(np.concatenate(packed))
        ids = np.concatenate(zeros + ones)
    return planes


class WaveletMatrix:
    """Rank/select structure over planes in blocks; all positions are 0-based. block(k, j): bytes of plane k's j-th block, inflated;
    before: ones before each block of each plane, and in all."""

    def __init__(self, n: int, before: np.ndarray, block: Callable[[int, int], bytes], size: int = BLOCK):
        self.n, self.bits, self.before, self.block, self.size = n, len(before), before, block, size
        self.zeros = [n - int(b[-1]) for b in before]
        self.open: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def words(self, k: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit words of a block, one zero word added, and the ones before each of them in the plane."""
        if (k, j) not in self.open:
            data = self.block(k, j)
            w = np.zeros(-(-len(data) // 8) + 1, "<u8")
            w.view(np.uint8)[: len(data)] = np.frombuffer(data, np.uint8)
            self.open[k, j] = w, np.append(0, np.cumsum(np.bitwise_count(w), dtype=np.int64)) + self.before[k][j]
        return self.open[k, j]

    def _each(self, k: int, i: np.ndarray, take) -> np.ndarray:
        """take(words, counts, place in the block) over the blocks that hold the positions."""
        out, j = np.zeros(len(i), np.int64), np.minimum(i // (8 * self.size), len(self.before[k]) - 2)
        for b in np.flatnonzero(np.bincount(j)) if len(i) else []:
            some = np.flatnonzero(j == b)
            out[some] = take(*self.words(k, int(b)), i[some] - int(b) * 8 * self.size)
        return out

    def ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before each position."""
        mask = lambda at: (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._each(k, i, lambda w, before, at: before[at >> 6] + np.bitwise_count(w[at >> 6] & mask(at)))

    def access(self, i) -> np.ndarray:
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.uint32)
        for k in range(self.bits):
            bit = self._each(k, i, lambda w, _, at: (w[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) != 0
            one = self.ones(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            out = (out << np.uint32(1)) | bit
        return out

    def _range(self, token: int, i: np.ndarray) -> np.ndarray:
        """Where the token's occurrences before each position end in the last parting; they begin where those before 0 end."""
        at = np.clip(i, 0, self.n)
        for k in range(self.bits):
            one = self.ones(k, at)
            at = self.zeros[k] + one if token >> (self.bits - 1 - k) & 1 else at - one
        return at

    def ranks(self, token: int, i) -> np.ndarray:
        """Occurrences of the token before each position."""
        i = np.asarray(i, np.int64)
        if token >> self.bits:
            return np.zeros(len(i), np.int64)
        end = self._range(token, np.append(0, i))
        return end[1:] - end[0]

    def rank(self, token: int, i: int) -> int:
        return int(self.ranks(token, [i])[0])

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def selects(self, token: int, j) -> np.ndarray:
        """Positions of the j-th occurrences, from 0."""
        j = np.asarray(j, np.int64)
        n = self.count(token)
        if len(j) and not 0 <= j.min() <= j.max() < n:
            raise IndexError(f"the token occurs {n} times")
        at = j + (self._range(token, np.zeros(1, np.int64)) if len(j) else 0)
        for k in range(self.bits - 1, -1, -1):
            at = self._place(k, at - self.zeros[k], True) if token >> (self.bits - 1 - k) & 1 else self._place(k, at, False)
        return at

    def _place(self, k: int, target: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the target-th ones or zeros of plane k."""
        wide = 8 * self.size
        base = self.before[k] if one else np.minimum(np.arange(len(self.before[k])) * wide, self.n) - self.before[k]
        j, out = np.searchsorted(base, target, "right") - 1, np.empty(len(target), np.int64)
        for b in np.flatnonzero(np.bincount(j)) if len(j) else []:
            some = np.flatnonzero(j == b)
            w, ones = self.words(k, int(b))
            before = ones if one else int(b) * wide + np.arange(len(ones)) * 64 - ones
            at = np.searchsorted(before, target[some], "right") - 1
            bits = np.unpackbits((w[at] if one else ~w[at]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inner = (np.cumsum(bits, 1, dtype=np.int16) > (target[some] - before[at])[:, None]).argmax(1)
            out[some] = int(b) * wide + 64 * at + inner
        return out

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence, from 0."""
        return int(self.selects(token, [j])[0])

    def occurrences(self, token: int) -> np.ndarray:
        return self.selects(token, np.arange(self.count(token)))

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes' partings undone from the lowest bit up."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            plane = b"".join(self.block(k, j) for j in range(len(self.before[k]) - 1))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            up, zero, one = np.empty_like(ids), 0, self.zeros[k]
            for a in range(0, self.n, STRIP):
                here, out = bit[a : a + STRIP], up[a : a + STRIP]
                z, o = np.flatnonzero(~here), np.flatnonzero(here)
                out[z] = ids[zero : zero + len(z)]
                out[o] = ids[one : one + len(o)] | ids.dtype.type(1 << (self.bits - 1 - k))
                zero, one = zero + len(z), one + len(o)
            ids = up
        return ids


def write_shard(ids: np.ndarray, starts: np.ndarray, doc_ids: np.ndarray, bits: int, block: int = BLOCK) -> list[bytes]:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} has more than {bits} bits")
    z = zstandard.ZstdCompressor(level=1)
    frames, ones = [], []
    for plane in planes_of(ids, bits):
        for a in range(0, len(plane), block):
            frames.append(z.compress(plane[a : a + block]))
            ones.append(int(np.bitwise_count(plane[a : a + block]).sum()))
    index = np.array([list(map(len, frames)), ones], "<u8")
    heads = [z.compress(a.tobytes()) for a in (starts.astype("<i8"), doc_ids.astype("<i8"), index)]
    return [MAGIC, np.array([len(ids), bits, len(starts), block, *map(len, heads)], "<u8").tobytes(), *heads, *frames]


def open_shard(read: Callable[[int, int], bytes]) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """(matrix, documents' starts, their ids); read(offset, size) gives bytes of the file, called for what is needed alone."""
    head = read(0, 64)
    if head[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    n, bits, _, block, *sizes = (int(x) for x in np.frombuffer(head, "<u8", 7, 8))
    at, z, arrays = 64, zstandard.ZstdDecompressor(), []
    for size in sizes:
        arrays.append(np.frombuffer(z.decompress(read(at, size)), "<i8"))
        at += size
    starts, doc_ids, index = arrays
    index = index.reshape(2, bits, -1)
    ends = at + np.cumsum(index[0].ravel()).reshape(bits, -1)
    before = np.concatenate([np.zeros((bits, 1), np.int64), np.cumsum(index[1], 1)], 1)
    inflate = lambda k, j: z.decompress(read(int(ends[k, j] - index[0, k, j]), int(index[0, k, j])))
    return WaveletMatrix(n, before, inflate, block), starts, doc_ids


def read_shard(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    return open_shard(lambda at, size: data[at : at + size])


def write_corpus(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 2, bits: int = 16, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards in ascending doc_id order; returns the manifest (shard, path, n_docs, n_tokens), already stored."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = parts_for(text_bytes(rows, "text"), shard_bytes)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    def run(batches):
        encode, shard = encoder(tokenizer_path).batch, TaskContext.get().partitionId()
        ids, lengths, names = [], [], []
        for batch in batches:
            names.append(pc.fill_null(batch.column("doc_id"), -(2**63)).to_numpy())
            data, offsets = flat(batch.column("text"))
            for a, b in runs_of(offsets, CHUNK):
                got, bounds = ended(*encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), end_id)
                if int(got.max()) >> bits:
                    raise ValueError(f"id {int(got.max())} has more than {bits} bits")
                ids.append(got.astype(np.uint16 if bits <= 16 else np.uint32))
                lengths += np.diff(bounds).tolist()
        if lengths:
            path = f"{folder}/shard-{shard:06d}.wmx"
            write_file(path, write_shard(np.concatenate(ids), np.cumsum(lengths) - lengths, np.concatenate(names), bits))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(lengths)], "n_tokens": [sum(lengths)]})

    return stored(ordered.mapInArrow(lean(run), "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_corpus(spark: SparkSession, folder: str, manifest: DataFrame, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone; the manifest gives the shards' order and sizes. Each document's share of
    the end id is counted by rank and must be what its ids hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wmx").load(folder)
    files = files.select(F.regexp_extract("path", r"shard-(\d+)\.wmx$", 1).cast("long").alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                matrix, starts, names = read_shard(data.as_py())
                ids = matrix.tokens()
                ends = np.r_[starts[1:], matrix.n]
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                last = matrix.ranks(end_id, ends) - matrix.ranks(end_id, starts)
                if (last != np.add.reduceat(ids == end_id, starts, dtype=np.int64)).any() or (ids[ends - 1] != end_id).any():
                    raise ValueError(f"shard {shard}: ranks and ids differ")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64(), mask=names == -(2**63)), pa.array(np.full(len(starts), shard), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])

    # one row, and so one Arrow batch, for each file: a file is never joined with others in memory
    rows = files.mapInArrow(lean(run), "doc_id long, shard long, at long, n_tokens long, ids_crc32 long")
    before = manifest.select("shard", (F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "wavelet")
    manifest = write_corpus(docs, tokenizer_path, folder, **options)
    end_id = options.get("end_id", 2)
    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_corpus(spark, folder, manifest, end_id)
