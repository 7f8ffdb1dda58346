"""Bounded-space online best-fit packing: a fixed number of open bins in a bitset keyed by free space.

Each partition packs its own pieces in the order they come. `open_bins` bins are open at most; a piece goes to the open
bin with the least free space that still holds it, found as the lowest set bit at or above its length; when none fits
and all are open, the fullest closes first. Only documents longer than a sequence are cut, into whole-sequence pieces;
their last piece may be shorter. Bins that are still open at the end of a partition are closed as they are, which costs
less than `open_bins` part-filled sequences for each partition; partitions are joined, without an exchange, until there are no
more than one for each `partition_bytes` of text.

Defined cases: null and empty texts give the end id alone; repeated rows are packed one by one; an empty table gives no
rows; extra columns are ignored."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import encoder, ended, flat, lean, parts_for, runs_of, text_bytes

SEQUENCE = 4096
OPEN_BINS = 64
PARTITION_BYTES = 64 << 20
CHUNK = 2 << 20
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Packer:
    """free: an int whose bit s is set while an open bin has s free places; at[s] holds those bins."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most, self.free, self.n_open, self.made = size, open_bins, 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        bins = self.at[space]
        b = bins.pop()
        if not bins:
            del self.at[space]
            self.free &= ~(1 << space)
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of at most `size` places."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            b = self._take(space)
        else:
            if self.n_open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            b, space = self.made, self.size
            self.made += 1
        left = space - length
        if left:
            self.at.setdefault(left, []).append(b)
            self.free |= 1 << left
            self.n_open += 1
        return b, self.size - space


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, size: int = SEQUENCE, open_bins: int = OPEN_BINS, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A row for each piece; with_ids adds its ids as little-endian unsigned 32-bit bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.coalesce(parts_for(text_bytes(rows, "text"), partition_bytes))

    def run(batches):
        packer, first = Packer(size, open_bins), TaskContext.get().partitionId() << 33
        encode = encoder(tokenizer_path).batch
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in runs_of(offsets, CHUNK):
                ids, bounds = ended(*encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), end_id)
                rows_at, out, kept = [], [[] for _ in range(6)], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), lo):
                    for piece, at in enumerate(range(a, b, size)):
                        part = ids[at : min(at + size, b)]
                        n, offset = packer.place(len(part))
                        rows_at.append(i)
                        for column, v in zip(out, (piece, at - a, len(part), zlib.crc32(part), first + n, offset), strict=True):
                            column.append(v)
                        if with_ids:
                            kept.append(part.tobytes())
                arrays = [batch.column("doc_id").take(pa.array(rows_at, pa.int64())), *(pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(out))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(lean(run), PIECES.format(kind=kind) + ", ids binary" * with_ids)
