"""Suffix-array deduplication of byte strings that repeat across documents.

A byte goes when a `length`-byte string covering it also starts in a document with a smaller doc_id; strings are judged on
the input and never cross documents. Documents are dealt once to slots of a few MB by a hash; every step reads that exchange:

1. Every window of `length` bytes has a minimizer (windows.py); equal windows have equal ones. Each slot sends the hashes of
   its minimizers, each once, to buckets; those of two documents at least are returned to the slots that hold them.
2. Runs of windows with such a minimizer, the only places where a repeat can be, go to a shard by the minimizer's hash, each
   run's text once for each slot. Equal windows so meet in one shard, whatever documents hold them.
3. A task takes the shards of its partition one after another, small ones together, and sorts their different runs, parted by a
   symbol below all bytes, by external induced sorting (induced.py). Windows in a row of suffixes that share `length` symbols are
   equal; the least doc_id of each such row decides for each place. Texts, places and what is known of each run are
   arrays and queues under one memory bound, beyond which they are files, so a shard may be far larger than memory.
4. The spans to remove return to the documents' slots, where they are joined and cut out.

What moves are compressed blobs, one for each pair of slot and bucket or shard. Defined cases: null and empty texts have no bytes;
rows with a null doc_id count as larger than every other and not as smaller than each other; rows that repeat a doc_id don't
remove from each other; documents are told apart by doc_id and a 64-bit hash of their text; an empty table gives no rows; extra
columns, whatever their names, are ignored by `removed` and kept by `without_repeats`, which drops the parts of characters that
a cut leaves and keeps null texts null. Texts are UTF-8, which has no byte 255."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, batch_of, blob, flat, lean, parts_for, runs_of, text_bytes
from plumbline.llm.induced import suffix_blocks
from plumbline.llm.spill import Disk
from plumbline.llm.windows import LENGTH, runs

CHUNK = 1 << 20
SLOT_BYTES = 8 << 20
#: Bytes of all texts for each partition of the sorting step, and the shards in it.
PART_BYTES, SHARDS = 16 << 20, 16
#: Small shards are sorted together up to this many bytes of different runs.
TOGETHER = 2 << 20
MEMORY = 192 << 20
NULL_ID = 2**63 - 1
LOW48 = np.uint64((1 << 48) - 1)


def packed(h: np.ndarray) -> bytes:
    """The lower 6 bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def cuts(sorted_values: np.ndarray) -> list[int]:
    """Where each value begins in an ascending array, and its end."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1], True]).tolist() if len(sorted_values) else [0]


def in_order(table: pa.Table) -> pa.Table:
    """A slot's documents by (id, key): a document is known by its place there. Rows alike in both are the same text."""
    return table.take(pa.array(np.lexsort((table.column("key").to_numpy(), table.column("id").to_numpy()))))


def slot_runs(table: pa.Table):
    """(document, first byte of the first window, windows, minimizer's hash) of all runs of a slot's texts, and their bytes."""
    data, offsets = flat(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]]
    for a, b in runs_of(offsets, CHUNK):
        of, first, n, h = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append([of + a, first + offsets[a], n, h])
    return data, offsets, *map(np.concatenate, zip(*found, strict=True))


BUCKETS = pa.schema([("bucket", pa.int32()), ("slot", pa.int64()), ("once", pa.binary()), ("more", pa.binary())])
FLAGS = pa.schema([("slot", pa.int64()), ("h", pa.binary())])


def minimizers(rows: DataFrame, parts: int) -> DataFrame:
    """(slot, hashes): for each slot blobs of the minimizer hashes, less their upper 16 bits, that two documents at least hold."""

    def emit(table):
        _, _, of, _, _, h = slot_runs(table)
        ids = table.column("id").to_numpy()
        order = np.lexsort((ids[of], h))
        h, doc = h[order], ids[of][order]
        first = np.r_[True, h[1:] != h[:-1]][: len(h)]
        other = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] != doc[:-1])][: len(h)]
        each = np.flatnonzero(first)
        more = np.logical_or.reduceat(other, each) if len(each) else other
        h = h[each]
        bucket = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        at = cuts(bucket)
        slot = table.column("slot")[0].as_py()
        out = [(int(bucket[a]), slot, packed(h[a:b][~more[a:b]]), packed(h[a:b][more[a:b]])) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.Table.from_batches([batch_of(BUCKETS, [[r[k] for r in out] for k in range(4)])])

    def meet(batches):
        hs, slots, sure = [], [], []
        for batch in batches:
            for s, *both in zip(batch.column("slot").to_pylist(), batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
                for k, x in enumerate(both):
                    if x:
                        hs.append(x)
                        slots.append(np.full(len(x) // 6, s))
                        sure.append(np.full(len(x) // 6, bool(k)))
        if not hs:
            return
        h, slot, sure = unpacked(hs), np.concatenate(slots), np.concatenate(sure)
        del hs, slots
        order = np.argsort(h, kind="stable")
        h, slot, sure = h[order], slot[order], sure[order]
        same = h[1:] == h[:-1]
        keep = sure | np.r_[same, False] | np.r_[False, same]
        h, slot = h[keep], slot[keep]
        order = np.argsort(slot, kind="stable")
        h, slot = h[order], slot[order]
        at = cuts(slot)
        yield batch_of(FLAGS, [slot[at[:-1]], [packed(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]])

    sent = rows.groupBy("slot").applyInArrow(emit, "bucket int, slot long, once binary, more binary")
    return sent.repartitionById(parts, F.col("bucket")).mapInArrow(lean(meet), "slot long, h binary")


RUNS = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("data", pa.binary())])


def run_texts(shards: int):
    def cut(left, right):
        """Runs of windows with returned minimizers, dealt by shard; left: a slot's documents, right: its hashes."""
        flags = np.unique(unpacked(right.column("h").to_pylist()))
        out = []
        if len(flags) and left.num_rows:
            left = in_order(left)
            data, offsets, of, first, n, h = slot_runs(left)
            ids = left.column("id").to_numpy()
            low = h & LOW48
            some = np.flatnonzero(flags[np.minimum(np.searchsorted(flags, low), len(flags) - 1)] == low)
            shard = ((h[some] & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            some, shard = some[order], shard[order]
            of, first, size = of[some], first[some], n[some] + LENGTH - 1
            raw, z, at, slot = data.tobytes(), zstandard.ZstdCompressor(level=1), cuts(shard), left.column("slot")[0].as_py()
            for a, b in zip(at[:-1], at[1:], strict=True):
                texts: dict[bytes, int] = {}
                which = np.array([texts.setdefault(raw[p : p + s], len(texts)) for p, s in zip(first[a:b].tolist(), size[a:b].tolist(), strict=True)], np.int32)
                # runs are in the order of documents, so differences are small and compress well
                parts = [np.array([len(texts), b - a], np.int64), np.array(list(map(len, texts)), np.int32), which - np.arange(b - a, dtype=np.int32), np.diff(ids[of[a:b]], prepend=0), np.diff(of[a:b], prepend=0).astype(np.int32), (first[a:b] - offsets[of[a:b]]).astype(np.int32)]
                out.append((int(shard[a]), slot, z.compress(b"".join([*map(blob, parts), *texts]))))
        return pa.Table.from_batches([batch_of(RUNS, [[r[k] for r in out] for k in range(3)])])

    return cut


class Runs:
    """The runs of some shards: different texts once, and every place where a slot's documents hold them."""

    def __init__(self, memory: int):
        self.disk, self.z = Disk(memory), zstandard.ZstdDecompressor()
        self.known: dict[bytes, int] = {}
        self.known_bytes = self.bytes = self.count = 0
        self.texts, self.held, self.slots = [], [], []

    def add(self, slot: int, data: bytes) -> None:
        data = self.z.decompress(data)
        k, n = np.frombuffer(data, np.int64, 2).tolist()
        at, columns = 16, []
        for size, kind in ((k, np.int32), (n, np.int32), (n, np.int64), (n, np.int32), (n, np.int32)):
            columns.append(np.frombuffer(data, kind, size, at))
            at += columns[-1].nbytes
        sizes, which, ids, docs, starts = columns
        which, ids, docs = which + np.arange(n, dtype=np.int32), np.cumsum(ids), np.cumsum(docs, dtype=np.int32)
        names, fresh, fresh_sizes, known = [], [], [], self.known
        for size in sizes.tolist():
            text = data[at : at + size]
            at += size
            name = known.get(text)
            if name is None:
                name = known[text] = self.count
                self.count += 1
                fresh.append(text)
                fresh_sizes.append(size)
            names.append(name)
        if fresh:
            joined = np.frombuffer(b"".join(fresh), np.uint8)
            self.bytes += len(joined)
            self.known_bytes += len(joined)
            self.disk.put(self.texts, joined, np.array(fresh_sizes, np.int32))
        if self.known_bytes > self.disk.memory // 8:
            # the names of texts are forgotten, not the texts: a text that comes again is sorted once more, among its equals
            known.clear()
            self.known_bytes = 0
        self.disk.put(self.held, np.array(names, np.int64)[which], ids, docs, starts.copy())
        self.slots.append(slot)

    def owners(self):
        """(place of each run in the sorted text, windows of each run, least doc_id of each place's window)."""
        disk, n = self.disk, self.bytes + self.count
        t, of, place, size, least = disk.array(n, np.uint8), disk.array(n, np.int32), disk.array(self.count, np.int64), disk.array(self.count, np.int32), disk.array(self.count, np.int64)
        at = k = 0
        for block in self.texts:
            data, sizes = disk.get(block)
            end = np.cumsum(sizes + 1)
            name = np.repeat(np.arange(len(sizes)), sizes)
            t[at + np.arange(len(data)) + name] = np.minimum(data, 254) + np.uint8(1)
            of[at : at + end[-1]] = np.repeat(np.arange(k, k + len(sizes), dtype=np.int32), sizes + 1)
            place[k : k + len(sizes)] = at + end - sizes - 1
            size[k : k + len(sizes)] = sizes
            at, k = at + int(end[-1]), k + len(sizes)
        disk.drop(self.texts)
        least[:] = NULL_ID
        for block in self.held:
            which, ids, *_ = disk.get(block)
            np.minimum.at(least, which, ids)
        owner = disk.array(n, np.int64)
        waiting, low = [], NULL_ID  # the row of equal windows that a block may end within

        def close():
            for block in waiting:
                owner[disk.get(block)[0]] = low
            disk.drop(waiting)

        for p, l in suffix_blocks(t, LENGTH, disk=disk):
            name = of[p]
            whole = p - place[name] + LENGTH <= size[name]
            value = np.where(whole, least[name], NULL_ID)
            first = np.flatnonzero(l < LENGTH)
            upto = first[0] if len(first) else len(p)
            if upto and waiting:
                disk.put(waiting, p[:upto])
                low = min(low, int(value[:upto].min()))
            if len(first):
                close()
                last = first[-1]
                if last > upto:
                    owner[p[upto:last]] = np.repeat(np.minimum.reduceat(value[:last], first[:-1]), np.diff(first))
                disk.put(waiting, p[last:].copy())
                low = int(value[last:].min())
        close()
        return place, size, owner

    def spans(self):
        """Spans to remove, a blob for each block of places."""
        if not self.count:
            return
        place, size, owner = self.owners()
        z = zstandard.ZstdCompressor(level=1)
        for slot, block in zip(self.slots, self.held, strict=True):
            which, ids, docs, starts = self.disk.get(block)
            for a in range(0, len(which), 50_000):
                w, d = which[a : a + 50_000], ids[a : a + 50_000]
                n = size[w] - (LENGTH - 1)
                row = np.repeat(np.arange(len(w)), n)
                k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                gone = owner[place[w][row] + k] < d[row]
                edge = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (row[1:] != row[:-1])])
                if not len(edge):
                    continue
                last = np.flatnonzero(gone & np.r_[~gone[1:] | (row[1:] != row[:-1]), True])
                r = row[edge]
                from_ = starts[a : a + 50_000][r] + k[edge]
                out = [np.array([len(r)], np.int64), np.diff(docs[a : a + 50_000][r], prepend=0).astype(np.int32), from_.astype(np.int32), (k[last] - k[edge] + LENGTH).astype(np.int32)]
                yield slot, z.compress(b"".join(map(blob, out)))


SPANS = pa.schema([("slot", pa.int64()), ("data", pa.binary())])


def spans_of(rows: DataFrame, total: int, memory: int = MEMORY) -> DataFrame:
    """(slot, data): blobs of byte spans to remove, not yet joined."""
    parts = parts_for(total, PART_BYTES, 8)
    flags = minimizers(rows, parts)
    cut = rows.groupBy("slot").cogroup(flags.groupBy("slot")).applyInArrow(run_texts(parts * SHARDS), "shard long, slot long, data binary")

    def sort(batches):
        held, last = Runs(memory), None

        def done():
            for slot, data in held.spans():
                yield batch_of(SPANS, [[slot], [data]])

        for batch in batches:
            for shard, slot, data in zip(batch.column("shard").to_pylist(), batch.column("slot").to_pylist(), batch.column("data"), strict=True):
                if shard != last and held.bytes >= TOGETHER:
                    yield from done()
                    held = Runs(memory)
                held.add(slot, data.as_py())
                last = shard
        yield from done()

    placed = cut.repartitionById(parts, F.floor(F.col("shard") / SHARDS).cast("int")).sortWithinPartitions("shard")
    return placed.mapInArrow(lean(sort), "slot long, data binary")


def joined(right: pa.Table) -> dict[int, list[tuple[int, int]]]:
    """Maximal spans for each document of a slot, by its place there."""
    if not right.num_rows:
        return {}
    z, columns = zstandard.ZstdDecompressor(), [[], [], []]
    for x in right.column("data"):
        data = z.decompress(x.as_py())
        n = int(np.frombuffer(data, np.int64, 1)[0])
        for c, part in zip(columns, np.frombuffer(data, np.int32, 3 * n, 8).reshape(3, n), strict=True):
            c.append(part)
        columns[0][-1] = np.cumsum(columns[0][-1])
    doc, a, b = (np.concatenate(c).astype(np.int64) for c in columns)
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], (a + b)[order]
    # spans join where they meet: the farthest end so far, counted from each document's own base
    base = doc << 32
    far = np.maximum.accumulate(base + b)
    edge = np.flatnonzero(np.r_[True, base[1:] + a[1:] > far[:-1]])
    ends = far[np.r_[edge[1:] - 1, len(a) - 1]] - base[edge]
    out: dict[int, list[tuple[int, int]]] = {}
    for d, x, y in zip(doc[edge].tolist(), a[edge].tolist(), ends.tolist(), strict=True):
        out.setdefault(d, []).append((x, y))
    return out


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _rows(docs: DataFrame, doc_id: str, text: str, *more) -> tuple[DataFrame, int]:
    """(id, text, key, slot, more...) of every row, and the texts' bytes."""
    total = text_bytes(docs.select(F.col(text).cast("string").alias("text")), "text")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)
    key = F.xxhash64("id", "text")
    slot = F.pmod(key, F.lit(parts_for(total, SLOT_BYTES, 8)))
    return rows.select("id", "text", key.alias("key"), slot.alias("slot"), *rows.columns[2:]), total


def removed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows, total = _rows(docs, doc_id, text)

    def finish(left, right):
        spans, left = joined(right), in_order(left)
        ids, n, gone, count, sums = left.column("id").to_numpy(), [], [], [], []
        for k, t in enumerate(as_bytes(left.column("text").combine_chunks()) if left.num_rows else []):
            s = spans.get(k, [])
            rest = kept(t, s) if s else t
            n.append(len(t))
            gone.append(len(t) - len(rest))
            count.append(len(s))
            sums.append(hashlib.sha256(rest).hexdigest())
        return pa.table([pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.groupBy("slot").cogroup(spans_of(rows, total).groupBy("slot")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, with repeated bytes cut out of the text; length_column, where there is one, follows."""
    others = [c for c in docs.columns if c != text]
    rows, total = _rows(docs, doc_id, text, F.struct(*others).alias("others"), F.col(text).isNull().alias("none"))
    if length_column not in docs.columns:
        length_column = None

    def finish(left, right):
        found, left = joined(right), in_order(left)
        texts, old = left.column("text").to_pylist(), left.column("none").to_pylist()
        rest = left.column("others").combine_chunks() if left.num_rows else pa.array([], left.schema.field("others").type)
        columns = dict(zip(others, rest.flatten(), strict=True))
        sizes = columns[length_column].to_pylist() if length_column else None
        for r, s in found.items():
            texts[r] = kept(texts[r].encode(), s).decode(errors="ignore")
            if sizes:
                sizes[r] = len(texts[r])
        if sizes is not None:
            columns[length_column] = pa.array(sizes, columns[length_column].type)
        columns[text] = pc.if_else(pa.array(old, pa.bool_()), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
        return pa.table([columns[c] for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    return rows.groupBy("slot").cogroup(spans_of(rows, total).groupBy("slot")).applyInArrow(finish, docs.schema)
