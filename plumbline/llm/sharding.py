"""Sharding by histogram sort: equal bytes for each shard, one exchange of the documents.

Keys are (hash of the text, doc_id), so equal texts lie side by side. In each round every partition counts the exact
bytes below a fixed number of probes for each splitter that is still open; the sums narrow each splitter's interval
until a probe lies within the tolerance of its target. A splitter falls between two texts where that is near enough;
only where one text's copies outweigh the tolerance is it refined by doc_id, so a group of copies is parted only when a
boundary must fall inside it. Each shard is dealt as `pieces` ranges of equal bytes, so neither a shard nor a group of
copies is ordered by one task; a row's slot is the exact count of its shard's rows before its range plus its place there.
The rounds read stored keys alone; then whole documents cross the exchange once and are written as Parquet, a folder for
each shard, whose files are in the order of slots. Sizes and checksums come from the texts read back from there.

Defined cases: a null text has no bytes beside the fixed cost; a null doc_id comes first; rows equal in text and doc_id
stay in one range in any order; shards may be empty where rows are few; every column of a document comes along in the
struct `document`, so no name clashes."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, stored

COST = 16
#: Of a shard's bytes.
TOLERANCE = 0.01
PROBES = 15
LOW = -(2**63)
SPAN = 2**64


def _key(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The composite key as a sortable pair of unsigned 64-bit numbers."""
    pair = np.empty(len(h), dtype=[("h", "<u8"), ("d", "<u8")])
    pair["h"] = h.astype("<i8").view("<u8") ^ np.uint64(1 << 63)
    pair["d"] = d.astype("<i8").view("<u8") ^ np.uint64(1 << 63)
    return pair


def _place(h: np.ndarray, d: np.ndarray, bounds: list[int]) -> np.ndarray:
    """For each row the number of bounds (128-bit numbers, ascending) at or below its key."""
    bh = np.array([b >> 64 for b in bounds], "<u8")
    bd = np.array([b & (SPAN - 1) for b in bounds], "<u8")
    pair = _key(h, d)
    lo = np.searchsorted(bh, pair["h"], "left")
    hi = np.searchsorted(bh, pair["h"], "right")
    inside = np.flatnonzero(hi > lo)  # rows whose text hash is itself a bound's
    for first in np.unique(lo[inside]):
        rows = inside[lo[inside] == first]
        lo[rows] = first + np.searchsorted(bd[first : hi[rows[0]]], pair["d"][rows], "right")
    return lo


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy() for c in ("h", "d", "size"))


def counts_below(keys: DataFrame, bounds: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each bound: partial sums in each partition, one small row for each."""
    n = len(bounds) + 1

    def run(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            h, d, s = _columns(batch)
            at = _place(h, d, bounds)
            rows += np.bincount(at, minlength=n)
            np.add.at(size, at, s)
        yield pa.RecordBatch.from_pydict({"at": np.arange(n), "size": size, "rows": rows})

    got = keys.mapInArrow(run, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in got:
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def splitters(keys: DataFrame, parts: int, total: int, rows: int, near: float) -> list[int]:
    """parts - 1 ascending bounds with about k/parts of all bytes below the k-th.

    Every open splitter keeps an interval of 128-bit keys: at or below its target, above it. Probes fall on whole text
    hashes until the interval lies within one hash, then on doc_ids; it closes when it is near or holds one row."""
    targets = [total * k / parts for k in range(1, parts)]
    low = [(0, 0, 0) for _ in targets]  # key, bytes below it, rows below it
    high = [((1 << 128) - 1, total, rows) for _ in targets]
    done: list[int | None] = [None] * len(targets)
    while any(x is None for x in done):
        wanted: set[int] = set()
        for k, x in enumerate(done):
            if x is None:
                a, b = low[k][0], high[k][0]
                unit = 64 if (a >> 64) + 1 < (b >> 64) else 0
                steps = {((a >> unit) + ((b >> unit) - (a >> unit)) * i // (PROBES + 1)) << unit for i in range(1, PROBES + 1)}
                wanted |= {p for p in steps | {(b >> 64) << 64} if a < p < b}
        probes = sorted(wanted)
        sizes, counts = counts_below(keys, probes) if probes else ([], [])
        for k, x in enumerate(done):
            if x is not None:
                continue
            moved = False
            for i in range(bisect_left(probes, low[k][0] + 1), bisect_left(probes, high[k][0])):
                moved = True
                if sizes[i] > targets[k]:
                    high[k] = probes[i], sizes[i], counts[i]
                    break
                low[k] = probes[i], sizes[i], counts[i]
            best = min(low[k], high[k], key=lambda v: abs(v[1] - targets[k]))
            if abs(best[1] - targets[k]) <= near or high[k][2] - low[k][2] <= 1 or not moved:
                done[k] = best[0]
    return np.maximum.accumulate(np.array(done, object)).tolist()


def shard(docs: DataFrame, shards: int = 40, *, pieces: int = 4, tolerance: float = TOLERANCE, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and document (all columns) of every row, read from the shards written to path."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = [F.xxhash64(data).alias("h"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOW)).alias("d")]
    keys = stored(docs.select(*key, (F.octet_length(data) + COST).cast("long").alias("size")), "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = shards * pieces
    bounds = splitters(keys, parts, int(total), rows, max(1.0, tolerance * int(total) / shards)) if rows else []
    _, before = counts_below(keys, bounds) if bounds else ([], [])
    first = [0, *before]
    starts = [first[p] - first[p - p % pieces] for p in range(len(first))]

    @F.arrow_udf("long")
    def part_of(h: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array(_place(h.to_numpy(), d.to_numpy(), bounds), pa.int64())

    # only keys go to Python; documents stay in the JVM
    dealt = docs.select(F.struct("*").alias("document"), *key).withColumn("part", part_of("h", "d"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("h", "d")).cast("long") - 1
    start = F.element_at(F.array(*(F.lit(n).cast("long") for n in starts)), (F.col("part") + 1).cast("int"))
    table = dealt.select("document", (start + place).alias("slot"), F.floor(F.col("part") / pieces).cast("int").alias("shard"))
    path = path or scratch(spark, "shards")
    table.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    written = spark.read.schema(table.schema).parquet(path)
    data = F.coalesce(F.col("document")[text].cast("string"), F.lit(""))
    return written.select(F.col("document")[doc_id].alias("doc_id"), (F.octet_length(data) + COST).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), "shard", "slot", "document")
