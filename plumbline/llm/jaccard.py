"""N-gram Jaccard join by count vectors in R-trees, exact.

Two texts link when 100 * |intersection| >= 75 * |union| of their distinct 5-word shingles. Steps, each over all rows:

1. One pass gives every text its set's size and fingerprint, and its count vector: shingles hashed into GROUPS groups,
   the number in each. Equal sets are one class from then on. The same pass counts shingles in a sketch of fixed size.
2. Linked sets share a shingle among the first n - ceil(0.75 n) + 1 of each, in any one order of shingles. The order is by
   the sketch's count, then by hash, so frequent shingles come last and seldom bring texts together.
3. Texts that share such a shingle form a list; a list of more than 2 * block texts is dealt as pairs of blocks. Count vectors of a
   list's texts are points in an R-tree, whose nodes hold coordinate maxima; a list that fits a leaf is a tree of that leaf. The sum of coordinate minima bounds the intersection of two points, and of two nodes; pairs
   below what linking needs are cut, at nodes or leaves. What survives leaves as a spanning forest, whose components are
   closed: no link crosses them.
4. Within a component pairs that the bound lets through are verified on the sets themselves, most alike sizes first; a pair
   already joined by other links is skipped, since it can't change the components. Components of more than `block` texts are
   dealt as pairs of blocks, so no group of copies has to fit into one task.

Lists and points hold rows by a node, the 64-bit hash of doc_id and text, so rows that repeat a doc_id each keep their own text's set;
verified links are mapped to doc_ids. Hashes of shingles have 64 bits, fingerprints of sets 128. Defined cases: null and empty texts, and texts of white space
only, have no shingles and link with nothing; texts of fewer than five words are one shingle, as the contract says; rows
with a null doc_id link with nothing; rows that repeat a doc_id are one node of the links; an empty table gives no rows;
extra columns are ignored by `links` and kept by `one_of_each`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import blob, flat, lean, parts_for, runs_of, stored, table_of, text_bytes
from plumbline.llm.components import EDGES, Forest, components
from plumbline.llm.shingles import mix, shingle_sets

GROUPS, LEAF, FAN = 512, 32, 16
SKETCH_BITS, SKETCH_PIECE = 24, 1 << 18
CHUNK = 1 << 20
#: Bytes of text for each partition that makes a sketch, and for each partial sum of sketches.
SKETCHED, SUMMED = 48 << 20, 2 << 30
BLOCK = 1024
#: Bytes of text for each partition, and so for each file that a step writes.
PART = 16 << 20
#: Hash slots of the filter that spares texts in no candidate component the second look; a full filter only spares none.
FILTER = 1 << 20


def need(a, b):
    """The least intersection with which sets of a and b shingles link."""
    return -(-3 * (a + b) // 7)


def comparable(a, b):
    return 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)


def vectors_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """uint8 count vectors; a count over its type's range stays at the top, which the bound treats as no limit."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * GROUPS + (h >> np.uint64(8)).astype(np.int64) % GROUPS
    return np.minimum(np.bincount(at, minlength=n * GROUPS), 255).astype(np.uint8).reshape(n, GROUPS)


def bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed coordinate minima over the last axis; unlimited where both stand at the top of their type."""
    m = np.minimum(p, q)
    s = m.sum(-1, dtype=np.int64)
    full = (m == 255).any(-1)
    return np.where(full, 1 << 62, s) if full.any() else s


class Tree:
    """An R-tree over count vectors, sorted by size and then packed; nodes hold coordinate maxima and the range of sizes."""

    def __init__(self, v: np.ndarray, n: np.ndarray):
        self.v, self.n = v, n
        tops, lows, highs = [], [], []
        edge = np.arange(0, len(n), LEAF)
        tops.append(np.maximum.reduceat(v, edge, axis=0))
        lows.append(np.minimum.reduceat(n, edge))
        highs.append(np.maximum.reduceat(n, edge))
        while len(tops[-1]) > 1:
            edge = np.arange(0, len(tops[-1]), FAN)
            tops.append(np.maximum.reduceat(tops[-1], edge, axis=0))
            lows.append(np.minimum.reduceat(lows[-1], edge))
            highs.append(np.maximum.reduceat(highs[-1], edge))
        self.tops, self.lows, self.highs = tops, lows, highs

    def leaf_pairs(self):
        """Pairs of leaves (a <= b) that may hold a link, by joining the tree with itself from its root down."""
        pairs = np.array([[0, 0]])
        for level in range(len(self.tops) - 1, -1, -1):
            if level < len(self.tops) - 1:
                width = len(self.tops[level])
                kids = (pairs[:, :, None] * FAN + np.arange(FAN)).clip(max=width - 1)
                a, b = np.broadcast_arrays(kids[:, 0, :, None], kids[:, 1, None, :])
                pairs = np.unique(np.stack([np.minimum(a, b).ravel(), np.maximum(a, b).ravel()], 1), axis=0)
            a, b = pairs.T
            lo, hi = self.lows[level], self.highs[level]
            ok = (4 * hi[a] >= 3 * lo[b]) & (4 * hi[b] >= 3 * lo[a])
            pairs = pairs[ok]
            out = []
            for s in range(0, len(pairs), 2048):
                a, b = pairs[s : s + 2048].T
                out.append(pairs[s : s + 2048][bound(self.tops[level][a], self.tops[level][b]) >= need(lo[a], lo[b])])
            pairs = np.concatenate(out) if out else pairs
        return pairs


def candidates(ids: np.ndarray, v: np.ndarray, n: np.ndarray, side: np.ndarray, forest: Forest) -> None:
    """Joins in the forest every two texts of a list that the bound lets through, unless they are joined already. Of two blocks
    (side 0 and 1; 2: one block alone) only pairs across them are compared."""
    order = np.argsort(n, kind="stable")
    ids, v, n, side = ids[order], v[order], n[order], side[order]
    tree = Tree(v, n)
    for a, b in tree.leaf_pairs().tolist():
        i, j = np.arange(a * LEAF, min((a + 1) * LEAF, len(n))), np.arange(b * LEAF, min((b + 1) * LEAF, len(n)))
        if len(n) > 4 * LEAF and len({forest.find(x) for x in ids[np.r_[i, j]].tolist()}) == 1:
            continue
        ok = comparable(n[i][:, None], n[j][None]) & (bound(v[i][:, None], v[j][None]) >= need(n[i][:, None], n[j][None]))
        p, q = np.nonzero(ok & ((side[i][:, None] == 2) | (side[i][:, None] != side[j][None])))
        keep = i[p] < j[q]
        for x, y in zip(ids[i[p[keep]]].tolist(), ids[j[q[keep]]].tolist(), strict=True):
            forest.union(x, y)


def edges_of(forest: Forest) -> pa.RecordBatch:
    e = np.array([(x, r) for x in list(forest.up) if (r := forest.find(x)) != x], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def in_chunks(batches):
    """(ids, hashes, bounds) of texts, a few MB of text at a time. Column 0 is the id, column 1 the text."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for a, b in runs_of(offsets, CHUNK):
            h, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch.column(0).slice(a, b - a), h, bounds


def described(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of every row, the sketch's pieces). The id is a struct of doc_id and node."""
    key = pa.struct([("id", pa.int64()), ("node", pa.int64())])

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for ids, h, bounds in in_chunks(batches):
            np.add.at(counts, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            size = np.diff(bounds)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (h, mix(h))]
            prints = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], 1)
            v = vectors_of(h, bounds)
            k = len(size)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.StructArray.from_arrays([ids.field("id"), ids.field("node")], fields=list(key)), pa.array(size, pa.int64()), pa.array([blob(x) for x in prints], pa.binary()), pa.array([z.compress(x) for x in v], pa.binary())], names=["piece", "id", "n", "print", "data"])
        for k in range((1 << SKETCH_BITS) // SKETCH_PIECE):
            part = counts[k * SKETCH_PIECE : (k + 1) * SKETCH_PIECE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([z.compress(part.tobytes())], pa.binary())], names=["piece", "id", "n", "print", "data"])

    both = stored(rows.mapInArrow(lean(run), "piece int, id struct<id:long,node:long>, n long, print binary, data binary"), "shingles")
    return both.where("piece is null").select("id.id", "id.node", "n", "print", F.col("data").alias("v")), both.where("piece is not null").select("piece", "data")


def summed(key, data):
    z, total = zstandard.ZstdDecompressor(), np.zeros(SKETCH_PIECE, np.uint32)
    for x in data.column("data"):
        total += np.frombuffer(z.decompress(x.as_py()), np.uint32)
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})


def levels(sketch: DataFrame, total: int) -> np.ndarray:
    """One byte for each slot of the sketch, growing with its count: spread over the counts' common range, then by doublings.
    Partial sums first, for about every SUMMED bytes of text, so no task gathers the pieces of all partitions."""
    grouped = sketch.withColumn("part", F.pmod(F.xxhash64("data"), F.lit(parts_for(total, SUMMED)))).groupBy("piece", "part").applyInArrow(summed, "piece int, data binary")
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in grouped.groupBy("piece").applyInArrow(summed, "piece int, data binary").toLocalIterator():
        counts[r["piece"] * SKETCH_PIECE : (r["piece"] + 1) * SKETCH_PIECE] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.uint32)
    usual = float(np.median(counts[::16]))
    spread, out = max(1.0, usual**0.5), np.empty(len(counts), np.uint8)
    for a in range(0, len(counts), SKETCH_PIECE):
        z = (counts[a : a + SKETCH_PIECE] - usual) / spread
        out[a : a + SKETCH_PIECE] = np.where(z <= 20, np.clip(z * 8 + 40, 0, 200), np.minimum(200 + 5 * np.log2(np.maximum(z, 20) / 20), 255))
    return out


def prefixes(h: np.ndarray, bounds: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in h, text) of each set's first n - ceil(0.75 n) + 1 shingles in the order by level and hash."""
    size = np.diff(bounds)
    first = np.where(size > 0, size - -(-3 * size // 4) + 1, 0)
    at = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    parts = [a + np.argsort(at[a:b], kind="stable")[:k] for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), strict=True) if k]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.repeat(np.arange(len(size)), first)


def packed(h: np.ndarray) -> bytes:
    """The upper 5 bytes of each hash. With the bucket, which the lower bits give, they tell shingles apart well enough to bring texts
    together; where they don't, a list holds texts that its tree and the sets part again."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 3:] = raw
    return out.view("<u8").ravel()


def shared_prefixes(rows: DataFrame, level, parts: int, block: int) -> DataFrame:
    """(list, id, nb): texts that share a shingle of their prefixes with another text, and in how many blocks of about `block` texts
    their list is to be dealt. Blobs of columns move, not rows."""

    def emit(batches):
        for ids, h, bounds in in_chunks(batches):
            # of equal sets in a chunk the first stands for all; their class is joined by fingerprint
            seen, keep = set(), np.zeros(len(ids), bool)
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if b > a and (key := h[a:b].tobytes()) not in seen:
                    seen.add(key)
                    keep[k] = True
            at, of = prefixes(h, bounds, level.value)
            mine = keep[of]
            at, of = at[mine], of[mine]
            hs, names = h[at], ids.to_numpy()[of]
            bucket = (hs % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            hs, names, bucket = hs[order], names[order], bucket[order]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
            cut = list(zip(edge[:-1], edge[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array([packed(hs[a:b]) for a, b in cut], pa.binary()), pa.array([blob(names[a:b]) for a, b in cut], pa.binary())], names=["bucket", "h", "ids"])

    def meet(batches):
        hs, ids = [], []
        for batch in batches:
            hs += batch.column("h").to_pylist()
            ids += [np.frombuffer(x.as_py(), "<i8") for x in batch.column("ids")]
        if not hs:
            return
        h, names = unpacked(hs), np.concatenate(ids)
        order = np.argsort(h, kind="stable")
        h, names = h[order], names[order]
        same = h[1:] == h[:-1]
        both = np.r_[same, False] | np.r_[False, same]
        h, names = h[both], names[both]
        # a list is named by its members: shingles that the same texts share are one list
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.r_[edge, len(h)])
        total = np.add.reduceat(mix(names.astype(np.uint64)), edge) if len(edge) else np.zeros(0, np.uint64)
        h = np.repeat(mix(total + size.astype(np.uint64)), size).view("<i8")
        nb = np.repeat(-(-size // block), size).astype(np.int32)
        for s in range(0, len(h), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000]) for x in (h, names, nb)], names=["list", "id", "nb"])

    dealt = rows.mapInArrow(lean(emit), "bucket int, h binary, ids binary").repartitionById(parts, F.col("bucket"))
    return dealt.mapInArrow(lean(meet), "list long, id long, nb int").distinct()


def in_blocks(members: DataFrame, key: str, id_: str) -> DataFrame:
    """members(key, id_, nb) with spot and side: members of a key are dealt to nb blocks, each pair of blocks and each block is a
    spot; side is 0 or 1 for the block of a pair, 2 where the spot is one block."""
    b = F.pmod(F.xxhash64(id_), F.col("nb")).cast("int")
    m = members.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spot = F.when(F.col("nb") == 1, F.col(key)).otherwise(F.xxhash64(key, F.least("b", "o"), F.greatest("b", "o")))
    return m.withColumn("spot", spot).withColumn("side", F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1))


def candidate_edges(lists: DataFrame, facts: DataFrame, parts: int) -> DataFrame:
    points = facts.groupBy(F.col("node").alias("id")).agg(F.max(F.struct("n", "v")).alias("f")).select("id", "f.n", "f.v")

    def join(batches):
        data = table_of(batches)
        if data is None:
            return
        h, ids, n, side = (data.column(c).to_numpy() for c in ("spot", "id", "n", "side"))
        order = np.lexsort((ids, h))
        h, ids, n, side = h[order], ids[order], n[order], side[order]
        # a text stands in many lists; its vector is unpacked once
        who, first, at = np.unique(ids, return_index=True, return_inverse=True)
        z = zstandard.ZstdDecompressor()
        vectors = np.frombuffer(b"".join(z.decompress(x.as_py()) for x in data.column("v").take(pa.array(order[first]))), np.uint8).reshape(-1, GROUPS)
        del data, who
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        size, forest = np.diff(edge), Forest()
        # the trees of lists that fit a leaf are that leaf; they are compared all at once
        few = np.repeat(size <= LEAF, size)
        last = np.repeat(edge[1:], size)
        p = np.flatnonzero(few)
        k = last[p] - p - 1
        ends = np.cumsum(k)
        a = 0
        while a < len(p):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 25_000, "right")))
            pp = np.repeat(p[a:b], k[a:b])
            qq = pp + 1 + np.arange(len(pp)) - np.repeat(np.cumsum(k[a:b]) - k[a:b], k[a:b])
            ok = comparable(n[pp], n[qq]) & ((side[pp] == 2) | (side[pp] != side[qq]))
            pp, qq = pp[ok], qq[ok]
            ok = bound(vectors[at[pp]], vectors[at[qq]]) >= need(n[pp], n[qq])
            for x, y in zip(ids[pp[ok]].tolist(), ids[qq[ok]].tolist(), strict=True):
                forest.union(x, y)
            a = b
        for g in np.flatnonzero(size > LEAF):
            s = slice(edge[g], edge[g + 1])
            candidates(ids[s], vectors[at[s]], n[s], side[s], forest)
        yield edges_of(forest)

    dealt = in_blocks(lists, "list", "id").select("spot", "side", "id")
    return dealt.join(points, "id").repartition(4 * parts, "spot").mapInArrow(lean(join), EDGES)


def verified_edges(rows: DataFrame, groups: DataFrame, parts: int, block: int) -> DataFrame:
    """Links that span the components: texts in candidate groups, their sets compared within the group."""
    # the filter's slots as 64-bit words, joined on the executors: FILTER / 64 rows at most
    slot = F.pmod(F.xxhash64("node"), F.lit(FILTER))
    words = groups.select(F.floor(slot / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).collect()
    mask = np.zeros(FILTER // 64, "<i8")
    for r in words:
        mask[r["w"]] = r["bits"]
    wanted = rows.sparkSession.sparkContext.broadcast(mask.view(np.uint8))

    def some(batches):
        for batch in batches:
            here = np.unpackbits(wanted.value, bitorder="little").view(bool)[batch.column("slot").to_numpy()]
            kept = batch.filter(pa.array(here))
            if kept.num_rows:
                yield kept.select(["id", "text"])

    # texts move, not sets: they are smaller
    held = rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(FILTER)).cast("int")).mapInArrow(lean(some), "id long, text string")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    seats = in_blocks(groups.join(sizes, "component").withColumnRenamed("node", "id"), "component", "id").select("id", "spot", "side")

    def verify(batches):
        data = table_of(batches)
        if data is None:
            return
        ids, spot, side = (data.column(c).to_numpy() for c in ("id", "spot", "side"))
        order = np.lexsort((ids, spot))
        edge = np.flatnonzero(np.r_[True, np.diff(spot[order]) != 0, True])
        forest = Forest()
        for first, last in zip(edge[:-1], edge[1:], strict=True):
            at = order[first:last]
            texts = data.column("text").take(pa.array(at)).combine_chunks()
            sets = [h[a:b] for _, h, bounds in in_chunks([pa.RecordBatch.from_arrays([pa.array(at), texts], names=["at", "text"])]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            linked(ids[at], sets, side[at], forest)
        yield edges_of(forest)

    return seats.join(held, "id").repartition(parts, "spot").mapInArrow(lean(verify), EDGES)


def linked(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, forest: Forest) -> None:
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    ids, n, side, sets = ids[order], n[order], side[order], [sets[k] for k in order]
    v = np.stack([vectors_of(s, np.array([0, len(s)]))[0] for s in sets])
    label = np.array([forest.find(x) for x in ids.tolist()])
    for i in range(len(ids) - 1):
        last = int(np.searchsorted(n, n[i] * 4 // 3, "right"))
        if last <= i + 1:
            continue
        rest = np.arange(i + 1, last)
        rest = rest[(label[rest] != label[i]) & ((side[rest] == 2) | (side[rest] != side[i])) & (4 * n[i] >= 3 * n[rest])]
        if not len(rest):
            continue
        rest = rest[bound(v[rest], v[i]) >= need(n[rest], n[i])]
        for j in rest.tolist():
            if label[j] != label[i] and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= need(n[i], n[j]):
                forest.union(int(ids[i]), int(ids[j]))
                a, b = label[i], label[j]
                label[label == max(a, b)] = min(a, b)


def links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, total: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row. total: the texts' bytes, where they are known."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    total = text_bytes(rows, "text") if total is None else total
    parts = parts_for(total, PART, 8)
    node = F.xxhash64("id", "text").alias("node")
    facts, sketch = described(rows.select(F.struct("id", node).alias("id"), "text").coalesce(parts_for(total, SKETCHED)))
    known = facts.where("id is not null and n > 0")
    level = spark.sparkContext.broadcast(levels(sketch, total))
    named = rows.where("id is not null").select(node.alias("id"), "text")
    lists = shared_prefixes(named, level, parts, 2 * block)
    near = components(candidate_edges(lists, known, parts), parts=parts)
    found = verified_edges(named, near, parts, block)
    names = known.select("node", "id").distinct()
    for end in ("a", "b"):
        found = found.join(names.select(F.col("node").alias(end), F.col("id").alias("doc")), end).drop(end).withColumnRenamed("doc", end)
    found = found.select("a", "b").where("a <> b")
    # equal sets join without being compared
    first = known.groupBy("print", "n").agg(F.min("id").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m")
    equal = known.join(first, ["print", "n"]).where("id <> b").select(F.col("id").alias("a"), "b")
    joined = components(found.union(equal), parts=parts).withColumnRenamed("node", "id")
    return facts.join(joined, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, without those that link, directly or by others, with a smaller doc_id."""
    total = text_bytes(docs.select(F.col(text).cast("string").alias("text")), "text")
    drop = links(docs, doc_id=doc_id, text=text, total=total, **options).where("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias(doc_id)).distinct()
    return docs.join(drop, doc_id, "left_anti").select(docs.columns).coalesce(parts_for(total, PART, 8))
