"""Embedding near-duplicates: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs.

Vectors are compared only within equal labels. Vectors that are equal in every component are one class, found by their
bytes, so copies never meet as pairs. Each of `tables` hash tables joins `joint` cross-polytope hashes, each the nearest
signed axis after three rounds of random signs and a Walsh-Hadamard transform; a class stands in the bucket of its hash
and, as a probe, in those that its next nearest axes give. A pair is verified, by cosine in double precision, in one
bucket only: the first table and side where a probe of one meets the hash of the other. Buckets of more than `block`
classes are dealt as pairs of blocks. What leaves a bucket is a count for each class and a spanning forest of its links.

Defined cases: null labels, null or zero vectors and null or non-finite components link with nothing; so do vectors of
different lengths; repeated rows are copies like others; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import parts_for, stored, table_of
from plumbline.llm.components import Forest, components

LEAST = 0.93
TABLES, JOINT, PROBES, BLOCK = 8, 2, 1, 1024


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x, a power of two wide, after a Walsh-Hadamard transform for each row of signs."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
            h *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, joint: int = JOINT, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """int64 (rows, tables, 1 + 2 * probes): the hash, then probes by cost, of unit rows."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    out = np.empty((n, tables, 1 + joint * probes), np.int64)
    for t in range(tables):
        rng, axes = np.random.default_rng([seed, t]), []
        for _ in range(joint):
            y = rotated(x, rng.choice([-1.0, 1.0], (3, wide)))
            near = np.argsort(-np.abs(y), 1, kind="stable")[:, : probes + 1]
            axes.append(near + wide * (np.take_along_axis(y, near, 1) < 0))
        base = [a[:, 0] for a in axes]
        join = lambda parts: sum(p * (2 * wide) ** i for i, p in enumerate(parts))
        out[:, t, 0] = join(base)
        for j in range(joint):
            for p in range(probes):
                out[:, t, 1 + j * probes + p] = join([axes[i][:, p + 1] if i == j else b for i, b in enumerate(base)])
    return out


def units(column) -> np.ndarray:
    """(rows, width) doubles of unit length; all rows have one width here."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components stay in range
    return x / np.sqrt((x * x).sum(1))[:, None]


def meetings(group: np.ndarray, base: np.ndarray, side: np.ndarray, small: int):
    """Positions (p, q) to compare, in pieces: rows are sorted by group, hashes before probes. A hash meets each row after it in its
    group, on the other side where the group is one of two blocks (side 0 or 1; 2: either). Piece: (p, q), or two slices to multiply."""
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.diff(edge)
    end = np.repeat(edge[1:], size)
    few = np.repeat(size <= small, size) & base
    p = np.flatnonzero(few)
    n = end[p] - p - 1
    total = np.cumsum(n)
    for lo in range(0, int(total[-1]) if len(total) else 0, 100_000):
        a, b = np.searchsorted(total, lo, "right"), np.searchsorted(total, lo + 100_000, "left") + 1
        k = n[a:b]
        pp = np.repeat(p[a:b], k)
        qq = pp + 1 + np.arange(len(pp)) - np.repeat(np.cumsum(k) - k, k)
        at = (total[a] - n[a]) + np.arange(len(pp))
        here = (at >= lo) & (at < lo + 100_000)
        pp, qq = pp[here], qq[here]
        ok = (side[pp] == 2) | (side[pp] != side[qq])
        yield pp[ok], qq[ok]
    for g in np.flatnonzero(size > small):
        first, last = edge[g], edge[g + 1]
        hashes = first + int(base[first:last].sum())
        for lo in range(first, hashes, 512):
            for to in range(lo, last, 4096):
                yield slice(lo, min(lo + 512, hashes)), slice(to, min(to + 4096, last))


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST, tables: int = TABLES, joint: int = JOINT, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    kept = rows.where(good)
    classes = stored(kept.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    member = kept.join(classes, ["label", "v"]).select("vec_id", F.col("id").alias("of"), "copies").groupBy("vec_id").agg(F.min("of").alias("of"), F.min("copies").alias("copies"))
    each = tables * (1 + joint * probes)

    def hashed(batches):
        for batch in batches:
            widths = np.array([len(v) for v in batch.column("v")])
            for w in np.unique(widths):
                part = batch.filter(pa.array(widths == w))
                n = part.num_rows
                c = codes(units(part.column("v")), tables, joint, probes).reshape(n, each)
                rows_at = pa.array(np.repeat(np.arange(n), each))
                t = np.tile(np.repeat(np.arange(tables), each // tables), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t, pa.int32()), pa.array(c.ravel()), pa.array(np.full(n * each, w), pa.int32()), pa.array(np.tile(np.arange(each) % (each // tables) == 0, n)), *(part.column(q).take(rows_at) for q in ("label", "id"))],
                    names=["t", "bucket", "width", "base", "label", "id"],
                )

    seats = classes.mapInArrow(hashed, "t int, bucket long, width int, base boolean, label string, id long")
    where = ["t", "bucket", "width", "label"]
    # buckets without two classes, or without a hash, verify nothing; large ones are dealt as pairs of blocks
    sizes = seats.groupBy(where).agg(F.count("*").alias("m"), F.max("base").alias("any_base")).where("m > 1 and any_base").drop("any_base")
    seats = seats.join(sizes, where).withColumn("nb", F.ceil(F.col("m") / block).cast("int"))
    seats = seats.withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    seats = seats.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select(*where, "base", "id", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    facts = seats.join(classes.select("id", "copies", "v"), "id").select("t", "bucket", "base", "id", "copies", "v", F.when(F.col("i") == F.col("j"), 2).when(F.col("b") == F.col("i"), 0).otherwise(1).alias("side"), F.xxhash64(*where, "i", "j").alias("spot"))
    count = classes.count()
    dealt = facts.repartition(parts_for(count * each, 150_000, 8), "spot")

    def verify(batches):
        data = table_of(batches)
        if data is None:
            return
        for width in np.unique(lengths := pc.list_value_length(data.column("v")).to_numpy()):
            yield from verified(data.filter(pa.array(lengths == width)))

    def verified(data):
        ids, spot, bucket, t, side = (data.column(q).to_numpy() for q in ("id", "spot", "bucket", "t", "side"))
        base = data.column("base").to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, ~base, spot))
        ids, spot, bucket, t, side, base = (a[order] for a in (ids, spot, bucket, t, side, base))
        who, first, at = np.unique(ids, return_index=True, return_inverse=True)
        x = units(data.column("v").combine_chunks().take(pa.array(order[first])))
        copies = data.column("copies").to_numpy()[order][first]
        c = codes(x, tables, joint, probes)
        links, forest, edges = np.zeros(len(who), np.int64), Forest(), []
        for p, q in meetings(spot, base, side, 64):
            if isinstance(p, slice):
                # a product that is near enough; each pair is judged below, by the same sum wherever it meets
                a, b = np.nonzero(x[at[p]] @ x[at[q]].T >= least - 1e-9)
                p, q = a + p.start, b + q.start
                ok = (q > p) & ((side[p] == 2) | (side[p] != side[q]))
                p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", x[at[p]], x[at[q]]) >= least
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            lo, hi = np.minimum(at[p], at[q]), np.maximum(at[p], at[q])
            # counted only where the hash of one first meets a code of the other, the lesser id's hash before the other's
            one, two = (c[lo, :, :1] == c[hi]).any(2), (c[hi, :, :1] == c[lo]).any(2)
            table, r = (one | two).argmax(1), np.arange(len(lo))
            place = np.where(one[r, table], c[lo, table, 0], c[hi, table, 0])
            mine = (lo != hi) & (table == t[p]) & (place == bucket[p])
            lo, hi = lo[mine], hi[mine]
            np.add.at(links, lo, copies[hi])
            np.add.at(links, hi, copies[lo])
            for u, v in zip(who[lo].tolist(), who[hi].tolist(), strict=True):
                if forest.union(u, v):
                    edges.append((u, v))
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[who[some], e[:, 0]]), pa.array(np.r_[links[some], np.zeros(len(e), np.int64)]), pa.array(np.r_[who[some], e[:, 1]])], names=["id", "links", "to"])

    found = stored(dealt.mapInArrow(verify, "id long, links long, to long"), "links")
    counts = found.groupBy(F.col("id").alias("of")).agg(F.sum("links").alias("links"))
    parts = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "of")
    facts = member.join(counts, "of", "left").join(parts, "of", "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "of").alias("component_id"))
    out = rows.select("vec_id").join(facts, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
