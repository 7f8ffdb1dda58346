"""Connected components of an edge list, by large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

EDGES = "a long, b long"


class Forest:
    """Union by least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root and x != root:
            self.up[x] = root
            x = p
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _contract(batches):
    """Edges of a partition to its spanning stars; a bounded forest at a time."""

    def stars(forest: Forest):
        rows = [(x, r) for x in list(forest.up) if (r := forest.find(x)) != x]
        if rows:
            a = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.up) > 1_000_000:
            yield from stars(forest)
            forest = Forest()
    yield from stars(forest)


def components(edges: DataFrame, what: str = "stars", parts: int | None = None) -> DataFrame:
    """(node, component): every node that an edge names, with the least node it is joined to. edges: a, b long. parts: the most
    files that a round writes; without it there are as many as shuffle partitions, each a few rows where edges are few.

    Each round joins every node's larger neighbours, then its smaller ones, to its least neighbour; rounds end when the
    edges no longer change. A star's centre is a hot join key, which adaptive execution splits."""
    now = edges.where("a <> b")
    now = stored((now.repartition(parts) if parts else now).mapInArrow(_contract, EDGES), what)
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # large star leaves a > b in every edge; small star joins the smaller neighbours and the node itself
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        now = stored(after.coalesce(parts) if parts else after, what)
        after = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)), F.countDistinct("a")).first())
        if after == state or after[0] == 0:
            break
        state = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
