"""Corpus building: labels, canonical deduplication, conflicts, splits, caps, samples, overlap checks, fingerprints.

Order comes from SHA-256 of a seed and the row's id, so every draw is reproducible in any engine and under any partitioning.
Ranks are taken within strata; a draw over all rows ranks by hash ranges first, so no task orders the whole table."""

from __future__ import annotations

import hashlib
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, key) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)


def drop_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Without the texts that carry contradictory labels."""
    bad = rows.groupBy(key).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b").select(key)
    return rows.join(bad, key, "left_anti")


def keep_earliest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in the order. An aggregate with map-side combine, not a window, so a frequent key isn't gathered."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns))


def global_rank(rows: DataFrame, order: Column, buckets: int = 256) -> DataFrame:
    """rows with rank, from 1, in the order of a hex digest: ranks within digest ranges plus the ranges' counts."""
    r = rows.withColumn("__o", order).withColumn("__b", F.floor(F.conv(F.substring("__o", 1, 4), 16, 10).cast("int") / (65536 // buckets)).cast("int"))
    n = r.groupBy("__b").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.orderBy("__b")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("__b").orderBy("__o"))
    return r.withColumn("__k", inner).join(F.broadcast(before), "__b").withColumn("rank", F.col("before") + F.col("__k")).drop("__o", "__b", "__k", "before")


def stratified_split(rows: DataFrame, key: str, label: str, *, test: float, dev: float, seed: str = "0", most: int | None = None) -> DataFrame:
    """rows with split: in each label the first rows by hash are test, then dev, at least one and at most n - 2 each; with `most` no more
    train rows of a label than that."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    r = rows.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key))).join(n, label)
    t = F.greatest(F.lit(1), F.least(F.floor(F.col("n") * test), F.col("n") - 2))
    d = F.greatest(F.lit(1), F.floor((F.col("n") - t) * dev))
    r = r.withColumn("split", F.when(F.col("k") <= t, "test").when(F.col("k") <= t + d, "dev").otherwise("train"))
    return (r if most is None else r.where((F.col("split") != "train") | (F.col("k") - t - d <= most))).drop("k", "n")


def time_split(rows: DataFrame, day: str, *, train: float, dev: float) -> DataFrame:
    """rows with split by date; a date never straddles, and too few dates for three splits are an error. Cut dates come from counts of dates."""
    n = rows.groupBy(day).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upto = F.sum("n").over(Window.orderBy(day))
    cuts = n.select(day, "n", upto.alias("upto"), total.alias("total"))
    first = lambda f: F.min(F.when(F.col("upto") > F.floor(F.col("total") * f), F.col(day)))
    c = cuts.agg(first(train).alias("c1"), first(train + dev).alias("c2"), F.count("*").alias("days"))
    few = F.col("days").isNull() | (F.col("days") < 3) | (F.col("c1") >= F.col("c2"))
    c = c.select(F.when(few, F.raise_error(F.lit("too few dates for three splits")).cast(rows.schema[day].dataType)).otherwise(F.col("c1")).alias("c1"), "c2")
    return rows.crossJoin(F.broadcast(c)).withColumn("split", F.when(F.col(day) < F.col("c1"), "train").when(F.col(day) < F.col("c2"), "dev").otherwise("test")).drop("c1", "c2")


def group_split(rows: DataFrame, group: str, *, test: float, dev: float, seed: str = "0", buckets: int = 256) -> DataFrame:
    """rows with split; whole groups, in the order of a hash, fill test until it has its share, then dev, then train. Running sums are
    taken within hash ranges and added to the counts of the ranges before, so no task orders all groups."""
    order = hash_order(seed, group)
    g = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("o", order)
    g = g.withColumn("b", F.floor(F.conv(F.substring("o", 1, 4), 16, 10).cast("int") / (65536 // buckets)).cast("int"))
    per = g.groupBy("b").agg(F.sum("n").alias("m"))
    all_ = Window.orderBy("b")  # over `buckets` rows
    per = per.select("b", (F.sum("m").over(all_) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inner = F.sum("n").over(Window.partitionBy("b").orderBy("o", group)) - F.col("n")
    g = g.join(F.broadcast(per), "b").withColumn("before", F.col("base") + inner)
    size = g.agg(F.coalesce(F.sum(F.when(F.col("before") < F.col("total") * test, F.col("n"))), F.lit(0)).alias("in_test"))
    g = g.crossJoin(F.broadcast(size))
    split = F.when(F.col("before") < F.col("total") * test, "test").when(F.col("before") - F.col("in_test") < F.col("total") * dev, "dev").otherwise("train")
    return rows.join(g.select(group, split.alias("split")), group)


def cap_per_class(rows: DataFrame, key: str, label: str, most: int, seed: str = "0") -> DataFrame:
    k = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key))
    return rows.withColumn("k", k).where(F.col("k") <= most).drop("k")


def stratified_sample(rows: DataFrame, key: str, stratum: str, each: int, seed: str = "0") -> DataFrame:
    """Up to `each` rows of each stratum with the weight N / n."""
    n = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    return cap_per_class(rows, key, stratum, each, seed).join(n, stratum).withColumn("weight", F.col("n") / F.least(F.col("n"), F.lit(each)).cast("double")).drop("n")


def two_stage_sample(rows: DataFrame, matches: DataFrame, key: str, topic: str, *, uniform: int, each: int, seed: str = "0") -> DataFrame:
    """(key, drawn_for): `uniform` rows of all for R, then up to `each` rows of every topic's matches that R doesn't hold."""
    r = global_rank(rows.select(key).distinct(), hash_order(seed + "R", key)).where(F.col("rank") <= uniform).select(key)
    m = matches.select(key, topic).distinct().join(r, key, "left_anti")
    k = F.row_number().over(Window.partitionBy(topic).orderBy(hash_order(seed + "M", key), key))
    m = m.withColumn("k", k).where(F.col("k") <= each).select(key, F.col(topic).cast("string").alias("drawn_for"))
    return r.withColumn("drawn_for", F.lit("R")).unionByName(m)


def shortfalls(sample: DataFrame, wanted: dict[str, int], drawn_for: str = "drawn_for") -> DataFrame:
    """(drawn_for, wanted, drawn): the topics for which fewer rows were found than wanted."""
    w = sample.sparkSession.createDataFrame(list(wanted.items()), f"{drawn_for} string, wanted int")
    n = sample.groupBy(drawn_for).agg(F.count("*").alias("drawn"))
    return w.join(n, drawn_for, "left").select(drawn_for, "wanted", F.coalesce("drawn", F.lit(0)).alias("drawn")).where("drawn < wanted")


def cross_split_overlap(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, shared): keys that two splits hold."""
    s = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x as split_a, y as split_b))))")
    return s.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


def assert_disjoint(rows: DataFrame, key: str, split: str = "split", policy: str = "raise") -> list[dict]:
    """The overlaps, at most one for each pair of splits; any is an error, a warning, or neither by the policy raise, warn or ignore."""
    if policy not in ("raise", "warn", "ignore"):
        raise ValueError(f"no policy {policy}")
    bad = [r.asDict() for r in cross_split_overlap(rows, key, split).collect()]
    if bad and policy == "raise":
        raise ValueError(f"splits share rows: {bad}")
    if bad and policy == "warn":
        warnings.warn(f"splits share rows: {bad}", stacklevel=2)
    return bad


def duplicates(rows: DataFrame, key: str, mode: str, *order: str) -> DataFrame:
    """rows with group, what a split keeps together: the key (mode group), the key with one row each, the first in the order (drop), or
    each row by itself (keep)."""
    if mode == "drop":
        return keep_earliest(rows, key, *order).withColumn("group", F.col(key).cast("string"))
    if mode in ("group", "keep"):
        return rows.withColumn("group", F.col(key).cast("string") if mode == "group" else F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in order)), 256))
    raise ValueError(f"no mode {mode}")


def ordered_digest(rows: DataFrame, order: str, *columns: str) -> str:
    """SHA-256 over all rows in their order, each value after its length in eight bytes: the digest of the whole sequence. Rows come to the
    driver one partition at a time and are folded there, since SHA-256 can't be joined from parts."""
    digest = hashlib.sha256()
    for r in rows.select(order, *(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"c{i}") for i, c in enumerate(columns))).orderBy(order).toLocalIterator():
        for value in r[1:]:
            raw = value.encode()
            digest.update(len(raw).to_bytes(8, "big") + raw)
    return digest.hexdigest()


def fingerprint(rows: DataFrame, *columns: str) -> str:
    """Digest of all rows whatever their order: digests by their first two digits, each an ordered digest of its rows'."""
    parts = F.concat_ws("", *(F.concat(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    d = rows.select(F.sha2(parts, 256).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    b = d.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(F.concat_ws("x", "d", "n")))), 256).alias("h"))
    return hashlib.sha256("".join(r["b"] + r["h"] for r in b.orderBy("b").collect()).encode()).hexdigest()


def extract_labelled(raw: DataFrame, *, positive: str = "Positive_Review", negative: str = "Negative_Review", most: int = 2000, least: int = 3, keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """(text, label, keep..., review_id): label rule, cleaning, conflicts out, earliest copy of each canonical text."""
    from plumbline.functions import text as T

    label = T.label_rule(F.col(positive), F.col(negative))
    r = raw.withColumn("label", label).where("label is not null")
    r = r.withColumn("text", T.clean_text(F.when(F.col("label") == 1, F.col(positive)).otherwise(F.col(negative)), most)).where(F.length("text") >= least)
    r = r.withColumn("review_id", T.review_id(F.col("text")))
    r = r.select("text", "label", *keep, "review_id", *(c for c in order if c not in keep))
    return keep_earliest(drop_conflicts(r, "review_id", "label"), "review_id", *(order or ("text",))).select("text", "label", *keep, "review_id")
