"""Draws: grouped splits, caps by class, samples with exclusions and weights, blind sheets, batches.

Order comes from the hash of a seed and the key (dataset.hash_order), so every draw is the same under any partitioning. Ranks
are taken within strata; where a stratum is the whole table they come from dataset.global_rank's counts of hash ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.dataset import global_rank, hash_order


def half_even(c: Column) -> Column:
    """Rounded to a whole number, halves to even."""
    return F.bround(c, 0).cast("long")


def majority(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n): the most frequent label of each group, the smallest of equals, and the group's rows."""
    c = rows.groupBy(group, label).agg(F.count("*").alias("k"))
    return c.groupBy(group).agg(F.min_by(label, F.struct((-F.col("k")).alias("k"), F.col(label).alias("l"))).alias(label), F.sum("k").alias("n"))


def grouped_split(rows: DataFrame, group: str, label: str, *, validation: float, test: float, seed: str = "0") -> DataFrame:
    """rows with split. Groups stay whole; in each stratum, the groups with one majority label, exactly round(n * share) groups go to
    test and to validation, the rest to train."""
    g = majority(rows, group, label).select(group, F.col(label).alias("stratum"))
    n = g.groupBy("stratum").agg(F.count("*").alias("n"))
    g = g.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy(hash_order(seed, group), group))).join(F.broadcast(n), "stratum")
    t, v = half_even(F.col("n") * test), half_even(F.col("n") * validation)
    split = F.when(F.col("k") <= F.col("n") - t - v, "train").when(F.col("k") <= F.col("n") - t, "validation").otherwise("test")
    return rows.join(g.select(group, split.alias("split")), group)


def proportional_cap(rows: DataFrame, key: str, label: str, most: int, *, seed: str = "0") -> DataFrame:
    """At most `most` rows with the two labels' shares kept: the smaller label gets its rounded share, one at least and one less than
    all at most."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    total, low = n.agg(F.sum("n").alias("total")), n.agg(F.min_by(label, F.struct("n", label)).alias("low"))
    sizes = n.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(low))
    few = F.max(F.when(F.col(label) == F.col("low"), half_even(F.col("n") * most / F.col("total")))).over(Window.partitionBy())
    few = F.greatest(F.lit(1), F.least(F.lit(most - 1), few))
    take = F.when(F.col("total") <= most, F.col("n")).when(F.col(label) == F.col("low"), few).otherwise(most - few)
    k = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, key), key))
    return rows.withColumn("k", k).join(F.broadcast(sizes.select(label, take.alias("take"))), label).where("k <= take").select(rows.columns)


def strata(c: Column, **words: str) -> Column:
    """The first stratum whose words a text holds, else 'other'."""
    out = F
    for name, pattern in words.items():
        out = out.when(F.rlike(c, F.lit(pattern)), F.lit(name))
    return out.otherwise(F.lit("other"))


def confirmation(rows: DataFrame, used: DataFrame, key: str, period: str, each: int, *, seed: str = "0") -> DataFrame:
    """`each` rows of every period that no earlier sample used."""
    fresh = rows.join(used.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("k", F.row_number().over(Window.partitionBy(period).orderBy(hash_order(seed, key), key))).where(F.col("k") <= each).drop("k")


def combined(old: DataFrame, new: DataFrame, population: DataFrame, key: str, stratum: str) -> DataFrame:
    """Old and new draws of the same strata as one sample: weight N / (rows drawn from the stratum), half of what one of two equal draws had."""
    rows = old.select(key, stratum).unionByName(new.select(key, stratum)).dropDuplicates([key])
    n, size = rows.groupBy(stratum).agg(F.count("*").alias("n")), population.groupBy(stratum).agg(F.count("*").alias("size"))
    return rows.join(F.broadcast(n.join(size, stratum)), stratum).select(key, stratum, (F.col("size") / F.col("n")).alias("weight"))


def held_out_tenth(pool: Column) -> Column:
    return pool % 10 == 0


def blind_sheet(rows: DataFrame, key: str, text: str, labels: list[str], *, seed: str = "0") -> DataFrame:
    """(item, text, empty label columns): numbered in a shuffled order that doesn't show where a row comes from."""
    r = global_rank(rows.select(key, text), hash_order(seed, key))
    return r.select(F.col("rank").cast("long").alias("item"), F.col(text).alias("text"), *(F.lit("").alias(c) for c in labels))


def primary_topic_sample(rows: DataFrame, key: str, canonical: str, sizes: dict[str, int], second: int, *, seed: str = "0") -> DataFrame:
    """(key, split, second_rater): unique texts, the named splits filled one after another in hash order; a second rater sees `second`
    rows of the whole sample."""
    unique = rows.groupBy(canonical).agg(F.min(key).alias(key)).select(key)
    total = sum(sizes.values())
    r = global_rank(unique, hash_order(seed, key)).where(F.col("rank") <= total)
    out, at = F, 0
    for name, n in sizes.items():
        at += n
        out = out.when(F.col("rank") <= at, F.lit(name))
    r = r.withColumn("split", out).drop("rank")
    return global_rank(r, hash_order(f"{seed}second", key)).select(key, "split", (F.col("rank") <= second).alias("second_rater"))


def property_capped(rows: DataFrame, key: str, group: str, most: int, sizes: dict[str, int], *, seed: str = "0") -> DataFrame:
    """(key, group, split): `most` rows of a group at most; whole groups in hash order fill the splits one after another. The rows of
    a sample number a few times its sizes, the groups before them are counted, not ordered by one task."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, key), key))
    capped = rows.select(key, group).withColumn("k", k).where(F.col("k") <= most).drop("k")
    g = global_rank(capped.groupBy(group).agg(F.count("*").alias("n")), hash_order(f"{seed}group", group))
    g = g.where(F.col("rank") <= sum(sizes.values())).withColumn("before", F.sum("n").over(Window.orderBy("rank")) - F.col("n"))
    out, at = F, 0
    for name, n in sizes.items():
        at += n
        out = out.when(F.col("before") < at, F.lit(name))
    return capped.join(F.broadcast(g.select(group, out.otherwise(None).alias("split"))), group).where("split is not null").select(key, group, "split")


def sorted_choice(rows: DataFrame, key: str, n: int, *, seed: str = "0") -> DataFrame:
    """n rows without replacement, in the order of their key."""
    return global_rank(rows, hash_order(seed, key)).where(F.col("rank") <= n).drop("rank").orderBy(key)


def batches(rows: DataFrame, item: str, size: int) -> DataFrame:
    """rows with batch, from 1: items in their order, `size` in each. item: consecutive numbers from 1."""
    return rows.withColumn("batch", F.ceil(F.col(item) / size).cast("int"))


def relabel_draw(labels: DataFrame, key: str, set_: str, each: int, *, seed: str = "0") -> DataFrame:
    """(item, key, set): `each` rows of every set at random, numbered anew in a shuffled order."""
    k = F.row_number().over(Window.partitionBy(set_).orderBy(hash_order(seed, key), key))
    drawn = labels.select(key, set_).withColumn("k", k).where(F.col("k") <= each).drop("k")
    return global_rank(drawn, hash_order(f"{seed}item", key)).select(F.col("rank").cast("long").alias("item"), key, set_)


def two_phase(rows: DataFrame, key: str, phase: str, certain: str, sampled: str, stratum: str, each: int, *, seed: str = "0") -> DataFrame:
    """All rows of phase `certain` with weight 1, `each` rows of every stratum of phase `sampled` with weight N / n."""
    s = rows.where(F.col(phase) == sampled)
    n = s.groupBy(stratum).agg(F.count("*").alias("size"))
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(seed, key), key))
    drawn = s.withColumn("k", k).where(F.col("k") <= each).join(F.broadcast(n), stratum)
    weight = F.col("size") / F.least(F.col("size"), F.lit(each))
    return rows.where(F.col(phase) == certain).select(key, phase, F.lit(1.0).alias("weight")).unionByName(drawn.select(key, phase, weight.cast("double").alias("weight")))


def first_of_class(rows: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """The first n rows of each class by key."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(label).orderBy(key))).where(F.col("k") <= n).drop("k")


def bounded_children(parents: DataFrame, children: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """Each parent's first `most` children by the order, with their place."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return children.join(parents.select(key).distinct(), key, "left_semi").withColumn("place", k).where(F.col("place") <= most)
