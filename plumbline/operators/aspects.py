"""Aspect analytics for one hotel: windowed tallies, trend, priority, evidence, votes.

`as_of` stands for now everywhere. Every read names its hotel, so files partitioned by hotel_id are pruned."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTIMENTS = ("positive", "negative", "neutral")


def in_window(rows: DataFrame, hotel_id, as_of: datetime, days: int, back: int = 0) -> DataFrame:
    """Rows of a hotel in [as_of - (back + 1) * days, as_of - back * days)."""
    lo, hi = as_of - timedelta(days=days * (back + 1)), as_of - timedelta(days=days * back)
    return rows.where((F.col("hotel_id") == hotel_id) & (F.col("review_ts") >= F.lit(lo)) & (F.col("review_ts") < F.lit(hi)))


def tally(rows: DataFrame) -> DataFrame:
    """Counts for each aspect, a review once for each: its first valid row by id. Rows without a review count as they are."""
    r = rows.where(F.col("aspect").isNotNull() & F.col("sentiment").isin(*SENTIMENTS))
    named = r.where("review_id is not null").groupBy("review_id", "aspect").agg(F.min_by("sentiment", "id").alias("sentiment"))
    r = named.select("aspect", "sentiment").unionByName(r.where("review_id is null").select("aspect", "sentiment"))
    counts = [F.count_if(F.col("sentiment") == s).alias(f"{s}_count") for s in SENTIMENTS]
    return r.groupBy("aspect").agg(F.count("*").alias("review_count"), *counts)


def priority(negative_rate, volume, trend, weight: float = 0.5) -> Column:
    """45 % rate, 25 % volume, 20 % worsening trend, 10 % business weight."""
    rising = F.least(F.greatest(F.coalesce(trend, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.round(0.45 * negative_rate + 0.25 * volume + 0.20 * rising + 0.10 * F.lit(weight), 4)


def volume(n, most) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(n.cast("double"), most.cast("double"))), F.lit(0.0))


def summary(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """Tallies with rate, trend against the previous rows (null without any) and priority, worst first."""
    rate = F.try_divide(F.col("negative_count").cast("double"), F.col("review_count").cast("double"))
    now, before = tally(rows), tally(previous).select("aspect", rate.alias("before"))
    most = now.agg(F.max("review_count").alias("most"))
    j = now.join(before, "aspect", "left").crossJoin(F.broadcast(most)).withColumn("r", rate).withColumn("trend", F.round(F.col("r") - F.col("before"), 4))
    out = j.select("aspect", "review_count", *(f"{s}_count" for s in SENTIMENTS), F.round("r", 4).alias("negative_rate"), "trend", priority(F.col("r"), volume(F.col("review_count"), F.col("most")), F.col("trend")).alias("priority_score"))
    return out.orderBy(F.desc("priority_score"), "aspect")


def recommendations(rows: DataFrame, hotel_id, days: int, as_of: datetime, texts: DataFrame | None = None) -> DataFrame:
    """The summary's aspects with negatives; texts(aspect, recommendation) adds advice: the aspect's own, else its category's (what stands
    before the dot), else a generic one."""
    if not 7 <= days <= 365:
        raise ValueError("days must be 7 to 365")
    out = summary(in_window(rows, hotel_id, as_of, days), in_window(rows, hotel_id, as_of, days, 1)).where("negative_count > 0")
    if texts is not None:
        wide = texts.select(F.col("aspect").alias("category"), F.col("recommendation").alias("wider"))
        out = out.join(texts, "aspect", "left").withColumn("category", F.substring_index("aspect", ".", 1)).join(wide, "category", "left")
        out = out.withColumn("recommendation", F.coalesce("recommendation", "wider", F.lit("Read the negative reviews and plan improvements."))).drop("category", "wider")
    return out


def evidence(rows: DataFrame, hotel_id, aspect: str, days: int, as_of: datetime, limit: int = 5) -> DataFrame:
    """The newest negative rows of an aspect, 20 at most."""
    r = in_window(rows, hotel_id, as_of, days).where((F.col("aspect") == aspect) & (F.col("sentiment") == "negative"))
    return r.orderBy(F.desc("review_ts"), F.desc("id")).limit(max(1, min(20, limit)))


def review_vote(rows: DataFrame) -> DataFrame:
    """(review_id, overall): aspects vote, a tied aspect is neutral; then aspects decide, ties give null."""
    n = {s: F.count_if(F.col("sentiment") == s) for s in ("positive", "negative")}
    per = rows.groupBy("review_id", "aspect").agg(n["positive"].alias("p"), n["negative"].alias("m"))
    sign = F.signum(F.col("p") - F.col("m"))
    total = per.groupBy("review_id").agg(F.sum(sign).alias("s"))
    return total.select("review_id", F.when(F.col("s") > 0, "positive").when(F.col("s") < 0, "negative").alias("overall"))


def saved_vote(rows: DataFrame) -> DataFrame:
    """One row for each (review, aspect): the most frequent sentiment, neutral where the first two tie, and the id of the first
    row with it, else the first."""
    c = rows.groupBy("review_id", "aspect", "sentiment").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    w = Window.partitionBy("review_id", "aspect").orderBy(F.desc("n"), "first")
    r = c.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).withColumn("any", F.min("first").over(Window.partitionBy("review_id", "aspect")))
    neutral = F.min(F.when(F.col("sentiment") == "neutral", F.col("first"))).over(Window.partitionBy("review_id", "aspect"))
    r = r.withColumn("neutral_first", neutral).where("k = 1")
    tie = F.col("n") == F.col("next")
    return r.select("review_id", "aspect", F.when(tie, "neutral").otherwise(F.col("sentiment")).alias("sentiment"), F.when(tie, F.coalesce("neutral_first", "any")).otherwise(F.col("first")).alias("quote_id"))


def scoped(rows: DataFrame, hotels: list) -> DataFrame:
    """What a key with these hotels may read."""
    return rows.where(F.col("hotel_id").isin(*hotels)) if hotels else rows.where(F.lit(False))
