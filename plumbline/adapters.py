"""Domain views over the benchmark tables: reviews, complaints, aspect events, labelled texts, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLAINT_DISCOUNT = 0.07


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, topic), each pair once: an order complains of a return flag where a line has a large discount."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_discount") >= COMPLAINT_DISCOUNT).select(F.col("l_orderkey").alias("review_id"), F.col("l_returnflag").alias("topic")).distinct()


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each order; its hotel is the customer's nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("hotel_id"), F.col("c_mktsegment").alias("nationality"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("review_id"), "hotel_id", F.to_date("o_orderdate").alias("review_date"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        "nationality", F.col("o_orderstatus").alias("trip_type"), F.col("o_orderpriority").alias("traveller_type"), F.col("o_totalprice").alias("score"),
    )


def review_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews' dates alone: every order has a customer, so no join is needed for them."""
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("review_date"))


def flagged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reviews with has_complaint_text."""
    some = complaints(spark, sf_dir).select("review_id").distinct().withColumn("has", F.lit(True))
    return reviews(spark, sf_dir).join(some, "review_id", "left").withColumn("has_complaint_text", F.coalesce("has", F.lit(False))).drop("has")


def aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspect rows from events: hotel by user, aspect by type, sentiment by value, a review for each user and hour."""
    e = table(spark, sf_dir, "events")
    band = F.when(F.col("value") < 30, "negative").when(F.col("value") < 60, "neutral").otherwise("positive")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("hotel_id"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMddHH")).alias("review_id"), F.col("ts").alias("review_ts"), F.col("event_type").alias("aspect"), band.alias("sentiment"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, truth, a, b, p): labelled documents with two simple predictors and a score of the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    r = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return r.select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.col("lang").alias("stratum"), F.col("quality").alias("truth"), (F.col("n_chars") >= 600).cast("int").alias("a"), (F.col("n_chars") % 7 > 0).cast("int").alias("b"), "toxic", ((F.col("n_chars") % 97) / F.lit(97.0)).alias("p"))
