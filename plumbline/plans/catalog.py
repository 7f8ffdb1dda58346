"""The engine in SQL: views of a folder's tables, the domain's views over them, and its functions by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from plumbline import adapters as A
from plumbline.functions import text as X

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Views in SQL over the tables.
VIEWS = {
    "hotel_months": "SELECT hotel_id, month, count(*) AS reviews, sum(score) AS total_score, avg(score) AS mean_score FROM reviews GROUP BY hotel_id, month",
    "complaint_months": "SELECT c.topic, r.month, count(*) AS complaining FROM complaints c JOIN reviews r ON r.review_id = c.review_id GROUP BY c.topic, r.month",
}

#: Functions of SQL alone: name, arguments, result, body.
FUNCTIONS = (
    ("safe_ratio", "a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, b)"),
    ("month_of", "d DATE", "STRING", "date_format(d, 'yyyy-MM')"),
    ("rates_of", "wanted STRING", "TABLE (month STRING, rate DOUBLE)", "SELECT c.month, safe_ratio(c.complaining, sum(h.reviews)) FROM complaint_months c JOIN hotel_months h ON h.month = c.month WHERE c.topic = wanted GROUP BY c.month, c.complaining"),
)


def open_folder(spark: SparkSession, sf_dir: str) -> list[str]:
    """Registers the folder's tables, the domain's views, SQL functions and Python functions in the session; returns the names of the views.
    A table that the folder doesn't hold is left out, and so is what needs it."""
    names = []
    for t in TABLES:
        try:
            A.table(spark, sf_dir, t).createOrReplaceTempView(t)
            names.append(t)
        except Exception as e:  # noqa: BLE001 - Spark has one class of error for every missing path
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if {"orders", "customer", "lineitem"} <= set(names):
        A.flagged_reviews(spark, sf_dir).createOrReplaceTempView("reviews")
        A.complaints(spark, sf_dir).createOrReplaceTempView("complaints")
        for name, sql in VIEWS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {sql}")
        names += ["reviews", "complaints", *VIEWS]
        for name, arguments, result, body in FUNCTIONS:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    register(spark)
    return names


def register(spark: SparkSession) -> None:
    """The text functions that need Python, by name in SQL."""
    for name in ("canonical_text", "review_key", "strip_diacritics", "normalize_review", "group_key"):
        spark.udf.register(name, getattr(X, name))


def from_frames(spark: SparkSession, **frames: DataFrame) -> None:
    """Frames as tables of the session, under the names that queries use."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query of one's own over the folder, its views and functions."""
    open_folder(spark, os.fspath(sf_dir))
    return spark.sql(text)
