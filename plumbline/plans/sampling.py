"""Registered queries of draws, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import adapters as A
from plumbline.operators import sampling as P
from plumbline.plans.queries import _h, query

G = "(SELECT event_id, user_id, CAST(value >= 50 AS INTEGER) AS y FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") >= 50).cast("int").alias("y"))


@query(f"""WITH c AS (SELECT user_id, y, count(*) AS k FROM {G} GROUP BY 1, 2), m AS (SELECT user_id, y, sum(k) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, y) AS r FROM c)
SELECT user_id, y, CAST(n AS BIGINT) AS n FROM m WHERE r = 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.majority(events(spark, sf_dir), "user_id", "y")


@query(f"""WITH c AS (SELECT user_id, y, count(*) AS k FROM {G} GROUP BY 1, 2), m AS (SELECT user_id, y AS s, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, y) AS r FROM c),
g AS (SELECT user_id, s, row_number() OVER (PARTITION BY s ORDER BY {_h('5', 'user_id')}, user_id) AS k, count(*) OVER (PARTITION BY s) AS n FROM m WHERE r = 1),
x AS (SELECT user_id, k, n, round_even(n * 0.15, 0) AS t, round_even(n * 0.1, 0) AS v FROM g)
SELECT event_id, CASE WHEN k <= n - t - v THEN 'train' WHEN k <= n - t THEN 'validation' ELSE 'test' END AS split FROM events JOIN x USING (user_id)""")
def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grouped_split(events(spark, sf_dir), "user_id", "y", validation=0.1, test=0.15, seed="5").select("event_id", "split")


@query(f"""WITH n AS (SELECT toxic, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*), toxic) AS r FROM labels GROUP BY 1), f AS (SELECT greatest(1, least(59, round_even(n * 60 / total, 0))) AS few FROM n WHERE r = 1),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_h('0', 'doc_id')}, doc_id) AS k FROM labels)
SELECT doc_id, r.toxic FROM r JOIN n ON r.toxic = n.toxic, f WHERE k <= CASE WHEN total <= 60 THEN n WHEN n.r = 1 THEN few ELSE 60 - few END""")
def cap_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proportional_cap(A.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 60)


WORDS = {"first": r"(?i)(?:^|[ \n])(?:the|und)[ \n.,]", "second": r"(?i)(?:^|[ \n])(?:de|la)[ \n.,]"}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in WORDS.items()) + " ELSE 'other' END AS stratum FROM documents")
def trigger_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", P.strata(F.col("text"), **WORDS).alias("stratum"))


@query(f"WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h('2', 'o_orderkey')}, o_orderkey) AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.07)) SELECT o_orderkey, o_orderstatus FROM r WHERE k <= 40")
def confirmation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return P.confirmation(o, A.complaints(spark, sf_dir).withColumnRenamed("review_id", "o_orderkey"), "o_orderkey", "o_orderstatus", 40, seed="2")


@query("""WITH d AS (SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 0), n AS (SELECT lang, count(*) AS n FROM d GROUP BY 1), p AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1)
SELECT doc_id, lang, round(size / n, 6) AS weight FROM d JOIN n USING (lang) JOIN p USING (lang)""")
def combined_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping draws as one sample; the draws themselves are the feature."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return P.combined(d.where("doc_id % 4 = 0"), d.where("doc_id % 6 = 0"), d, "doc_id", "lang").withColumn("weight", F.round("weight", 6))


@query(f"SELECT row_number() OVER (ORDER BY {_h('9', 'doc_id')}) AS item, text, '' AS label, '' AS done FROM documents")
def blind_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blind_sheet(A.table(spark, sf_dir, "documents"), "doc_id", "text", ["label", "done"], seed="9")


@query(f"""WITH u AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_h('0', 'doc_id')}) AS k FROM u), s AS (SELECT doc_id, CASE WHEN k <= 60 THEN 'train' WHEN k <= 80 THEN 'dev' ELSE 'test' END AS split FROM r WHERE k <= 100)
SELECT doc_id, split, row_number() OVER (ORDER BY {_h('0second', 'doc_id')}) <= 20 AS second_rater FROM s""")
def primary_topic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.primary_topic_sample(A.table(spark, sf_dir, "documents"), "doc_id", "text", {"train": 60, "dev": 20, "test": 20}, 20)


@query(f"""WITH c AS (SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {_h('0', 'event_id')}, event_id) AS k FROM events) WHERE k <= 3),
g AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY {_h('0group', 'user_id')}) AS r FROM c GROUP BY 1), b AS (SELECT user_id, sum(n) OVER (ORDER BY r) - n AS before FROM g)
SELECT event_id, user_id, CASE WHEN before < 30 THEN 'dev' ELSE 'test' END AS split FROM c JOIN b USING (user_id) WHERE before < 90""")
def split_property_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.property_capped(A.table(spark, sf_dir, "events"), "event_id", "user_id", 3, {"dev": 30, "test": 60})


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_h('4', 'doc_id')}) AS k FROM documents) WHERE k <= 50")
def time_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sorted_choice(A.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, seed="4")


@query(f"""WITH d AS (SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_h('0', 'doc_id')}, doc_id) AS k FROM labels) WHERE k <= 25), i AS (SELECT row_number() OVER (ORDER BY {_h('0item', 'doc_id')}) AS item, doc_id, toxic FROM d)
SELECT item, doc_id, toxic, CAST((item + 9) // 10 AS INTEGER) AS batch FROM i""")
def relabel_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.batches(P.relabel_draw(A.table(spark, sf_dir, "labels"), "doc_id", "toxic", 25), "item", 10)


@query(f"""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY {_h('0', 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars >= 500)
SELECT doc_id, 'D' AS phase, 1.0::DOUBLE AS weight FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id, 'C', round(n / least(n, 15), 6) FROM s WHERE k <= 15""")
def two_phase_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") < 100, "D").when(F.col("n_chars") >= 500, "C").otherwise("Z").alias("phase"))
    return P.two_phase(d, "doc_id", "phase", "D", "C", "lang", 15).withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 12")
def first_of_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_of_class(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 12)


@query("SELECT l_orderkey, l_linenumber, place FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS place FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) WHERE place <= 2")
def bounded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    r = P.bounded_children(A.table(spark, sf_dir, "orders"), lines, "o_orderkey", [F.col("l_shipdate"), F.col("l_linenumber")], 2)
    return r.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "place")
