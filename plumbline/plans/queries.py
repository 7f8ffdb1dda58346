"""Registered queries of the engine's operators over the benchmark tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import adapters as A
from plumbline.functions import stats as S
from plumbline.functions import text as X
from plumbline.operators import aspects as AS
from plumbline.operators import dataset as D
from plumbline.operators import metrics as M
from plumbline.operators import state as ST
from plumbline.operators import trends as T
from plumbline.operators import triage as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = datetime(2024, 1, 31)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "bigint" else F.col(c) for c, t in df.dtypes))


VIEWS = """
rv AS (SELECT o_orderkey AS review_id, CAST(c_nationkey AS BIGINT) AS hotel_id, CAST(o_orderdate AS DATE) AS review_date, strftime(o_orderdate, '%Y-%m') AS month,
       c_mktsegment AS nationality, o_orderstatus AS trip_type, o_orderpriority AS traveller_type FROM orders JOIN customer ON o_custkey = c_custkey),
cp AS (SELECT DISTINCT l_orderkey AS review_id, l_returnflag AS topic FROM lineitem WHERE l_discount >= 0.07),
fr AS (SELECT *, review_id IN (SELECT review_id FROM cp) AS has FROM rv),
b AS (SELECT min(review_date) AS a, max(review_date) AS z FROM rv),
m AS (SELECT CASE WHEN day(a) = 1 THEN date_trunc('month', a) ELSE date_trunc('month', a) + INTERVAL 1 MONTH END AS f,
             CASE WHEN z = last_day(z) THEN date_trunc('month', z) ELSE date_trunc('month', z) - INTERVAL 1 MONTH END AS l FROM b),
s AS (SELECT f, l, least(12, datediff('month', f, l) + 1 - 12) AS k FROM m),
w AS (SELECT strftime(f, '%Y-%m') AS first_month, strftime(l, '%Y-%m') AS last_month, strftime(l - to_months(CAST(k + 11 AS INTEGER)), '%Y-%m') AS base_start, strftime(l - INTERVAL 12 MONTH, '%Y-%m') AS base_end,
             strftime(l - to_months(CAST(k - 1 AS INTEGER)), '%Y-%m') AS recent_start, strftime(l, '%Y-%m') AS recent_end FROM s),
rp AS (SELECT fr.*, CASE WHEN month BETWEEN base_start AND base_end THEN 'base' WHEN month BETWEEN recent_start AND recent_end THEN 'recent' END AS period FROM fr, w),
rq AS (SELECT * FROM rp WHERE period IS NOT NULL)"""
COUNTS = """,
ht AS (SELECT hotel_id, period, count(*) AS reviews FROM rq GROUP BY 1, 2),
el AS (SELECT hotel_id FROM ht GROUP BY 1 HAVING count(*) FILTER (WHERE reviews >= 30) = 2),
hc AS (SELECT hotel_id, period, topic, count(*) AS n FROM rq JOIN cp USING (review_id) GROUP BY 1, 2, 3),
hr AS (SELECT t.topic, ht.hotel_id, ht.period, ht.reviews, coalesce(hc.n, 0) AS complaining FROM ht JOIN el USING (hotel_id) CROSS JOIN (SELECT DISTINCT topic FROM cp) t LEFT JOIN hc ON hc.hotel_id = ht.hotel_id AND hc.period = ht.period AND hc.topic = t.topic)"""


@query(f"WITH {VIEWS} SELECT first_month, last_month, base_start, base_end, recent_start, recent_end FROM w")
def analysis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.windows_of(A.review_dates(spark, sf_dir))
    names = ("first_month", "last_month", "base_start", "base_end", "recent_start", "recent_end")
    return spark.range(1).select(*(F.lit(getattr(w, n)).alias(n) for n in names))


@query(f"""WITH {VIEWS}, mr AS (SELECT month, count(*) AS reviews FROM rv, w WHERE month BETWEEN first_month AND last_month GROUP BY 1),
mc AS (SELECT month, topic, count(*) AS n FROM rv JOIN cp USING (review_id) GROUP BY 1, 2),
g AS (SELECT mr.month, t.topic, mr.reviews, coalesce(n, 0) AS complaining_reviews FROM mr CROSS JOIN (SELECT DISTINCT topic FROM cp) t LEFT JOIN mc ON mc.month = mr.month AND mc.topic = t.topic)
SELECT month, topic, reviews, complaining_reviews, round(complaining_reviews / CAST(reviews AS DOUBLE), 6) AS rate, round(avg(complaining_reviews / CAST(reviews AS DOUBLE)) OVER (PARTITION BY topic ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rate_3m FROM g""")
def monthly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.reviews(spark, sf_dir)
    return rounded(T.monthly_rates(r, A.complaints(spark, sf_dir), T.windows_of(A.review_dates(spark, sf_dir))))


@query(f"""WITH {VIEWS}, t AS (SELECT count(*) FILTER (WHERE period = 'base') AS base_reviews, count(*) FILTER (WHERE period = 'recent') AS recent_reviews, count(*) FILTER (WHERE period = 'base' AND has) AS bc, count(*) FILTER (WHERE period = 'recent' AND has) AS rc FROM rq),
c AS (SELECT topic, count(*) FILTER (WHERE period = 'base') AS base_complaining, count(*) FILTER (WHERE period = 'recent') AS recent_complaining FROM rq JOIN cp USING (review_id) GROUP BY 1)
SELECT topic, base_complaining, base_reviews, recent_complaining, recent_reviews, round(base_complaining / CAST(base_reviews AS DOUBLE), 6) AS base_rate, round(recent_complaining / CAST(recent_reviews AS DOUBLE), 6) AS recent_rate,
round(recent_complaining / CAST(recent_reviews AS DOUBLE) - base_complaining / CAST(base_reviews AS DOUBLE), 6) AS change, round(base_complaining / CAST(bc AS DOUBLE), 6) AS base_share_of_complaints, round(recent_complaining / CAST(rc AS DOUBLE), 6) AS recent_share_of_complaints FROM c, t""")
def year_over_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.flagged_reviews(spark, sf_dir)
    return rounded(T.year_over_year(r, A.complaints(spark, sf_dir), T.windows_of(A.review_dates(spark, sf_dir))))


def _counts(spark: SparkSession, sf_dir: str, least: int = 30) -> DataFrame:
    r = A.reviews(spark, sf_dir)
    return T.hotel_counts(r, A.complaints(spark, sf_dir), T.windows_of(r, min_hotel_reviews=least))


@query(f"WITH {VIEWS}{COUNTS} SELECT topic, hotel_id, period, reviews, complaining FROM hr")
def unit_period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_counts(spark, sf_dir))


WITHIN = f"""WITH {VIEWS}{COUNTS}, x AS (SELECT topic, hotel_id, max(reviews) FILTER (WHERE period = 'base') AS bn, max(complaining) FILTER (WHERE period = 'base') AS bk, max(reviews) FILTER (WHERE period = 'recent') AS rn, max(complaining) FILTER (WHERE period = 'recent') AS rk FROM hr GROUP BY 1, 2),
y AS (SELECT topic, count(*) AS hotels, sum(bk) / CAST(sum(bn) AS DOUBLE) AS base_rate, sum(rk) / CAST(sum(rn) AS DOUBLE) AS recent_rate, sum(bn * (rk / CAST(rn AS DOUBLE))) / CAST(sum(bn) AS DOUBLE) AS mix FROM x GROUP BY 1)
SELECT topic, hotels, round(base_rate, 6) AS base_rate, round(recent_rate, 6) AS recent_rate, round(mix, 6) AS recent_rate_base_mix, round(recent_rate - base_rate, 6) AS raw_change, round(mix - base_rate, 6) AS within_hotel_change, round(recent_rate - mix, 6) AS mix_effect FROM y"""


@query(WITHIN)
def within_unit_change(spark: SparkSession, sf_dir: str, least: int = 30) -> DataFrame:
    return rounded(T.within_hotel(_counts(spark, sf_dir, least)))


@query()
def cluster_bootstrap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals at 95 %, flags at the level that holds for all topics together."""
    counts = _counts(spark, sf_dir)
    strict = T.strict_level(counts.select("topic").distinct().count() or 1)
    i = T.change_intervals(counts, [0.95, strict])
    usual, sure = i.where("level = 0.95"), i.where(F.col("level") == strict).select("topic", F.col("low").alias("l"), F.col("high").alias("h"))
    relative = F.try_divide(F.col("change"), F.col("base_rate"))
    return rounded(usual.join(sure, "topic").select("topic", F.col("hotels").cast("long").alias("hotels"), F.col("change").alias("within_hotel_change"), relative.alias("relative_change"), "low", "high", T.flag(F.col("l"), F.col("h"), relative).alias("flag")))


@query(f"""WITH {VIEWS}, top AS (SELECT nationality FROM rq GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
seg AS (SELECT period, 'trip_type' AS dimension, trip_type AS segment FROM rq UNION ALL SELECT period, 'traveller_type', traveller_type FROM rq UNION ALL SELECT period, 'nationality', CASE WHEN nationality IN (SELECT nationality FROM top) THEN nationality ELSE 'Other' END FROM rq),
sh AS (SELECT dimension, segment, period, count(*) / CAST(sum(count(*)) OVER (PARTITION BY dimension, period) AS DOUBLE) AS share FROM seg GROUP BY 1, 2, 3)
SELECT dimension, segment, round(max(share) FILTER (WHERE period = 'base'), 6) AS base_share, round(max(share) FILTER (WHERE period = 'recent'), 6) AS recent_share,
round(coalesce(max(share) FILTER (WHERE period = 'recent'), 0) - coalesce(max(share) FILTER (WHERE period = 'base'), 0), 6) AS change FROM sh GROUP BY 1, 2""")
def segment_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.reviews(spark, sf_dir)
    return rounded(T.segment_mix(r, T.windows_of(A.review_dates(spark, sf_dir)), {"trip_type": None, "traveller_type": None, "nationality": 3}))


@query(f"WITH {VIEWS} SELECT month, count(*) AS reviews, round(avg(CAST(has AS INTEGER)), 6) AS complaint_text_share FROM fr, w WHERE month BETWEEN first_month AND last_month GROUP BY 1")
def complaint_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.complaint_share(A.flagged_reviews(spark, sf_dir), T.windows_of(A.review_dates(spark, sf_dir))))


@query(f"""WITH {VIEWS}, i AS (SELECT * FROM fr, w WHERE month BETWEEN first_month AND last_month)
SELECT '{T.CHECKS[0]}' AS check_name, count(*) - (SELECT count(*) FROM (SELECT DISTINCT review_id, topic FROM cp)) AS value FROM cp
UNION ALL SELECT '{T.CHECKS[1]}', count(*) FROM cp WHERE review_id NOT IN (SELECT review_id FROM rv)
UNION ALL SELECT '{T.CHECKS[2]}', count(*) FROM cp JOIN fr USING (review_id) WHERE NOT has
UNION ALL SELECT '{T.CHECKS[3]}', CAST((SELECT count(*) FROM i) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM i GROUP BY month)) AS BIGINT)
UNION ALL SELECT '{T.CHECKS[4]}', count(DISTINCT month) FROM rv, w WHERE month BETWEEN base_start AND base_end AND month BETWEEN recent_start AND recent_end""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.checks(A.flagged_reviews(spark, sf_dir), A.complaints(spark, sf_dir), T.windows_of(A.review_dates(spark, sf_dir)))


@query(f"WITH {VIEWS}, p(period, a, z) AS (VALUES ('late', '2000-01', '2001-07'), ('all', '1995-01', '2001-08')) SELECT p.period, count(*) AS reviews FROM rv JOIN p ON month BETWEEN a AND z GROUP BY 1")
def range_join_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("late", "2000-01", "2001-07"), ("all", "1995-01", "2001-08")], "period string, start_month string, end_month string")
    return T.range_join_periods(A.reviews(spark, sf_dir), p).groupBy("period").agg(F.count("*").alias("reviews"))


ASPECT = """ev AS (SELECT event_id AS id, user_id % 5 AS hotel_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d%H') AS review_id, ts, event_type AS aspect, CASE WHEN value < 30 THEN 'negative' WHEN value < 60 THEN 'neutral' ELSE 'positive' END AS sentiment FROM events),
one AS (SELECT hotel_id, ts >= TIMESTAMP '2024-01-17' AS now, review_id, aspect, arg_min(sentiment, id) AS sentiment FROM ev WHERE hotel_id = 1 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3, 4),
ta AS (SELECT now, aspect, count(*) AS n, count(*) FILTER (WHERE sentiment = 'positive') AS p, count(*) FILTER (WHERE sentiment = 'negative') AS g, count(*) FILTER (WHERE sentiment = 'neutral') AS u FROM one GROUP BY 1, 2),
sm AS (SELECT a.aspect, a.n, a.p, a.g, a.u, a.g / CAST(a.n AS DOUBLE) AS r, round(a.g / CAST(a.n AS DOUBLE) - b.g / CAST(b.n AS DOUBLE), 4) AS trend, a.n / CAST(max(a.n) OVER () AS DOUBLE) AS v FROM ta a LEFT JOIN ta b ON a.aspect = b.aspect AND NOT b.now WHERE a.now)
SELECT aspect, n AS review_count, p AS positive_count, g AS negative_count, u AS neutral_count, round(r, 4) AS negative_rate, trend, round(0.45 * r + 0.25 * v + 0.20 * least(greatest(coalesce(trend, 0), 0), 1) + 0.10 * 0.5, 4) AS priority_score FROM sm"""


@query(f"WITH {ASPECT}")
def aspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.aspects(spark, sf_dir)
    return AS.summary(AS.in_window(r, 1, AS_OF, 14), AS.in_window(r, 1, AS_OF, 14, 1))


@query(f"WITH {ASPECT} WHERE g > 0")
def aspect_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.recommendations(A.aspects(spark, sf_dir), 1, 14, AS_OF)


@query(ASPECT.split("one AS")[0].join(["WITH ", ""]).rstrip().rstrip(",") + " SELECT id, review_id, aspect FROM ev WHERE hotel_id = 1 AND aspect = 'click' AND sentiment = 'negative' AND ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31' ORDER BY ts DESC, id DESC LIMIT 20")
def aspect_evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.evidence(A.aspects(spark, sf_dir), 1, "click", 14, AS_OF, 20).select("id", "review_id", "aspect")


EV = "WITH " + ASPECT.split("one AS")[0].rstrip().rstrip(",")


@query(EV + ", p AS (SELECT review_id, aspect, sign(count(*) FILTER (WHERE sentiment = 'positive') - count(*) FILTER (WHERE sentiment = 'negative')) AS s FROM ev GROUP BY 1, 2), t AS (SELECT review_id, sum(s) AS s FROM p GROUP BY 1) SELECT review_id, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' END AS overall FROM t")
def aspect_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.review_vote(A.aspects(spark, sf_dir))


@query(EV + """, c AS (SELECT review_id, aspect, sentiment, count(*) AS n, min(id) AS f FROM ev GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS nx, min(f) OVER (PARTITION BY review_id, aspect) AS a, min(CASE WHEN sentiment = 'neutral' THEN f END) OVER (PARTITION BY review_id, aspect) AS nf FROM c WINDOW w AS (PARTITION BY review_id, aspect ORDER BY n DESC, f))
SELECT review_id, aspect, CASE WHEN n = nx THEN 'neutral' ELSE sentiment END AS sentiment, CASE WHEN n = nx THEN coalesce(nf, a) ELSE f END AS quote_id FROM k WHERE k = 1""")
def saved_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.saved_vote(A.aspects(spark, sf_dir))


@query(EV + ", a AS (SELECT CASE WHEN sentiment = 'negative' THEN 'no' WHEN sentiment = 'positive' THEN 'yes' ELSE 'unsure' END AS answer, aspect AS topic FROM ev) SELECT topic, count(*) FILTER (WHERE answer = 'yes') AS yes, count(*) FILTER (WHERE answer = 'no') AS no, count(*) FILTER (WHERE answer = 'unsure') AS unsure FROM a GROUP BY 1")
def triage_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.aspects(spark, sf_dir).withColumn("answer", F.when(F.col("sentiment") == "negative", "no").when(F.col("sentiment") == "positive", "yes").otherwise("unsure"))
    return R.summary(r.withColumnRenamed("aspect", "topic"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, round(value, 6) AS value FROM r WHERE k = 1")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return rounded(ST.latest(log, ["user_id", "event_type"], "event_id"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1 AND NOT value < 20")
def delete_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("value") < 20).alias("gone"))
    return ST.latest(log, ["user_id", "event_type"], "event_id", "gone")


@query("""WITH e AS (SELECT user_id AS ticket_id, event_id AS moved, 1 + event_id % 3 AS s FROM events), r AS (SELECT *, max(s) OVER (PARTITION BY ticket_id ORDER BY moved ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e)
SELECT ticket_id, CASE max(s) WHEN 1 THEN 'assigned' WHEN 2 THEN 'in_progress' ELSE 'resolved' END AS state, CAST(count(*) FILTER (WHERE s < greatest(coalesce(top, 1), 1)) AS INTEGER) AS violations FROM r GROUP BY 1""")
def ticket_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("ticket_id"), F.col("event_id").alias("at"), F.element_at(F.array(*map(F.lit, ST.STATES)), (F.col("event_id") % 3 + 1).cast("int")).alias("state"))
    return ST.ticket_state(e)


@query("SELECT event_id AS id FROM events WHERE event_id % 4 = 0 AND ts <= TIMESTAMP '2024-01-10' ORDER BY 1 LIMIT 100")
def outbox_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "pending").otherwise("sent").alias("state"), F.col("ts").alias("next_attempt_at"))
    return ST.due(o, datetime(2024, 1, 10), 100).select("id")


@query("SELECT event_id, CASE WHEN event_id % 8 < 4 THEN CAST(30 * pow(2, event_id % 8) AS BIGINT) END AS seconds FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", ST.backoff_seconds(F.col("event_id") % 8 + 1).alias("seconds"))


@query("""SELECT o_orderkey AS ticket_id, c_nationkey AS hotel_id, o_orderpriority AS department, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderpriority = '1-URGENT'""")
def ticket_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "F", "urgent").otherwise("normal").alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("department"))
    f = o.select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderkey").alias("review_id"))
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("hotel_id"))
    r = o.select(F.col("o_orderkey").alias("review_id"), "o_custkey").join(c, "o_custkey").drop("o_custkey")
    from pyspark.sql import Window

    q = ST.queue(t, f, r, hotel_id=3, department="1-URGENT")
    place = F.row_number().over(Window.partitionBy("hotel_id").orderBy(F.when(F.col("priority") == "urgent", 0).otherwise(1), "created_at", "ticket_id"))
    return q.select("ticket_id", "hotel_id", "department", place.cast("long").alias("place"))


COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({COLLAPSED}) AS digest, length({COLLAPSED}) AS n FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").withColumn("t", X.clean_text(F.col("text")))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '</?\\s*\\w+\\s*/?>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", F.md5(X.clean_text(F.col("html"))).alias("digest"))


@query(f"SELECT doc_id, sha256({COLLAPSED}) AS text_sha256 FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_sha256"))


#: Case folding of the texts at hand: lower case, and sharp s as two letters.
CANON = f"replace(lower({COLLAPSED}), 'ß', 'ss')"


@query(f"SELECT doc_id, CAST(('0x' || substr(sha256({CANON}), 1, 8))::BIGINT % 100 AS INTEGER) AS pool FROM documents")
def hash_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.pool_of(X.canonical_text(F.col("text"))).alias("pool"))


@query(f"SELECT min(doc_id) AS doc_id, sha256({CANON}) AS review_id FROM documents GROUP BY 2")
def canonical_dedup_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", X.review_id(F.col("text")).alias("review_id"))
    return D.keep_earliest(d, "review_id", "doc_id").select("doc_id", "review_id")


@query(f"WITH k AS (SELECT doc_id, {CANON} AS k, toxic FROM documents JOIN labels USING (doc_id)), c AS (SELECT k FROM k GROUP BY 1 HAVING min(toxic) <> max(toxic)) SELECT doc_id FROM k WHERE k NOT IN (SELECT k FROM c)")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id").withColumn("k", X.canonical_text(F.col("text")))
    return D.drop_conflicts(d, "k", "toxic").select("doc_id")


RULE = "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN text WHEN n_chars % 5 = 0 THEN '' ELSE 'No Positive' END AS p, CASE WHEN n_chars % 4 = 0 THEN text WHEN n_chars % 7 = 0 THEN '' ELSE 'No Negative' END AS n FROM documents"


@query(f"WITH r AS ({RULE}), t AS (SELECT doc_id, trim(p) AS p, trim(n) AS n FROM r) SELECT doc_id, CASE WHEN n = 'No Negative' THEN 1 ELSE 0 END AS label FROM t WHERE (p NOT IN ('', 'No Positive') AND n = 'No Negative') OR (p = 'No Positive' AND n NOT IN ('', 'No Negative'))")
def label_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    p = F.when(F.col("n_chars") % 3 == 0, F.col("text")).when(F.col("n_chars") % 5 == 0, "").otherwise("No Positive")
    n = F.when(F.col("n_chars") % 4 == 0, F.col("text")).when(F.col("n_chars") % 7 == 0, "").otherwise("No Negative")
    return d.select("doc_id", X.label_rule(p, n).alias("label")).where("label is not null")


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{Greek}')) AS greek, len(regexp_extract_all(text, '\\p{Latin}')) AS latin, len(regexp_extract_all(text, '\\p{L}')) AS letters FROM documents")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return A.table(spark, sf_dir, "documents").select("doc_id", n(r"\p{IsGreek}").alias("greek"), n(r"\p{IsLatin}").alias("latin"), n(r"\p{L}").alias("letters"))


def _h(seed: str, c: str) -> str:
    return f"sha256('{seed}|' || CAST({c} AS VARCHAR))"


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_h('7', 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels),
t AS (SELECT *, greatest(1, least(CAST(floor(n * 0.1) AS BIGINT), n - 2)) AS t FROM r), d AS (SELECT *, greatest(1, CAST(floor((n - t) * 0.1) AS BIGINT)) AS d FROM t)
SELECT doc_id, CASE WHEN k <= t THEN 'test' WHEN k <= t + d THEN 'dev' ELSE 'train' END AS split FROM d""")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stratified_split(A.table(spark, sf_dir, "labels"), "doc_id", "quality", test=0.1, dev=0.1, seed="7").select("doc_id", "split")


@query("""WITH n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT day, sum(n) OVER (ORDER BY day) AS u, sum(n) OVER () AS t FROM n),
c AS (SELECT min(day) FILTER (WHERE u > floor(t * 0.8)) AS c1, min(day) FILTER (WHERE u > floor(t * 0.9)) AS c2 FROM u)
SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < c1 THEN 'train' WHEN CAST(o_orderdate AS DATE) < c2 THEN 'dev' ELSE 'test' END AS split FROM orders, c""")
def split_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return D.time_split(o, "day", train=0.8, dev=0.1).select("o_orderkey", "split")


@query(f"""WITH g AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT g, n, sum(n) OVER (ORDER BY {_h('0', 'g')}, g) - n AS b, sum(n) OVER () AS t FROM g),
s AS (SELECT *, sum(CASE WHEN b < t * 0.2 THEN n ELSE 0 END) OVER () AS ts FROM b), x AS (SELECT g, CASE WHEN b < t * 0.2 THEN 'test' WHEN b - ts < t * 0.2 THEN 'dev' ELSE 'train' END AS split FROM s)
SELECT o_orderkey, split FROM orders JOIN x ON o_custkey = g""")
def split_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.group_split(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", test=0.2, dev=0.2).select("o_orderkey", "split")


@query(f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h('0', 'doc_id')}, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r WHERE k <= 50")
def cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cap_per_class(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 50)


@query(f"WITH s AS (SELECT {CANON} AS k, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'test' END AS split FROM documents), p AS (SELECT DISTINCT a.split AS split_a, b.split AS split_b, a.k FROM s a JOIN s b ON a.k = b.k AND a.split < b.split) SELECT split_a, split_b, count(*) AS shared FROM p GROUP BY 1, 2")
def cross_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 10
    d = A.table(spark, sf_dir, "documents").select(X.canonical_text(F.col("text")).alias("k"), F.when(m < 7, "train").when(m < 9, "dev").otherwise("test").alias("split"))
    return D.cross_split_overlap(d, "k")


@query(f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_h('3', 'doc_id')}, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, round(n / CAST(least(n, 30) AS DOUBLE), 6) AS weight FROM r WHERE k <= 30")
def stratified_sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.stratified_sample(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 30, "3"))


@query(f"""WITH r AS (SELECT doc_id FROM documents ORDER BY {_h('5R', 'doc_id')} LIMIT 100), m AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_h('5M', 'doc_id')}, doc_id) AS k FROM documents WHERE n_chars > 1000 AND doc_id NOT IN (SELECT doc_id FROM r))
SELECT doc_id, 'R' AS drawn_for FROM r UNION ALL SELECT doc_id, source FROM m WHERE k <= 3""")
def two_stage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return D.two_stage_sample(d, d.where("n_chars > 1000"), "doc_id", "source", uniform=100, each=3, seed="5")


PR = "WITH p AS (SELECT d.doc_id AS id, source AS cluster, lang AS stratum, quality AS truth, CAST(n_chars >= 600 AS INTEGER) AS a, CAST(n_chars % 7 > 0 AS INTEGER) AS b, toxic, (n_chars % 97) / 97.0::DOUBLE AS p FROM documents d JOIN labels l USING (doc_id))"
Q = lambda a, b: f"coalesce({a} / CAST(nullif({b}, 0) AS DOUBLE), 0)"


@query(PR + f", l AS (SELECT DISTINCT truth AS label FROM p UNION SELECT DISTINCT a FROM p), c AS (SELECT label, count(*) FILTER (WHERE truth = label) AS support, count(*) FILTER (WHERE a = label) AS said, count(*) FILTER (WHERE a = label AND truth = label) AS hit FROM l, p GROUP BY 1) SELECT label, support, round({Q('hit', 'said')}, 6) AS precision, round({Q('hit', 'support')}, 6) AS recall, round({Q('2 * hit', 'said + support')}, 6) AS f1 FROM c")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.class_metrics(A.predictions(spark, sf_dir), "truth", "a"))


@query(PR + " SELECT count(*) FILTER (WHERE a = truth AND b <> truth) AS only_a, count(*) FILTER (WHERE a <> truth AND b = truth) AS only_b FROM p")
def pairwise_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.discordance(A.predictions(spark, sf_dir), "truth", "a", "b")


@query(PR + ", d AS (SELECT count(*) FILTER (WHERE a = truth AND b <> truth) AS x, count(*) FILTER (WHERE a <> truth AND b = truth) AS y FROM p), t AS (SELECT x, y, unnest(range(0, least(x, y) + 1)) AS k FROM d) SELECT x AS only_a, y AS only_b, round(least(1, 2 * sum(exp(lgamma(x + y + 1) - lgamma(k + 1) - lgamma(x + y - k + 1) - (x + y) * ln(2)))), 6) AS p FROM t GROUP BY 1, 2")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairwise_discordance(spark, sf_dir).first()
    return spark.createDataFrame([(r["only_a"], r["only_b"], round(S.mcnemar(r["only_a"], r["only_b"]), 6))], "only_a long, only_b long, p double")


@query()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of both predictors: row, paired and cluster intervals from counts."""
    import numpy as np

    c = A.predictions(spark, sf_dir).groupBy("cluster", "truth", "a", "b").count().collect()
    clusters = {k: i for i, k in enumerate(sorted({r["cluster"] for r in c}))}
    t = np.zeros((len(clusters), 2, 2, 2), np.int64)
    for r in c:
        t[clusters[r["cluster"]], r["truth"], r["a"], r["b"]] += r["count"]
    j = t.sum(0)
    rows = [("row a", *S.row_bootstrap(j.sum(2))), ("paired b - a", *S.paired_bootstrap(j)), ("cluster a", *S.cluster_bootstrap(t.sum(3))[1:])]
    return rounded(spark.createDataFrame(rows, "statistic string, low double, high double"))


W = "(k / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n)"
WH = "1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n)"


@query(PR + f", c AS (SELECT stratum, CAST(sum(truth) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, sum(toxic) AS k2 FROM p GROUP BY 1), i AS (SELECT stratum, k, n, k2, {W} - {WH} AS l1, {W} + {WH} AS u1, {W.replace('k', 'k2')} - {WH.replace('k', 'k2')} AS l2, {W.replace('k', 'k2')} + {WH.replace('k', 'k2')} AS u2 FROM c) SELECT stratum, round(l1, 6) AS low, round(u1, 6) AS high, round((k2 - k) / n - sqrt(pow(k2 / n - l2, 2) + pow(u1 - k / n, 2)), 6) AS diff_low, round((k2 - k) / n + sqrt(pow(u2 - k2 / n, 2) + pow(k / n - l1, 2)), 6) AS diff_high FROM i")
def wilson_newcombe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.predictions(spark, sf_dir).groupBy("stratum").agg(F.sum("truth").cast("double").alias("k"), F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("k2"))
    k, n, k2 = F.col("k"), F.col("n"), F.col("k2")
    (lo, hi), (a, b) = S.wilson(k, n), S.newcombe(k, n, k2, n)
    return rounded(c.select("stratum", lo.alias("low"), hi.alias("high"), a.alias("diff_low"), b.alias("diff_high")))


@query(PR + ", c AS (SELECT stratum, CAST(sum(a) AS DOUBLE) AS k1, CAST(sum(b) AS DOUBLE) AS k2, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1), r AS (SELECT stratum, k2 / k1 AS r, sqrt(1 / k2 - 1 / n + 1 / k1 - 1 / n) AS s FROM c) SELECT stratum, round(r, 6) AS ratio, round(r * exp(-1.959963984540054 * s), 6) AS low, round(r * exp(1.959963984540054 * s), 6) AS high FROM r")
def katz_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.predictions(spark, sf_dir).groupBy("stratum").agg(F.sum("a").alias("k1"), F.sum("b").alias("k2"), F.count("*").cast("double").alias("n"))
    r, lo, hi = S.katz(F.col("k1"), F.col("n"), F.col("k2"), F.col("n"))
    return rounded(c.select("stratum", r.alias("ratio"), lo.alias("low"), hi.alias("high")))


@query(PR + ", t AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE a = b) / CAST(count(*) AS DOUBLE) AS agreement, (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b))) AS expected FROM p) SELECT CAST(n AS BIGINT) AS n, round(agreement, 6) AS agreement, round(expected, 6) AS expected, round((agreement - expected) / nullif(1 - expected, 0), 6) AS kappa FROM t")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.cohen_kappa(A.predictions(spark, sf_dir), "a", "b"))


@query(PR + ", r AS (SELECT id, a AS v FROM p UNION ALL SELECT id, b FROM p UNION ALL SELECT id, toxic FROM p), i AS (SELECT id, count(*) AS m, sum(v) AS y FROM r GROUP BY 1), g AS (SELECT avg((y * y + (m - y) * (m - y) - m) / CAST(m * (m - 1) AS DOUBLE)) AS ag FROM i), e AS (SELECT avg(v) * avg(v) + (1 - avg(v)) * (1 - avg(v)) AS ex FROM r) SELECT round((ag - ex) / nullif(1 - ex, 0), 6) AS kappa FROM g, e")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.predictions(spark, sf_dir).unpivot(["id"], ["a", "b", "toxic"], "rater", "v")
    return rounded(M.fleiss_kappa(r, "id", "v")).select("kappa")


@query(PR + " SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(truth), 6) AS accuracy FROM p GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.calibration_bins(A.predictions(spark, sf_dir), F.col("p"), F.col("truth")))


@query(PR + ", q AS (SELECT truth, p, least(greatest(p, 1e-12), 1 - 1e-12) AS q FROM p) SELECT round(avg(pow(p - truth, 2)), 6) AS brier, round(avg(CASE WHEN truth = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss FROM q")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.brier_logloss(A.predictions(spark, sf_dir), F.col("p"), F.col("truth")))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query(PR + f", g AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND truth = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND truth = 0) AS fp, count(*) FILTER (WHERE p < threshold AND truth = 1) AS fn FROM g, p GROUP BY 1) SELECT threshold, tp, fp, fn, round({Q('tp', 'tp + fp')}, 6) AS precision, round({Q('tp', 'tp + fn')}, 6) AS recall, round({Q('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.threshold_grid(A.predictions(spark, sf_dir), "p", "truth", GRID))


@query(PR + ", x AS (SELECT *, 1.0 + id % 3 AS w FROM p) SELECT round(sum(CASE WHEN toxic = 1 AND a = 1 THEN w ELSE 0 END) / sum(CASE WHEN toxic = 1 THEN w ELSE 0 END)::DOUBLE, 6) AS recall, round(100 * sum(CASE WHEN toxic = 0 AND a = 1 THEN w ELSE 0 END) / sum(w)::DOUBLE, 6) AS false_per_100 FROM x")
def ipw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.predictions(spark, sf_dir).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    return rounded(M.ipw_recall(p, "w", F.col("toxic") == 1, F.col("a") == 1))


@query(PR + ", x AS (SELECT *, 1.0 + id % 3 AS w FROM p) SELECT stratum, count(*) FILTER (WHERE truth = 1) AS support, round(sum(CASE WHEN truth = 1 AND a = 1 THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN a = 1 THEN w ELSE 0 END), 0), 6) AS precision, round(sum(CASE WHEN truth = 1 AND a = 1 THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN truth = 1 THEN w ELSE 0 END), 0), 6) AS recall, CASE WHEN count(*) FILTER (WHERE truth = 1) < 10 THEN 'few' ELSE 'ok' END AS status FROM x GROUP BY 1")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.predictions(spark, sf_dir).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    return rounded(M.multilabel(p, "stratum", "truth", "a", "w"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0")
def json_entry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k >= 0")


TEXTS = ["The shower was really cold and the towels were damp.", "We saw some ants in the dirty bathroom", "Staff ignored our repeated requests", "The heater was not broken", "Lovely stay, the ac is too noisy", "The toilet was blocked. They fixed it."]


@query("WITH t AS (SELECT event_id AS id, [" + ", ".join(f"'{t}'" for t in TEXTS) + f"][1 + event_id % 6] || ' ' || props AS text FROM events), g AS (SELECT id, text, NOT regexp_matches(text, '(?i){R.GUARD.replace(chr(39), chr(39) * 2)}') AS open FROM t) SELECT id, " + ", ".join("CASE WHEN open AND (" + " OR ".join(f"regexp_matches(text, '(?i){p}')" for t, _, p in R.RULES if t == topic) + f") THEN 'yes' ELSE 'unsure' END AS {topic}" for topic in R.TOPICS) + " FROM g")
def small_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("event_id") % 6 + 1).cast("int"))
    t = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", said, "props").alias("text"))
    return R.lexicon_v1(t).select("id", *R.TOPICS)


@query("""WITH c AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'negative' ELSE 'positive' END AS label, least(value / 40, 1) AS conf, ['error', 'disabled', 'ok', 'ok', 'ok'][1 + event_id % 5] AS status, ['yes', 'no', 'unsure', 'no'][1 + event_id % 4] AS answer, (event_id % 100) / 100.0 AS p FROM events),
d AS (SELECT *, status = 'ok' AND coalesce(answer = 'unsure' OR (answer = 'no' AND p >= 0.2 AND p < 0.5) OR (answer = 'yes' AND p < 0.5), false) AS doubt FROM c)
SELECT id, concat_ws(',', CASE WHEN label LIKE 'neg%' THEN 'negative_sentiment' END, CASE WHEN conf < 0.8 THEN 'uncertain_sentiment' END, CASE WHEN status = 'ok' AND answer = 'yes' THEN 'complaint_detected' END, CASE WHEN doubt THEN 'uncertain_complaint' END) AS reasons,
concat_ws(',', CASE WHEN conf < 0.8 THEN 'uncertain_sentiment' END, CASE WHEN doubt THEN 'uncertain_complaint' END, CASE WHEN status = 'error' THEN 'complaint_check_failed' END) AS review_reasons FROM d""")
def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    answer = F.struct(F.lit("bathroom").alias("topic"), pick(["yes", "no", "unsure", "no"], 4).alias("answer"), (i % 100 / 100.0).alias("probability"))
    e = A.table(spark, sf_dir, "events").select(i.alias("id"), F.when(i % 3 == 0, "negative").otherwise("positive").alias("label"), F.least(F.col("value") / 40, F.lit(1.0)).alias("confidence"), pick(["error", "disabled", "ok", "ok", "ok"], 5).alias("status"), F.array(answer).alias("answers"))
    return R.routing(e).select("id", F.array_join("reasons", ",").alias("reasons"), F.array_join("review_reasons", ",").alias("review_reasons"))


REVIEWS = ["The room was spotless and the staff were kind. Breakfast was cold but the coffee was good.", "No hot water in the shower; the bed was too small. We told the staff. Nobody came.", "Noisy street. Horrible.", "Great location, near the metro, although the lift was broken…"]


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document whole, after a review's sentences."""
    said = F.element_at(F.array(*map(F.lit, REVIEWS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", said, "text").alias("text"))


@query()
def clause_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import lexicon as L

    return L.mentions(_reviews(spark, sf_dir)).select("doc_id", F.explode("mentions").alias("m")).select("doc_id", "m.position", "m.topic", "m.clause")


@query()
def complaint_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents with the built-in lexicon."""
    from plumbline.operators import lexicon as L

    return L.tag_complaints(A.table(spark, sf_dir, "documents"), "doc_id", "text")


def _stub_scorer():
    """A scorer without a model: cold, small, noisy and broken things are complaints."""
    return lambda pairs: [("negative" if any(w in c.lower() for w in ("cold", "small", "noisy", "broken")) else "positive", 0.9) for c, _ in pairs]


@query()
def review_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators import lexicon as L

    found = L.group_mentions(L.analysed(_reviews(spark, sf_dir), "doc_id", "text", _stub_scorer))
    return found.select("review_id", "topic", "sentiment", F.array_join("quotes", "|").alias("quotes"), F.array_join("flags", ",").alias("flags"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming import events as E

    out = E.landed(E.windowed(E.source(spark, sf_dir, "events"), "ts", ["event_type"], "1 day", value="value"), ["window_start", "event_type"])
    return out.withColumn("total", F.round("total", 4))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM b GROUP BY user_id, s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming import events as E

    return E.sessions(A.table(spark, sf_dir, "events"), "ts", ["user_id"], "2 hours")


@query()
def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents, over every document; scores of labelled ones are those of rows of the fit."""
    from plumbline.operators import models as ML

    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ML.fit(docs.join(A.table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("quality").cast("double").alias("label")))
    return ML.score(docs, model, "doc_id")
