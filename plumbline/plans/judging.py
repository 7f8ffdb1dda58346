"""Registered queries of checks, generated answers and judgements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import adapters as A
from plumbline.functions import text as X
from plumbline.operators import checks as C
from plumbline.operators import generated as N
from plumbline.operators import judging as J
from plumbline.operators import state as ST
from plumbline.plans.queries import query, rounded

D = A.table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")


OPENINGS = ["", "Nothing ", "None. ", "n/a ", "No complaints! ", "** all good ", "Everything was perfect ", "not much, ", "Nil "]
ENDINGS = ["", "but the bed was hard", "however"]
OPENING = "[" + ", ".join(f"'{o}'" for o in OPENINGS) + "][1 + doc_id % 9]"
ENDING = "[" + ", ".join(f"'{e}'" for e in ENDINGS) + "][1 + (doc_id // 9) % 3]"


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'No Negative' WHEN doc_id % 9 = 0 THEN text ELSE {OPENING} || {ENDING} END AS t FROM documents)
SELECT doc_id, trim(t) <> '' AND lower(trim(t)) <> 'no negative' AND (NOT regexp_matches(trim(t), '(?i)^[^a-z0-9_]*(nothing|none|n[ /]?a\\b|nil\\b|no complaints?|not much|all (was )?(good|great|perfect|fine)|everything (was )?(perfect|great|fine|good|excellent|wonderful|amazing|fantastic))\\b') OR regexp_matches(t, '(?i)\\b(but|except|however)\\b')) AS complains FROM f""".replace("n[ /]?a", "n ?a"))
def complaint_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms' own openings, and whole documents as fields."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    i = F.col("doc_id")
    said = F.concat(pick(OPENINGS, i % 9), pick(ENDINGS, F.floor(i / 9) % 3))
    field = F.when(i % 11 == 0, "No Negative").when(i % 9 == 0, F.col("text")).otherwise(said)
    return docs(spark, sf_dir).select("doc_id", X.has_complaint(field).alias("complains"))


@query("SELECT doc_id, substr(sha256('salt|' || trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 24) AS key FROM documents")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.text_key("salt", F.col("text")).alias("key"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def us_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("d"))
    return o.select("o_orderkey", X.us_date(F.col("d")).alias("day"))


@query("SELECT doc_id, CASE WHEN g > 0 AND g >= l AND g >= o THEN 'greek' WHEN g + l + o = 0 THEN 'other' WHEN l >= o THEN 'latin' ELSE 'other' END AS script FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{Greek}')) AS g, len(regexp_extract_all(text, '\\p{Latin}')) AS l, len(regexp_extract_all(text, '\\p{L}')) - len(regexp_extract_all(text, '\\p{Greek}')) - len(regexp_extract_all(text, '\\p{Latin}')) AS o FROM documents)")
def review_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.script_of(F.col("text")).alias("script"))


RAW = ["Clean", "front-desk", " staff ", "WiFi", "wi fi", "Food_", "price", "room", "Hygiene", "", "parking", "-bar-"]
ALIASES = ", ".join(f"('{a}', '{k}')" for k, v in N.ASPECTS.items() for a in v)


@query(f"WITH a(alias, aspect) AS (VALUES {ALIASES}), r AS (SELECT event_id, [{', '.join(repr(x) for x in RAW)}][1 + event_id % 12] AS raw FROM events) SELECT event_id, aspect FROM r LEFT JOIN a ON alias = trim(replace(replace(lower(trim(raw)), '-', ' '), '_', ' '))")
def aspect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("event_id") % 12 + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", N.aspect(raw).alias("aspect"))


ANSWERS = {
    0: ('{"actions": [{"a": 1}]}', "ok", True), 1: ('Sure: [{"a": 1}, {"b": 2}] done', "ok", False), 2: ('{"actions": [], "actions": [1]}', "repeated_key", False), 3: ("no json {here", "none", False),
    4: ('{"other": []} then {"actions": []}', "ok", False), 5: ('{"actions": NaN}', "none", False), 6: ('[1, 2] {"actions": {}}', "none", False),
}


@query("SELECT event_id, " + "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{o}'" for k, (_, o, _) in ANSWERS.items()) + " END AS outcome, event_id % 7 = 0 AS whole FROM events")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.element_at(F.array(*(F.lit(a) for a, _, _ in ANSWERS.values())), (F.col("event_id") % 7 + 1).cast("int"))
    return N.salvaged(events(spark, sf_dir).select("event_id", answer.alias("answer")), "answer").select("event_id", "outcome", "whole")


@query("""WITH d AS (SELECT doc_id, text, doc_id % 3 AS k FROM documents)
SELECT doc_id, 3 AS n_entries, CASE WHEN k = 1 THEN 1 ELSE 0 END AS n_unknown, CASE WHEN k = 2 THEN 1 ELSE 0 END AS n_ungrounded, CASE WHEN k = 0 THEN 1 ELSE 0 END AS n_repeated, 2 AS kept FROM d WHERE trim(substr(text, 1, 12)) <> '' AND length(trim(substr(text, 14, 10))) > 0""")
def aspect_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with quotes from the documents, a third with one that repeats, names no aspect or quotes what isn't there."""
    k, d = F.col("doc_id") % 3, docs(spark, sf_dir).where("trim(substr(text, 1, 12)) <> '' and length(trim(substr(text, 14, 10))) > 0")
    entry = lambda a, s, q: F.struct(a.alias("aspect"), F.lit(s).alias("sentiment"), q.alias("quote"))
    quote = F.substring("text", 1, 12)
    third = entry(F.when(k == 1, "nonsense").otherwise("Clean"), "negative", F.when(k == 2, "§ not there §").otherwise(quote))
    answer = F.concat(F.lit("Here: "), F.to_json(F.array(entry(F.lit("clean"), "Negative", quote), entry(F.lit("staff"), "positive", F.substring("text", 14, 10)), third)))
    r = N.aspect_entries(d.select("doc_id", "text", answer.alias("answer")), "answer", "text")
    return r.select("doc_id", "n_entries", "n_unknown", "n_ungrounded", "n_repeated", F.size("entries").alias("kept"))


EVIDENCE = """WITH d AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 9 AS c FROM documents WHERE length(trim(substr(text, 1, 20))) >= 3)
SELECT doc_id, CASE k WHEN 0 THEN 'REAL_PENDING' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'UNCERTAIN' ELSE 'REAL_RESOLVED' END AS status, CASE k WHEN 1 THEN 'resolved_evidence,' WHEN 2 THEN 'praise_evidence,' ELSE '' END || CASE WHEN k IN (1, 2) THEN 'uncertain_issue' ELSE '' END AS reasons,
['maintenance', 'housekeeping', 'housekeeping', 'housekeeping', 'food_and_beverage', 'reception', 'management', 'management', 'other'][1 + c] AS department FROM d"""


@query(EVIDENCE)
def issue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where("length(trim(substr(text, 1, 20))) >= 3")
    k, quote, none = F.col("doc_id") % 4, F.substring("text", 1, 20), F.lit(None).cast("string")
    status = F.when(k == 0, "REAL_PENDING").when(k == 2, "POSITIVE_COMMENT").otherwise("REAL_RESOLVED")
    evidence = F.struct(quote.alias("reported"), none.alias("hypothetical"), F.when(k == 3, quote).alias("resolved"))
    category = F.element_at(F.array(*map(F.lit, N.DEPARTMENT_OF)), (F.col("doc_id") % 9 + 1).cast("int"))
    issue = F.struct(F.lit("something broken").alias("problem"), quote.alias("excerpt"), evidence.alias("evidence"), status.alias("status"), category.alias("category"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(issue).alias("issues")), {"ignoreNullFields": "false"}), F.lit("\n```"))
    r = N.issues(d.select("doc_id", "text", answer.alias("answer")), "answer", "text")
    reasons = F.array_join(F.filter(F.col("issues")[0]["review_reasons"], lambda x: x != "department_needs_confirmation"), ",")
    return r.select("doc_id", F.col("issues")[0]["status"].alias("status"), reasons.alias("reasons"), F.col("issues")[0]["department"].alias("department"))


TYPES = ["click", "purchase", "view"]


@query("SELECT user_id AS item, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{t}' AND value < 2 THEN 1 ELSE 0 END) AS INTEGER) AS \"{t}\"" for t in TYPES) + f", CAST(count(*) FILTER (WHERE value < 30) > 0 AND count(*) FILTER (WHERE value < 2 AND event_type IN ({', '.join(repr(t) for t in TYPES)})) = 0 AS INTEGER) AS none, CAST(count(*) FILTER (WHERE value < 30) = 0 AS INTEGER) AS failed FROM events GROUP BY 1")
def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("item"), "event_type", "value")
    said = e.where("value < 30").select("item", F.when(F.col("value") < 2, F.col("event_type")).alias("type"))
    return N.label_matrix(said, e.select("item").distinct(), "item", TYPES)


@query("""WITH c AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS reported, event_id % 700 AS a, event_id % 90 AS b FROM events)
SELECT event_id, round(coalesce(reported, (a * 3.0 + b * 15.0) / 1000000), 9) AS cost_usd, CASE WHEN reported IS NULL THEN 'estimated' ELSE 'reported' END AS cost_source FROM c""")
def answer_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = events(spark, sf_dir).select("event_id", F.when(i % 3 == 0, F.col("value")).alias("reported"), (i % 700).alias("a"), (i % 90).alias("b"))
    return N.cost(e, "reported", "a", "b", 3.0, 15.0).select("event_id", F.round("cost_usd", 9).alias("cost_usd"), "cost_source")


@query("SELECT count(*) AS attempts, count(*) FILTER (WHERE event_id % 3 = 0) AS with_cost, round(sum(value) FILTER (WHERE event_id % 3 = 0), 4) AS cost_sum, false AS complete FROM events")
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("c"))
    return N.cost_summary(e, "c").withColumn("cost_sum", F.round("cost_sum", 4))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE value < 10) AS valid, round(count(*) FILTER (WHERE value < 10) / count(*), 4) AS valid_rate, count(*) FILTER (WHERE event_id % 7 = 0) AS salvaged, round(count(*) FILTER (WHERE event_id % 7 = 0) / count(*), 4) AS salvaged_rate FROM events")
def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select((F.col("value") < 10).alias("valid"), (F.col("event_id") % 7 == 0).alias("salvaged"))
    return N.run_summary(e, "valid", "salvaged")


SAID = [" positive", "Negative.", "it is positive<|end|>", "none, negativeish", "unpositive thing", "?"]


@query(f"SELECT event_id, ['positive', 'negative', 'positive', 'negative', 'positive', 'negative'][1 + event_id % {len(SAID)}] AS label FROM events")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("event_id") % len(SAID) + 1).cast("int"))
    return events(spark, sf_dir).select("event_id", N.label_of(said).alias("label"))


def _first_sentence(p: str) -> str:
    return f"list_filter(s, lambda x: regexp_matches(x, '(?i){p}'))[1]"


@query("WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'The lock was broken. The wifi was fixed! Wi-Fi never worked; ' WHEN 1 THEN 'Dirty towels until we left. ' ELSE '' END || text, '([.!;?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, " + _first_sentence("wi-?fi") + " AS wifi, " + _first_sentence("dirty|stain[a-z0-9_]*|filthy|mou?ld[a-z0-9_]*") + " AS dirt FROM d")
def keyword_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    d = docs(spark, sf_dir).select("doc_id", F.concat(F.when(k == 0, "The lock was broken. The wifi was fixed! Wi-Fi never worked; ").when(k == 1, "Dirty towels until we left. ").otherwise(""), "text").alias("text"))
    one = lambda kind: F.filter("findings", lambda x: x["kind"] == kind)
    first = lambda kind: F.try_element_at(one(kind), F.lit(1))["excerpt"]
    return N.keyword_findings(d).select("doc_id", first("wifi").alias("wifi"), first("cleanliness").alias("dirt"))


@query("WITH u AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value < 20) AS a, list(DISTINCT event_type) FILTER (WHERE value BETWEEN 10 AND 30) AS b FROM events GROUP BY 1), x AS (SELECT user_id, list_sort(list_filter(coalesce(a, []), lambda t: t IN ('click', 'purchase'))) AS a, list_sort(list_filter(coalesce(b, []), lambda t: t IN ('click', 'purchase'))) AS b FROM u) SELECT user_id, CASE WHEN a <> b THEN 'D' WHEN len(a) > 0 THEN 'C' ELSE 'Z' END AS output_group FROM x")
def output_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set(F.when(F.col("value") < 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value").between(10, 30), F.col("event_type"))).alias("b"))
    return u.select("user_id", J.output_groups(F.col("a"), F.col("b"), ["purchase", "click"]).alias("output_group"))


MEN = """m AS (SELECT user_id AS review_id, event_type || '.' || (event_id % 3) AS topic, CASE WHEN value < 40 THEN 'negative' ELSE 'positive' END AS sentiment, event_id, value FROM events),
rep AS (SELECT DISTINCT review_id, topic, sentiment FROM m WHERE event_id % 2 = 0), lab AS (SELECT DISTINCT review_id, topic, sentiment FROM m WHERE event_id % 3 = 0)"""


def mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("review_id"), F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string")).alias("topic"), F.when(F.col("value") < 40, "negative").otherwise("positive").alias("sentiment"), "event_id", "value", "event_type")


@query(f"""WITH {MEN}, x AS (SELECT 'topic' AS level, review_id, topic AS name, sentiment, 'r' AS s FROM rep UNION SELECT 'topic', review_id, topic, sentiment, 'l' FROM lab UNION SELECT 'category', review_id, split_part(topic, '.', 1), sentiment, 'r' FROM rep UNION SELECT 'category', review_id, split_part(topic, '.', 1), sentiment, 'l' FROM lab),
p AS (SELECT level, review_id, name, sentiment, max(CASE WHEN s = 'r' THEN 1 ELSE 0 END) AS r, max(CASE WHEN s = 'l' THEN 1 ELSE 0 END) AS l FROM x GROUP BY ALL), q AS (SELECT *, 'all' AS side FROM p UNION ALL SELECT *, CASE WHEN sentiment = 'negative' THEN 'complaints' ELSE 'praise' END FROM p)
SELECT level, side, CAST(sum(r * l) AS BIGINT) AS "right", CAST(sum(r) AS BIGINT) AS reported, CAST(sum(l) AS BIGINT) AS labelled FROM q GROUP BY 1, 2""")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentioned(spark, sf_dir)
    return rounded(J.topic_scores(m.where("event_id % 2 = 0"), m.where("event_id % 3 = 0")))


@query(f"""WITH {MEN}, u AS (SELECT review_id, split_part(topic, '.', 1) AS a, max(event_id % 2 = 0) AS real, max(value / 100.0) AS c FROM m WHERE sentiment = 'negative' GROUP BY 1, 2)
SELECT CASE WHEN c < 0.1 THEN '<0.10' WHEN c < 0.3 THEN '<0.30' WHEN c < 1.01 THEN '<1.01' END AS band, count(*) AS reported, count(*) FILTER (WHERE real) AS real FROM u GROUP BY 1""")
def field_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentioned(spark, sf_dir).select("review_id", F.when(F.col("event_id") % 2 == 0, "neg").otherwise("pos").alias("field"), F.col("event_type").alias("aspect"), "sentiment", (F.col("value") / 100.0).alias("confidence"))
    return J.field_truth(m, (0.1, 0.3, 1.01))


@query(f"WITH {MEN}, p AS (SELECT review_id, topic, max(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS c, max(CASE WHEN sentiment <> 'negative' THEN 1 ELSE 0 END) AS p FROM m GROUP BY 1, 2) SELECT topic, CAST(sum(c) AS BIGINT) AS complaining, CAST(sum(p) AS BIGINT) AS praising, CAST(sum(c * p) AS BIGINT) AS mixed FROM p GROUP BY 1")
def topic_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.topic_summary(mentioned(spark, sf_dir)))


@query("WITH o AS (SELECT lang, source, doc_id, text, row_number() OVER (PARTITION BY lang, source ORDER BY length(text), text, doc_id) AS k FROM documents), f AS (SELECT * FROM o WHERE k = 1) SELECT lang, source, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(text), source) AS r FROM f) WHERE r <= 2")
def shortest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.shortest_examples(docs(spark, sf_dir), ["lang"], "source", "text")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(value, 6) AS value FROM r WHERE k = greatest(1, CAST(ceil(0.95 * n) AS BIGINT))")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.nearest_rank(events(spark, sf_dir), ["event_type"], "value", 0.95))


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows, round(avg(n), 6) AS mean_size, median(n) AS median_size FROM n")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.cluster_sizes(events(spark, sf_dir), "user_id"))


MODELS = {"a": "CAST(n_chars >= 600 AS INTEGER)", "b": "CAST(n_chars % 7 > 0 AS INTEGER)", "c": "1"}
LONG = "j AS (SELECT doc_id, quality AS label, n_chars FROM documents JOIN labels USING (doc_id)), p AS (" + " UNION ALL ".join(f"SELECT doc_id, label, '{m}' AS model, {e} AS predicted FROM j" for m, e in MODELS.items()) + ")"


def answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three models' answers on the labelled documents, a fourth that leaves some out; and the labels."""
    j = docs(spark, sf_dir).join(D(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    each = F.array(*(F.struct(F.lit(m).alias("model"), e.cast("int").alias("predicted")) for m, e in (("a", F.col("n_chars") >= 600), ("b", F.col("n_chars") % 7 > 0), ("c", F.lit(1)), ("d", F.when(F.col("doc_id") % 50 > 0, 1)))))
    p = j.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").where("predicted is not null")
    return p, j.select("doc_id", "label")


@query(f"WITH {LONG}, k AS (SELECT model, label AS l, count(*) FILTER (WHERE predicted = label) AS h, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT model, predicted AS l, count(*) AS m FROM p GROUP BY 1, 2), f AS (SELECT coalesce(k.model, s.model) AS model, 2.0 * coalesce(h, 0) / (coalesce(n, 0) + coalesce(m, 0)) AS f1 FROM k FULL JOIN s ON k.model = s.model AND k.l = s.l) SELECT model, n, accuracy, macro_f1 FROM (SELECT model, count(*) AS n, round(avg(CAST(predicted = label AS INTEGER)), 6) AS accuracy FROM p GROUP BY 1) JOIN (SELECT model, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1) USING (model)")
def benchmark_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(J.model_comparison(*answered(spark, sf_dir), "doc_id")[0])


@query(f"WITH {LONG} SELECT x.model AS model_a, y.model AS model_b, count(*) FILTER (WHERE x.predicted = x.label AND y.predicted <> y.label) AS only_a, count(*) FILTER (WHERE x.predicted <> x.label AND y.predicted = y.label) AS only_b FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.model < y.model GROUP BY 1, 2")
def benchmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.model_comparison(*answered(spark, sf_dir), "doc_id")[1]


GRID = [round(0.1 * i, 1) for i in range(1, 10)]


@query(f"""WITH s AS (SELECT event_type AS type, value / 100.0 AS p, event_id % 2 AS truth FROM events), g AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold),
f AS (SELECT type, threshold, coalesce(2.0 * count(*) FILTER (WHERE p >= threshold AND truth = 1) / nullif(count(*) FILTER (WHERE p >= threshold) + count(*) FILTER (WHERE truth = 1), 0), 0) AS f1 FROM s, g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY round(f1, 6) DESC, threshold) AS k FROM f) SELECT type, threshold, round(f1, 6) AS f1 FROM r WHERE k = 1""")
def type_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select(F.col("event_type").alias("type"), (F.col("value") / 100.0).alias("p"), (F.col("event_id") % 2).alias("truth"))
    return rounded(J.type_thresholds(s, GRID))


@query("WITH f AS (SELECT event_type, avg(value) / 100 AS rec, min(value) / 10 AS lo, count(*) / 1000.0 AS fa FROM events GROUP BY 1) SELECT event_type, CASE WHEN rec >= 0.9 AND lo >= 0.8 AND fa <= 5 THEN 'Met' WHEN rec >= 0.9 AND lo >= 0.8 AND fa > 5 THEN 'Recall met, over budget' WHEN rec >= 0.9 AND lo < 0.8 THEN 'Point estimate met, not established' WHEN rec < 0.9 THEN 'Not met' END AS outcome FROM f")
def recall_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = events(spark, sf_dir).groupBy("event_type").agg((F.avg("value") / 100).alias("rec"), (F.min("value") / 10).alias("lo"), (F.count("*") / 1000.0).alias("fa"))
    return J.recall_outcome(f).select("event_type", "outcome")


@query("WITH u AS (SELECT doc_id, CAST(1 + doc_id % 3 AS DOUBLE) AS w, CASE WHEN doc_id % 5 = 0 THEN (n_chars % 3 - 1) * 0.5 END AS d FROM documents) SELECT round(sum(w * coalesce(d, 0)) / sum(w), 6) AS d FROM u")
def union_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    rated = d.where("doc_id % 5 = 0").select("doc_id", ((F.col("n_chars") % 3 - 1) * 0.5).alias("difference"))
    return rounded(J.union_difference(rated, d.select("doc_id", (1 + F.col("doc_id") % 3).cast("double").alias("weight")), "doc_id"))


RAT = "r AS (SELECT user_id % 5 AS rater, event_id % 40 AS item, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'y' END AS system, value >= 30 AS ok FROM events)"


@query(f"""WITH {RAT}, l AS (SELECT DISTINCT rater AS left_out FROM r), s AS (SELECT left_out, item % 20 AS item, system, avg(CAST(ok AS INTEGER)) AS s FROM l JOIN r ON rater <> left_out GROUP BY 1, 2, 3),
w AS (SELECT left_out, item, max(s) FILTER (WHERE system = 'x') AS x, max(s) FILTER (WHERE system = 'y') AS y FROM s GROUP BY 1, 2) SELECT left_out AS rater, round(avg(y - x), 6) AS difference FROM w GROUP BY 1""")
def without_each_rater(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    r = e.select((F.col("user_id") % 5).alias("rater"), (F.col("event_id") % 40 % 20).alias("item"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("system"), (F.col("value") >= 30).alias("right"))
    return rounded(J.without_each_rater(r, "x", "y"))


@query("WITH p AS (SELECT user_id AS rater, event_id % 7 AS item, min(event_type) AS preferred FROM events GROUP BY 1, 2) SELECT preferred, count(*) AS n FROM p GROUP BY 1")
def preference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.preferences(events(spark, sf_dir).select(F.col("user_id").alias("rater"), (F.col("event_id") % 7).alias("item"), F.col("event_type").alias("preferred")))


@query("WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS pr FROM orders), t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS pr FROM orders) SELECT id, 'st' AS field, s.st AS a, t.st AS b FROM s JOIN t USING (id) WHERE s.st IS DISTINCT FROM t.st UNION ALL SELECT id, 'pr', s.pr, t.pr FROM s JOIN t USING (id) WHERE s.pr IS DISTINCT FROM t.pr")
def rater_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    other = o.withColumn("st", F.when(F.col("id") % 9 == 0, "X").otherwise(F.col("st"))).withColumn("pr", F.when(F.col("id") % 4 != 0, F.col("pr")))
    return J.disagreements(o, other, "id", ["st", "pr"])


@query("SELECT user_id % 7 AS hotel, count(*) AS reviews, CAST(sum(event_id % 4) AS BIGINT) AS flags, CAST(sum(least(event_id % 4, 2)) AS BIGINT) AS accepted, count(*) FILTER (WHERE value < 5) AS missing, round(avg(event_id % 5), 6) AS useful_mean, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS urgent_set, round(sum(least(event_id % 4, 2)) / sum(event_id % 4)::DOUBLE, 6) AS acc, round(count(*) FILTER (WHERE value < 5) / count(*), 6) AS miss, count(*) >= 1400 AND sum(event_id % 4) >= 100 AS qualifies FROM events GROUP BY 1")
def pilot_hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    r = D(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("hotel"), F.col("ts").alias("submitted_at"), (i % 4).alias("n_flags"), F.least(i % 4, F.lit(2)).alias("n_accepted"), (F.col("value") < 5).alias("missing"), (i % 5).alias("useful"), F.col("event_type").alias("urgent_set"))
    return rounded(J.pilot_hotels(r, least_reviews=1400, least_flags=100))


@query("WITH l AS (SELECT doc_id, doc_id % 2 AS a, CAST(n_chars % 3 = 0 AS INTEGER) AS b, lang FROM documents) SELECT 'set' AS what, lang AS name, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'type', 'a', CAST(sum(a) AS BIGINT) FROM l UNION ALL SELECT 'type', 'b', CAST(sum(b) AS BIGINT) FROM l UNION ALL SELECT 'reviews', 'with a type', count(*) FILTER (WHERE a + b > 0) FROM l UNION ALL SELECT 'reviews', 'with none', count(*) FILTER (WHERE a + b = 0) FROM l")
def label_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("lang", (F.col("doc_id") % 2).cast("int").alias("a"), (F.col("n_chars") % 3 == 0).cast("int").alias("b"))
    return J.label_record(d, "lang", ["a", "b"])


@query("WITH p AS (SELECT n_chars % 10 AS k, text, lang FROM documents) SELECT 'null_values' AS check_name, count(*) FILTER (WHERE k = 3) AS value FROM p UNION ALL SELECT 'blank_texts', count(*) FILTER (WHERE trim(text) = '') FROM p UNION ALL SELECT 'unknown_labels', count(*) FILTER (WHERE k <> 3 AND lang NOT IN ('en', 'de')) FROM p UNION ALL SELECT 'missing_labels', 2 - count(DISTINCT lang) FILTER (WHERE lang IN ('en', 'de') AND k <> 3) FROM p")
def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("y", F.when(F.col("n_chars") % 10 != 3, F.col("lang")))
    return rounded(C.frame_problems(d, "text", "y", ("en", "de")))


@query("""WITH s AS (SELECT event_id, event_id % 900 AS item FROM events), v AS (SELECT item, event_id FROM s), n AS (SELECT item, count(*) AS n FROM s GROUP BY 1)
SELECT item, 'label is X' AS problem FROM v WHERE event_id % 50 = 0 UNION ALL SELECT item, 'not done' FROM v WHERE event_id % 70 = 0
UNION ALL SELECT item, 'appears more than once' FROM n WHERE n > 1 UNION ALL SELECT item, 'not in the sample' FROM n WHERE item >= 890 UNION ALL SELECT e.item, 'missing' FROM (SELECT unnest(range(0, 890)) AS item UNION ALL SELECT 950) e LEFT JOIN n USING (item) WHERE n.n IS NULL""")
def sheet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = events(spark, sf_dir).select((i % 900).cast("string").alias("item"), F.when(i % 50 == 0, "X").when(i % 2 == 0, "1").otherwise("unsure").alias("label"), F.when(i % 70 == 0, "").otherwise("Yes ").alias("done"))
    expected = spark.range(890).union(spark.range(950, 951)).select(F.col("id").alias("item"))
    return C.sheet_problems(s, expected, "item", {"label": ("1", "0", "unsure")})


@query("WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only right' WHEN b.id IS NULL THEN 'only left' ELSE 's differs' END AS problem FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.s <> b.s")
def paired_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return C.misaligned(o.where("id % 7 <> 0"), o.where("id % 5 <> 0").withColumn("s", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("s"))), "id", "s")


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice >= 200000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'consistency' END) AS problems FROM orders")
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D(spark, sf_dir, "orders")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    r = C.record_problems(o, {"price": price < 200000, "status": status.isin("F", "O"), "consistency": (status != "F") | (price >= 50000)})
    return r.select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query("SELECT event_type AS split, CAST(count(*) - count(DISTINCT user_id) AS BIGINT) AS repeated FROM events GROUP BY 1")
def repeated_in_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated_in_split(events(spark, sf_dir), "user_id", "event_type").select(F.col("event_type").alias("split"), "repeated")


@query("WITH m AS (SELECT event_id, ['1.0', '0.0', '1', ' 0.0 ', '2.0', ''][1 + event_id % 6] AS v FROM events) SELECT event_id, CASE WHEN trim(v) IN ('1.0', '0.0') THEN substr(trim(v), 1, 1) ELSE v END AS mark, CAST(trim(v) IN ('1.0', '0.0') AS INTEGER) AS repaired FROM m")
def repaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.element_at(F.array(*map(F.lit, ("1.0", "0.0", "1", " 0.0 ", "2.0", ""))), (F.col("event_id") % 6 + 1).cast("int")).alias("mark"))
    return C.marks(e, ["mark"])


@query("""WITH s AS (SELECT doc_id AS item, text, doc_id % 5 AS k FROM documents WHERE doc_id % 13 <> 0)
SELECT item, 'another text' AS problem FROM s WHERE item % 17 = 0 UNION ALL SELECT item, 'not done' FROM s WHERE k = 1 UNION ALL SELECT item, 'type and none' FROM s WHERE k = 2 UNION ALL SELECT item, 'neither type nor none' FROM s WHERE k IN (3, 4) UNION ALL SELECT item, 'unknown value' FROM s WHERE k = 4 UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id % 13 = 0""")
def multi_label_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    k = F.col("doc_id") % 5
    cell = lambda c: F.when(c, "1").otherwise("")
    sheet = d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("item"), "text", cell(k.isin(0, 2)).alias("t1"), F.when(k == 4, "yes").otherwise("0").alias("t2"), cell(k.isin(1, 2)).alias("none"), cell(k != 1).alias("done"))
    drawn = d.select(F.col("doc_id").alias("item"), F.sha2(F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_sha256"))
    return C.multi_label_problems(sheet, drawn, "item", ["t1", "t2"])


@query("WITH r AS (SELECT c_nationkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey) SELECT CAST(c_nationkey AS BIGINT) AS hotel_id, month, count(*) AS reviews, round(sum(o_totalprice), 2) AS total_score FROM r GROUP BY 1, 2")
def view_hotel_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of the catalogue, read in SQL."""
    from plumbline.plans import catalog

    return catalog.sql(spark, sf_dir, "SELECT hotel_id, month, reviews, round(total_score, 2) AS total_score FROM hotel_months")


@query("""WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT l_orderkey) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.07 AND l_returnflag = 'R' GROUP BY 1)
SELECT month, round(k / n::DOUBLE, 6) AS rate FROM c JOIN t USING (month)""")
def function_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function of SQL over the views."""
    from plumbline.plans import catalog

    return catalog.sql(spark, sf_dir, "SELECT month, round(rate, 6) AS rate FROM rates_of('R')")


FINDINGS = "f AS (SELECT o_orderkey AS finding_id, o_orderkey AS review_id, c_nationkey AS hotel_id, o_orderpriority AS department, o_orderstatus = 'F' AS urgent, o_orderdate AS at FROM orders JOIN customer ON o_custkey = c_custkey)"


def decided(spark: SparkSession, sf_dir: str, *, hotels: bool = False):
    """Findings from orders; a decision for each line, the first by ship date and number counts, lines without them last. With hotels an order
    without a customer is no finding; without, every order is one."""
    o = D(spark, sf_dir, "orders")
    if hotels:
        o = o.join(D(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("hotel_id")), "o_custkey")
    else:
        o = o.withColumn("hotel_id", F.lit(None).cast("int"))
    f = o.select(F.col("o_orderkey").alias("finding_id"), "hotel_id", F.col("o_orderpriority").alias("department"), (F.col("o_orderstatus") == "F").alias("urgent"))
    at = F.struct(F.col("l_shipdate").isNull().alias("undated"), "l_shipdate", F.col("l_linenumber").isNull().alias("unnumbered"), "l_linenumber")
    d = D(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), at.alias("at"), F.when(F.col("l_returnflag") == "N", "confirmed").when(F.col("l_returnflag").isNotNull(), "rejected").alias("decision"), (F.col("l_linestatus") == "O").alias("still_open"))
    return ST.decided(f, d, opened=F.col("still_open"), priority=F.when(F.col("urgent"), "urgent").otherwise("normal"), recipient=F.concat(F.lit("desk-"), F.col("hotel_id").cast("string")), unstated="rejected")


FIRST = "l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'N' THEN 'confirmed' ELSE 'rejected' END AS decision, l_linestatus = 'O' AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS k, count(DISTINCT l_returnflag = 'N') OVER (PARTITION BY l_orderkey) > 1 AS conflict FROM lineitem)"


@query(f"WITH {FIRST} SELECT o_orderkey AS finding_id, coalesce(decision, 'proposed') AS decision, coalesce(conflict, false) AS conflict FROM orders LEFT JOIN (SELECT * FROM l WHERE k = 1) ON l_orderkey = o_orderkey")
def finding_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)[0].select("finding_id", "decision", "conflict")


@query(f"WITH {FIRST} SELECT 'ticket-' || o_orderkey || '-assigned' AS send_id, 'ticket-' || o_orderkey AS ticket_id, 'desk-' || c_nationkey AS recipient FROM orders JOIN customer ON o_custkey = c_custkey JOIN l ON l_orderkey = o_orderkey WHERE k = 1 AND decision = 'confirmed' AND o")
def decision_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir, hotels=True)[2].select("send_id", "ticket_id", "recipient")


@query(f"WITH {FIRST}, t AS (SELECT l_orderkey AS id FROM l WHERE k = 1 AND decision = 'confirmed' AND o) SELECT o_orderkey AS finding_id, 'ticket-' || id AS ticket_id, CASE WHEN id IS NOT NULL THEN 'assigned' END AS ticket_state FROM orders LEFT JOIN t ON id = o_orderkey")
def finding_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, t, _ = decided(spark, sf_dir)
    return ST.card(f, t).select("finding_id", "ticket_id", "ticket_state")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN value < 15 THEN NULL ELSE 'error ' || event_type END AS error FROM events WHERE value < 30), s AS (SELECT user_id, min(ts) FILTER (WHERE error IS NULL) AS sent FROM e GROUP BY 1),
k AS (SELECT user_id, count(*) AS n, max(ts) AS last, min(sent) AS sent FROM e JOIN s USING (user_id) WHERE sent IS NULL OR ts <= sent GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id AS send_id, CASE WHEN sent IS NOT NULL THEN 'sent' WHEN n IS NULL OR n < 5 THEN 'pending' ELSE 'failed' END AS state, CAST(coalesce(n, 0) AS INTEGER) AS attempts FROM u LEFT JOIN k USING (user_id)""")
def outbox_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    box = e.select(F.col("user_id").alias("send_id")).distinct().select("send_id", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit("2024-01-01").cast("timestamp_ntz").alias("next_attempt_at"))
    tries = e.where("value < 30").select(F.col("user_id").alias("send_id"), F.col("ts").alias("at"), F.when(F.col("value") >= 15, F.concat(F.lit("error "), "event_type")).alias("error"))
    return ST.outbox_state(box, tries).select("send_id", "state", "attempts")


@query("""WITH e AS (SELECT user_id, event_id, value < 50 AS draft, event_type FROM events), d AS (SELECT user_id, max(event_id) AS drafted, arg_max(event_type, event_id) AS draft FROM e WHERE draft GROUP BY 1), a AS (SELECT e.user_id, arg_max(event_type, event_id) AS said FROM e JOIN d ON d.user_id = e.user_id WHERE NOT e.draft AND event_id > drafted GROUP BY 1)
SELECT user_id AS review_id, CASE WHEN said IS NULL THEN 'draft' ELSE 'approved' END AS state, draft, said AS approved_text FROM d LEFT JOIN a USING (user_id)""")
def reply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return ST.replies(e.select(F.col("user_id").alias("review_id"), F.col("event_id").alias("at"), F.when(F.col("value") < 50, "draft").otherwise("approve").alias("kind"), F.col("event_type").alias("text")))


@query("WITH g AS (SELECT DISTINCT user_id FROM events WHERE value < 1), h AS (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view') SELECT user_id, user_id IN (SELECT user_id FROM h) AS found FROM g")
def erasure_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return ST.erased({t: e.where(F.col("event_type") == t) for t in ("click", "view")}, e.where("value < 1"), ["user_id"])[1]


@query("WITH r AS (SELECT user_id, list(event_type ORDER BY event_id) AS c, event_id // 500 AS v FROM events GROUP BY user_id, event_id // 500), m AS (SELECT user_id, max(v) AS v FROM r GROUP BY 1), x AS (SELECT r.user_id, unnest(c) AS type, unnest(range(0, len(c))) AS position FROM r JOIN m USING (user_id, v)) SELECT user_id, CAST(position AS INTEGER) AS position, type FROM x")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("v", F.floor(F.col("event_id") / 500))
    nested = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("type")))), lambda x: F.struct(x["type"].alias("type")))
    return ST.children(e.groupBy("user_id", "v").agg(nested.alias("c")), ["user_id"], "v", "c")


@query("SELECT doc_id, contains(text, substr(text, 3, 9)) AND substr(text, 3, 9) <> '' AS literal, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 END AS code FROM documents")
def mapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.literal_quote(F.col("text"), F.substring("text", 3, 9)).alias("literal"), X.mapped(F.col("lang"), {"en": 1, "de": 2}, strict=False).alias("code"))
