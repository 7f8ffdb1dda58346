"""Triage: complaint lexicon v1, routing, answer and action validation, summaries, urgent pairs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOPICS = ("bathroom", "cleanliness", "air_conditioning", "pests", "responsiveness")
#: Link words, the rules of lexicon v1 (topic, rule, words before, words after or before), and its guard.
LINK = r"\s+(?:(?:was|were|is|are|had|has|very|really|still|always|completely|too|a|the)\s+){0,3}"
SURFACE, DIRTY = "room|bathroom|desk|cupboard|carpet|floor|wall|walls", "dirty|dusty|filthy|stained|mouldy|moldy"
RULES = (
    ("bathroom", "bathroom_fault", rf"\b(?:shower|toilet|sink|tap|bath|bathtub){LINK}(?:cold|lukewarm|leaking|blocked|broken|clogged|tiny)\b"),
    ("cleanliness", "dirty_surface", rf"\b(?:{SURFACE}){LINK}(?:{DIRTY})\b"),
    ("cleanliness", "dirty_surface_adjective", rf"\b(?:{DIRTY})\s+(?:{SURFACE})\b"),
    ("air_conditioning", "hvac_fault", rf"\b(?:air[ -]?(?:conditioning|conditioner|con)|a/c|ac|heating|heater){LINK}(?:broken|leaking|noisy|ineffective|faulty)\b"),
    ("pests", "observed_pests", r"\b(?:saw|found|noticed)\s+(?:(?:a|an|some|many|several|live)\s+){0,2}(?:ants|cockroaches|cockroach|bed[ -]?bugs|mice|rats)\b"),
    ("responsiveness", "staff_ignored_request", r"\b(?:staff|reception|receptionist|hotel)\s+(?:ignored|ignores)\s+(?:(?:my|our|the|repeated)\s+){0,2}(?:request|requests|complaint|complaints)\b"),
)
GUARD = r"\b(?:if|unless|would|could|might|not|never|no|without|fixed|repaired|resolved|replaced|used to|previously|earlier|formerly)\b|n['’]t\b"


def lexicon_v1(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with a column for each topic, 'yes' or 'unsure', and the matched excerpts. A guard word anywhere blocks all; a
    topic without a match is unsure, never no."""
    open_ = ~F.rlike(F.col(text), F.lit(f"(?i){GUARD}"))
    named = lambda t, r: lambda x: F.struct(F.lit(t).alias("topic"), F.lit(r).alias("rule"), x.alias("excerpt"))
    about = lambda t: lambda x: x["topic"] == t
    excerpts = F.flatten(F.array(*(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({p})"), F.lit(1)), named(t, r)) for t, r, p in RULES)))
    out = rows.withColumn("evidence", F.when(open_, excerpts).otherwise(F.array().cast("array<struct<topic:string,rule:string,excerpt:string>>")))
    return out.withColumns({t: F.when(F.exists("evidence", about(t)), "yes").otherwise("unsure") for t in TOPICS})


def doubtful(answer, p, low: float = 0.20, high: float = 0.50) -> Column:
    return F.coalesce((answer == "unsure") | ((answer == "no") & (p >= low) & (p < high)) | ((answer == "yes") & (p < high)), F.lit(False))


def routing(rows: DataFrame, *, label: str = "label", confidence: str = "confidence", answers: str = "answers", status: str = "status", least: float = 0.80) -> DataFrame:
    """rows with reasons, review_reasons, triggered, needs_review. answers: array of (topic, answer, probability)."""
    ok, c = F.col(status) == "ok", F.col(confidence)
    unsure = c < least
    yes = ok & F.exists(answers, lambda a: a["answer"] == "yes")
    doubt = ok & F.exists(answers, lambda a: doubtful(a["answer"], a["probability"]))
    named = lambda *pairs: F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)))
    reasons = named(("negative_sentiment", F.lower(F.trim(label)).startswith("neg")), ("uncertain_sentiment", unsure), ("complaint_detected", yes), ("uncertain_complaint", doubt))
    review = named(("uncertain_sentiment", unsure), ("uncertain_complaint", doubt), ("complaint_check_failed", F.col(status) == "error"))
    return rows.withColumns({"reasons": reasons, "review_reasons": review}).withColumns({"triggered": F.size("reasons") > 0, "needs_review": F.size("review_reasons") > 0})


ACTION = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("excerpt", "problem", "department", "suggestion")]))


def actions(rows: DataFrame, departments: tuple[str, ...], *, answer: str = "answer", text: str = "text", most: int = 5) -> DataFrame:
    """rows with valid: parsed actions with all fields of 3 to 400 characters, a known department and an excerpt that the text
    holds, each (excerpt, problem) once, `most` at most; and n_parsed, n_dropped."""
    parsed = F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), ACTION), F.array().cast(ACTION))
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    fine = lambda a: F.coalesce(F.length(a["excerpt"]).between(3, 400) & F.length(a["problem"]).between(3, 400) & F.length(a["suggestion"]).between(3, 400) & a["department"].isin(*departments) & F.contains(key(F.col(text)), key(a["excerpt"])), F.lit(False))
    r = rows.withColumn("parsed", parsed).withColumn("good", F.filter("parsed", fine))
    first = F.filter("good", lambda a, i: ~F.exists(F.slice("good", F.lit(1), i), lambda b: (b["excerpt"] == a["excerpt"]) & (b["problem"] == a["problem"])))
    return r.withColumn("valid", F.slice(first, 1, most)).withColumn("n_parsed", F.size("parsed")).withColumn("n_dropped", F.size("parsed") - F.size("valid")).drop("parsed", "good")


def valid_answers(rows: DataFrame, answers: str = "answers") -> DataFrame:
    """rows with problems: the choice is 1, 0 or unsure, probabilities lie in 0 to 1 and sum to 1."""
    bad = lambda a: F.array_compact(F.array(F.when(~a["answer"].isin("1", "0", "unsure"), F.lit("choice")), F.when(F.exists(F.map_values(a["probabilities"]), lambda p: (p < 0) | (p > 1)), F.lit("range")), F.when(F.abs(F.aggregate(F.map_values(a["probabilities"]), F.lit(0.0), lambda s, p: s + p) - 1) > 1e-5, F.lit("sum"))))
    return rows.withColumn("problems", F.array_distinct(F.flatten(F.transform(answers, bad))))


def summary(answers: DataFrame, by: str = "topic", answer: str = "answer") -> DataFrame:
    """Counts of yes, no and unsure for each topic, missing ones 0."""
    return answers.groupBy(by).pivot(answer, ["yes", "no", "unsure"]).count().na.fill(0)


def status(stages: list[Column]) -> Column:
    """ok where all stages are, else partial."""
    return F.when(sum((F.when(s == "ok", 0).otherwise(1) for s in stages), F.lit(0)) == 0, "ok").otherwise("partial")


def urgent_pairs(truth: DataFrame, said: DataFrame, urgent: DataFrame) -> DataFrame:
    """(review_id, department, true, caught): truth, said: review_id, type; urgent: type, department of the urgent types."""
    side = lambda df: df.join(urgent, "type").select("review_id", "department").distinct()
    t, s = side(truth).withColumn("true", F.lit(True)), side(said).withColumn("caught", F.lit(True))
    return t.join(s, ["review_id", "department"], "full_outer").na.fill(False, ["true", "caught"])


def findings(rows: DataFrame, known: tuple[str, ...], *, text: str = "text") -> DataFrame:
    """rows(review_id, type, status, excerpt, text, position): known type and status, grounded excerpt, the first of each type."""
    r = rows.where(F.col("type").isin(*known) & F.col("status").isin("resolved", "pending", "unclear") & F.contains(F.lower(text), F.lower("excerpt")))
    rest = [c for c in r.columns if c not in ("review_id", "type")]
    f = r.groupBy("review_id", "type").agg(F.min_by(F.struct(*rest), "position").alias("f"))
    return f.select("review_id", "type", *(F.col(f"f.{c}").alias(c) for c in rest))


def blinded(rows: DataFrame, rater: str, item: str) -> DataFrame:
    """rows with place, by a digest of rater and item, and swapped, by the parity of another: the side says nothing of the order."""
    d = lambda what: F.sha2(F.concat_ws("|", F.lit(what), F.col(rater).cast("string"), F.col(item).cast("string")), 256)
    return rows.withColumn("place", d("order")).withColumn("swapped", F.conv(F.substring(d("side"), 64, 1), 16, 10).cast("int") % 2 == 1)


def adjudicated(values: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """values(key..., a, b) with final: the agreed value or the decision; covered tells whether a disagreement has one, and
    decisions without a disagreement come as rows of their own with stray."""
    j = values.join(decisions.select(*key, "decision"), key, "full_outer")
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    stray = F.col("decision").isNotNull() & ~F.coalesce(differ, F.lit(False))
    return j.select(*key, F.when(differ, F.col("decision")).otherwise(F.col("a")).alias("final"), (~differ | F.col("decision").isNotNull()).alias("covered"), stray.alias("stray"))


def settled(values: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """(key..., final) of adjudicated values; a disagreement without a decision, or a decision without a disagreement, refuses all."""
    from plumbline.operators.checks import refuse

    a = adjudicated(values, decisions, key)
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in key))
    refuse(a.where("not covered or stray").select(F.concat(name, F.when(F.col("stray"), ": a decision where none is needed").otherwise(": no decision")).alias("problem")), "adjudication")
    return a.select(*key, "final")


def distributions(answers: str) -> Column:
    """Answers with probabilities that sum to 1; those that sum to 0, or hold a negative one, have none."""

    def one(a: Column) -> Column:
        total = F.aggregate(F.map_values(a["probabilities"]), F.lit(0.0), lambda s, p: s + p)
        fine = (total > 0) & ~F.exists(F.map_values(a["probabilities"]), lambda p: p < 0)
        return F.struct(a["topic"].alias("topic"), a["answer"].alias("answer"), F.when(fine, F.transform_values(a["probabilities"], lambda _, p: p / total)).alias("probabilities"))

    return F.transform(answers, one)


def question_bank(spark, questions: dict[str, tuple[str, str, str]], version: str) -> tuple[DataFrame, str]:
    """(the questions as a table, their digest): topic -> (what is asked, what counts, what doesn't). The digest covers the version and every
    word, so answers can name the bank they were given to."""
    digest = hashlib.sha256(json.dumps({"version": version, "questions": questions}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    rows = [(i, topic, *words, version, digest) for i, (topic, words) in enumerate(questions.items())]
    return spark.createDataFrame(rows, "position int, topic string, ask string, counts string, other string, version string, bank_sha256 string"), digest
