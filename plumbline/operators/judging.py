"""Judgements of people and models compared: topics, fields, raters, thresholds within a budget, decisions, hotels of a pilot."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import stats as S
from plumbline.operators import metrics as M

SIDES = {"all": ("negative", "positive"), "complaints": ("negative",), "praise": ("positive",)}


def topic_scores(reported: DataFrame, labelled: DataFrame) -> DataFrame:
    """(level, side, right, reported, labelled) over topics and over their categories (what stands before the dot); both: review_id,
    topic, sentiment."""
    parts = []
    for level, name in (("topic", F.col("topic")), ("category", F.substring_index("topic", ".", 1))):
        one = lambda df, c, name=name: df.select("review_id", name.alias("name"), "sentiment").distinct().withColumn(c, F.lit(1))
        j = one(reported, "r").join(one(labelled, "l"), ["review_id", "name", "sentiment"], "full_outer")
        parts.append(j.select(F.lit(level).alias("level"), "name", "sentiment", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("l", F.lit(0)).alias("l")))
    pairs = parts[0].unionByName(parts[1])
    side = F.explode(F.array_compact(F.array(*(F.when(F.col("sentiment").isin(*s), F.lit(k)) for k, s in SIDES.items()))))
    return pairs.withColumn("side", side).groupBy("level", "side").agg(F.sum(F.col("r") * F.col("l")).alias("right"), F.sum("r").alias("reported"), F.sum("l").alias("labelled"))


def field_truth(mentions: DataFrame, bands: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9, 1.01)) -> DataFrame:
    """(band, reported, real): complaints by the model's highest confidence. A complaint is real where it was found in the field for
    what guests disliked. mentions: review_id, field (pos or neg), aspect, sentiment, confidence."""
    unit = mentions.where(F.col("sentiment") == "negative").groupBy("review_id", "aspect").agg(F.max(F.col("field") == "neg").alias("real"), F.max("confidence").alias("c"))
    band = F
    for edge in bands:
        band = band.when(F.col("c") < edge, F.lit(f"<{edge:.2f}"))
    return unit.groupBy(band.alias("band")).agg(F.count("*").alias("reported"), F.count_if("real").alias("real"))


def topic_summary(findings: DataFrame) -> DataFrame:
    """(topic, complaining, praising, mixed): reviews on each side; one with both counts on both. findings: review_id, topic, sentiment."""
    per = findings.groupBy("review_id", "topic").agg(F.max((F.col("sentiment") == "negative").cast("int")).alias("c"), F.max((F.col("sentiment") != "negative").cast("int")).alias("p"))
    return per.groupBy("topic").agg(F.sum("c").alias("complaining"), F.sum("p").alias("praising"), F.sum(F.col("c") * F.col("p")).alias("mixed"))


def shortest_examples(quotes: DataFrame, by: list[str], review: str, quote: str, most: int = 2) -> DataFrame:
    """(by..., review, quote): of each review its shortest quote, of these the `most` shortest; ties by review."""
    one = quotes.groupBy(*by, review).agg(F.min_by(quote, F.struct(F.length(quote), F.col(quote))).alias(quote))
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.length(quote), review))
    return one.withColumn("k", k).where(F.col("k") <= most).drop("k")


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by..., value): the smallest value that `share` of a group's rows don't exceed."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias(value))


def cluster_sizes(rows: DataFrame, cluster: str) -> DataFrame:
    """clusters, rows, their mean and median size."""
    n = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.avg("n").alias("mean_size"), F.median("n").alias("median_size"))


def model_comparison(predictions: DataFrame, truth: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(model, n, accuracy, macro_f1) and (model_a, model_b, only_a, only_b) for models that answered exactly the test's rows; others are
    left out. predictions: model, key, predicted; truth: key, label. One pass over the joined rows serves all pairs."""
    size = truth.count()
    j = predictions.join(truth, key)
    known = j.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).where((F.col("n") == size) & (F.col("d") == size)).select("model")
    total = predictions.groupBy("model").agg(F.count("*").alias("m")).where(F.col("m") == size).select("model")
    j = j.join(F.broadcast(known.join(total, "model")), "model", "left_semi")
    c = j.groupBy("model", F.col("label").alias("t"), F.col("predicted").alias("p")).agg(F.count("*").alias("n"))
    cells = c.select("model", F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("t") == F.col("p")).alias("hit"))
    per = cells.groupBy("model", "x.label").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("hit") & (F.col("x.side") == "t"), F.col("n")).otherwise(0)).alias("hits"))
    f1 = per.groupBy("model").agg(F.avg(2 * F.col("hits") / F.col("both")).alias("macro_f1"))
    accuracy = c.groupBy("model").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    right = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", (F.col("label") == F.col("predicted")).alias("r")))).alias("m"))
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.model as model_a, y.model as model_b, x.r as a, y.r as b))))")
    p = right.select(F.explode(pairs).alias("p")).select("p.*")
    return accuracy.join(f1, "model"), p.groupBy("model_a", "model_b").agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


def tested(pairs: DataFrame, level: float = 0.05) -> list[dict]:
    """The pairs of model_comparison with the exact test's p; one row for each pair of models."""
    return [r.asDict() | {"p": (p := S.mcnemar(r["only_a"], r["only_b"])), "significant": p < level} for r in pairs.collect()]


def paired_cluster_bootstrap(tables_a: np.ndarray, tables_b: np.ndarray, statistic=S.macro_f1, *, resamples: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """(difference b - a, low, high): whole clusters are drawn once for both models. Tables: clusters x the statistic's counts."""
    n = len(tables_a)
    times = np.random.default_rng(seed).multinomial(n, np.full(n, 1 / n), resamples)
    at = lambda t: statistic(np.tensordot(times, t, 1))
    low, high = np.quantile(at(tables_b) - at(tables_a), [(1 - level) / 2, (1 + level) / 2])
    return float(statistic(tables_b.sum(0)) - statistic(tables_a.sum(0))), float(low), float(high)


def kappa_interval(table: np.ndarray, *, least: int = 10, resamples: int = 2000, seed: int = 0) -> dict:
    """Two raters' kappa from their 2 x 2 counts, with an interval over resampled rows; resamples in which a rater uses one value alone
    have no kappa and are counted, not used."""
    t = np.asarray(table, np.int64)
    n, a, b = int(t.sum()), int(t[1].sum()), int(t[:, 1].sum())
    if not (0 < a < n and 0 < b < n):
        return {"n": n, "status": "undefined"}
    if min(a, b) < least:
        return {"n": n, "status": "too few positives"}
    draws = np.random.default_rng(seed).multinomial(n, t.ravel() / n, resamples).reshape(-1, 2, 2)
    x, y = draws[:, 1].sum(1) / n, draws[:, :, 1].sum(1) / n
    good = (x > 0) & (x < 1) & (y > 0) & (y < 1)
    same, chance = (draws[:, 0, 0] + draws[:, 1, 1]) / n, x * y + (1 - x) * (1 - y)
    values = (same[good] - chance[good]) / (1 - chance[good])
    low, high = np.quantile(values, [0.025, 0.975])
    e = a / n * b / n + (1 - a / n) * (1 - b / n)
    return {"n": n, "status": "ok", "kappa": float(((t[0, 0] + t[1, 1]) / n - e) / (1 - e)), "low": float(low), "high": float(high), "dropped": int((~good).sum())}


def decide(figures: DataFrame, rules: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """figures with outcome: the first rule that holds. A null figure lets no rule hold that needs it."""
    out = F
    for rule, name in rules:
        out = out.when(F.coalesce(rule, F.lit(False)), F.lit(name))
    return figures.withColumn("outcome", out.otherwise(F.lit(otherwise)))


#: The rules on recall, its lower bound and false flags for a hundred reviews, in order.
RECALL_RULES = (
    ("rec >= 0.90 and lo >= 0.80 and fa <= 5", "Met"),
    ("rec >= 0.90 and lo >= 0.80 and fa > 5", "Recall met, over budget"),
    ("rec >= 0.90 and lo < 0.80", "Point estimate met, not established"),
    ("rec < 0.90", "Not met"),
)


def recall_outcome(figures: DataFrame) -> DataFrame:
    """figures(rec, lo, fa) with the outcome that the recall rules give."""
    return decide(figures, [(F.expr(rule), name) for rule, name in RECALL_RULES], "Undefined")


def type_thresholds(scores: DataFrame, grid: list[float]) -> DataFrame:
    """(type, threshold, f1): for each type the grid's value with the best f1, the smallest of equals. scores: type, p, truth."""
    g = scores.crossJoin(F.broadcast(scores.sparkSession.createDataFrame([(float(v),) for v in grid], "threshold double")))
    said, true = F.col("p") >= F.col("threshold"), F.col("truth") == 1
    f = g.groupBy("type", "threshold").agg(M.div(2 * F.count_if(said & true), F.count_if(said) + F.count_if(true)).alias("f1"))
    return f.groupBy("type").agg(F.min_by(F.struct("threshold", "f1"), F.struct((-F.round("f1", 6)).alias("a"), "threshold")).alias("b")).select("type", "b.*")


def risen(scores: DataFrame, start: dict[str, float], budget: float, *, step: float = 0.05, top: float = 0.95) -> tuple[dict[str, float], list[dict]]:
    """All thresholds raised together, step by step, until weighted false flags for 100 reviews are within the budget or all stand at
    the top. scores: review_id, type, p, truth, weight. One pass counts the false flags at every step: for each row the step from which
    on it is no longer flagged, for each review the largest of its false ones."""
    spark = scores.sparkSession
    most = int(round((top - min(start.values())) / step)) + 1
    first = spark.createDataFrame([(t, float(v)) for t, v in start.items()], "type string, first double")
    at = lambda k: F.least(F.round(F.col("first") + step * k, 2), F.lit(top))
    upto = sum((F.when(F.col("p") >= at(k), 1).otherwise(0) for k in range(most + 1)), F.lit(0))
    false = scores.join(F.broadcast(first), "type").withColumn("upto", F.when(F.col("truth") == 0, upto).otherwise(0))
    per = false.groupBy("review_id").agg(F.max("upto").alias("upto"), F.max("weight").alias("weight"))
    counts = {r["upto"]: r["w"] for r in per.groupBy("upto").agg(F.sum("weight").alias("w")).collect()}
    total, steps = sum(counts.values()), []
    for k in range(most + 1):
        now = {t: min(round(v + step * k, 2), top) for t, v in start.items()}
        fa = 100 * sum(w for u, w in counts.items() if u > k) / total if total else 0.0
        steps.append({"step": k, "fa": round(fa, 4), "thresholds": now})
        if steps[-1]["fa"] <= budget or all(v >= top for v in now.values()):
            break
    return steps[-1]["thresholds"], steps


def variant(figures: list[tuple[str, float, float]], budget: float) -> str:
    """Of (name, recall, false flags), simplest first: the best recall within the budget, the simpler of equals; the first where none is."""
    within = [f for f in figures if f[2] <= budget]
    return max(within, key=lambda f: f[1])[0] if within else figures[0][0]


def by_margin(figures: DataFrame, name: str, value: str, preferred: str, margin: float) -> DataFrame:
    """(best, lead): `preferred` where it leads the best other one by the margin at least, else that other one."""
    mine = F.max(F.when(F.col(name) == preferred, F.col(value)))
    other = F.max(F.when(F.col(name) != preferred, F.struct(F.col(value).alias("v"), F.col(name).alias("n"))))
    r = figures.agg(mine.alias("mine"), other.alias("other"))
    lead = F.col("mine") - F.col("other.v")
    return r.select(F.when(lead >= margin, F.lit(preferred)).otherwise(F.col("other.n")).alias("best"), F.round(lead, 6).alias("lead"))


def output_groups(a: Column, b: Column, urgent: list[str]) -> Column:
    """D where two outputs differ in urgent types, C where they agree and have some, Z where neither has any."""
    own = lambda c: F.array_sort(F.array_distinct(F.array_intersect(c, F.array(*map(F.lit, urgent)))))
    return F.when(own(a) != own(b), "D").when(F.size(own(a)) > 0, "C").otherwise("Z")


def union_difference(rated: DataFrame, union: DataFrame, key: str) -> DataFrame:
    """One row, d: the weighted mean over the union of the rated difference, 0 for rows that weren't rated. union: key, weight."""
    j = union.join(rated.select(key, "difference"), key, "left")
    return j.agg(F.try_divide(F.sum(F.col("weight") * F.coalesce("difference", F.lit(0.0))), F.sum("weight")).alias("d"))


def without_each_rater(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """(rater, difference): the mean over items of b's share of right ratings less a's, with that rater left out. ratings: rater, item,
    system, right. Items' counts less a rater's own, so ratings are read once, not once for each rater."""
    cell = ratings.groupBy("item", "system").agg(F.sum(F.col("right").cast("int")).alias("k"), F.count("*").alias("n"))
    own = ratings.groupBy("rater", "item", "system").agg(F.sum(F.col("right").cast("int")).alias("ok"), F.count("*").alias("on"))
    each = cell.crossJoin(F.broadcast(ratings.select("rater").distinct())).join(own, ["rater", "item", "system"], "left").na.fill(0, ["ok", "on"])
    share = each.select("rater", "item", "system", F.try_divide((F.col("k") - F.col("ok")).cast("double"), (F.col("n") - F.col("on")).cast("double")).alias("s"))
    wide = share.groupBy("rater", "item").agg(F.max(F.when(F.col("system") == a, F.col("s"))).alias("a"), F.max(F.when(F.col("system") == b, F.col("s"))).alias("b"))
    return wide.groupBy("rater").agg(F.avg(F.col("b") - F.col("a")).alias("difference"))


def preferences(ratings: DataFrame) -> DataFrame:
    """(preferred, n): each rater's preference for an item once."""
    return ratings.groupBy("rater", "item").agg(F.min("preferred").alias("preferred")).groupBy("preferred").agg(F.count("*").alias("n"))


def disagreements(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, a, b) where two raters' sheets differ."""
    long = lambda df, name: df.select(key, *(F.col(c).cast("string").alias(c) for c in fields)).unpivot([key], fields, "field", name)
    j = long(a, "a").join(long(b, "b"), [key, "field"], "full_outer")
    return j.where(~F.col("a").eqNullSafe(F.col("b")))


def ratings_refused(sheet: DataFrame) -> DataFrame:
    """(blind_id, problem) where a sheet of coverage counts contradicts itself. sheet: blind_id, n_actions, useful (0 or 1), useful_actions,
    wrong_department, unnecessary, actual, missed, unaddressed, invented, failed."""
    c = F.col
    short = c("missed") + c("unaddressed") + c("invented") + c("unnecessary") + c("wrong_department") > 0
    said = F.array_compact(F.array(
        F.when((c("useful_actions") + c("wrong_department") > c("n_actions")) | (c("useful_actions") + c("unnecessary") > c("n_actions")), "more judged than accepted"),
        F.when(c("missed") > c("unaddressed"), "missed beyond unaddressed"), F.when(c("failed") & (c("useful") == 1), "failed and useful"),
        F.when((c("useful") == 1) & short, "useful with shortcomings"), F.when((c("n_actions") == 0) & (c("unaddressed") != c("actual")), "nothing accepted, yet addressed"),
    ))
    return sheet.select("blind_id", F.explode(said).alias("problem"))


def coverage(sheet: DataFrame) -> DataFrame:
    """One row: the sheet's sums and the share of problems addressed."""
    names = ["n_actions", "useful_actions", "actual", "missed", "unaddressed", "invented"]
    s = sheet.agg(F.count("*").alias("reviews"), *(F.sum(n).alias(n) for n in names))
    return s.withColumn("addressed", F.try_divide((F.col("actual") - F.col("unaddressed")).cast("double"), F.col("actual").cast("double")))


def pilot_hotels(records: DataFrame, *, least_reviews: int, least_flags: int) -> DataFrame:
    """A row for each hotel: rated reviews, flags and accepted ones, share of reviews with a missing urgent problem, mean usefulness, the
    urgent set at the last rating, and whether it qualifies. records: hotel, submitted_at, n_flags, n_accepted, missing, useful, urgent_set."""
    n, flags, ok, missing = F.count("*"), F.sum("n_flags"), F.sum("n_accepted"), F.count_if("missing")
    s = records.groupBy("hotel").agg(n.alias("reviews"), flags.alias("flags"), ok.alias("accepted"), missing.alias("missing"), F.avg("useful").alias("useful_mean"), F.max_by("urgent_set", F.struct("submitted_at", "urgent_set")).alias("urgent_set"))
    return s.select("*", F.try_divide(F.col("accepted").cast("double"), F.col("flags").cast("double")).alias("acc"), (F.col("missing") / F.col("reviews")).alias("miss"), ((F.col("reviews") >= least_reviews) & (F.col("flags") >= least_flags)).alias("qualifies"))


def macro(hotels: DataFrame, numerator: str, denominator: str) -> tuple[Fraction, Fraction]:
    """(mean, least) of the qualifying hotels' ratios, exact: a mean that is just a threshold doesn't miss it by rounding. Hotels are few."""
    parts = [Fraction(r[0], r[1]) for r in hotels.where("qualifies").select(F.col(numerator).cast("long"), F.col(denominator).cast("long")).collect()]
    return sum(parts, Fraction(0)) / len(parts), min(parts)


def context_line(analytics: DataFrame, days: int, most: int = 3) -> DataFrame:
    """One row, line: the hotel's aspects with most priority that have complaints, or null. analytics: aspect, negative_count, priority_score."""
    top = analytics.where("negative_count > 0").orderBy(F.desc("priority_score"), "aspect").limit(most)
    said = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority_score")).alias("p"), "aspect", "negative_count"))), lambda x: F.concat_ws(" ", x["aspect"], x["negative_count"].cast("string")))
    return top.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"Recent negative mentions at this hotel (last {days} days): "), F.array_join(said, ", "))).alias("line"))


def label_record(labels: DataFrame, set_: str, types: list[str]) -> DataFrame:
    """(what, name, n): reviews of each set, labels of each type, reviews with a type and with none."""
    some = sum((F.col(t) for t in types), F.lit(0)) > 0
    total = labels.agg(*(F.sum(t).cast("long").alias(t) for t in types), F.count_if(some).alias("with a type"), F.count_if(~some).alias("with none"))
    wide = total.unpivot([], [*types, "with a type", "with none"], "name", "n").select(F.when(F.col("name").isin(*types), "type").otherwise("reviews").alias("what"), "name", "n")
    return labels.groupBy(F.col(set_).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit("set").alias("what"), "name", "n").unionByName(wide)
