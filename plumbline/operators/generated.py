"""What language models return: JSON salvage and strict reading, issues with evidence, batch answers, cost, spans, keyword analysis.

Strict reading needs to see every key of an object; Spark's JSON functions keep the last of repeated keys, so it is done in Arrow
batches by one pass over the text. Everything that follows is columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aspects and the names that stand for them, word for word.
ASPECTS = {
    "cleanliness": ("cleanliness", "clean", "hygiene"),
    "staff": ("staff", "service", "employees", "reception"),
    "location": ("location",),
    "room": ("room", "bed", "bathroom"),
    "food": ("food", "breakfast", "restaurant", "bar"),
    "noise": ("noise", "quiet", "sound"),
    "value": ("value", "price", "money"),
    "facilities": ("facilities", "wifi", "pool", "parking"),
}
SENTIMENTS = ("positive", "negative", "neutral")
LONGEST = 400


def _lookup(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def aspect(c: Column) -> Column:
    """The aspect that a name stands for; null for any other name, however alike."""
    plain = F.trim(F.translate(F.lower(F.trim(c)), "-_", "  "))
    return F.try_element_at(_lookup([(alias, name) for name, aliases in ASPECTS.items() for alias in aliases]), plain)


def sentiment(c: Column) -> Column:
    plain = F.lower(F.trim(c))
    return F.when(plain.isin(*SENTIMENTS), plain)


class _Object(list):
    """Pairs of a JSON object, repeated keys and all."""


def _plain(x):
    if isinstance(x, _Object):
        return {k: _plain(v) for k, v in x}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _repeated(x) -> set[str]:
    if isinstance(x, _Object):
        keys = [k for k, _ in x]
        return {k for k in keys if keys.count(k) > 1}.union(*(_repeated(v) for _, v in x))
    return set().union(*map(_repeated, x)) if isinstance(x, list) else set()


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_Object)
_STRICT = json.JSONDecoder(object_pairs_hook=_Object, parse_constant=_refuse)


def _values(text: str):
    """JSON objects and lists of a text, outermost ones, in order."""
    at = 0
    while (m := re.compile(r"[{\[]").search(text, at)) is not None:
        try:
            value, at = _DECODER.raw_decode(text, m.start())
            yield value
        except (ValueError, RecursionError):
            at = m.start() + 1


def first_object(text: str | None, key: str = "actions") -> tuple[str | None, str]:
    """(JSON, outcome): the first value of a text that is a list of objects or an object whose `key` is a list. The outcome is ok, none,
    or repeated_key: an object that repeats a key ends the search, since one reading of it would be a guess."""
    for value in _values(text or ""):
        if _repeated(value):
            return None, "repeated_key"
        plain = _plain(value)
        if isinstance(plain, list) and all(isinstance(x, dict) for x in plain) or isinstance(plain, dict) and isinstance(plain.get(key), list):
            return json.dumps(plain, ensure_ascii=False), "ok"
    return None, "none"


def diagnosis(text: str | None) -> tuple[bool, list[str]]:
    """(the whole text is one JSON object without repeated keys, those keys)."""
    try:
        value, end = _STRICT.raw_decode((text or "").strip())
    except (ValueError, RecursionError):
        return False, []
    twice = sorted(_repeated(value))
    return isinstance(value, _Object) and not twice and end == len((text or "").strip()), twice


def salvaged(rows: DataFrame, answer: str, key: str = "actions") -> DataFrame:
    """rows with found (JSON or null), outcome, whole (the answer is one clean object) and repeated_keys."""

    @F.pandas_udf("found string, outcome string, whole boolean, repeated_keys array<string>")
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*first_object(t, key), *diagnosis(t)) for t in s], columns=["found", "outcome", "whole", "repeated_keys"])

    return rows.withColumn("__read", read(F.col(answer))).select(*rows.columns, "__read.*")


ENTRY = "array<struct<aspect:string,sentiment:string,quote:string>>"


def aspect_entries(rows: DataFrame, answer: str, text: str, most: int = LONGEST) -> DataFrame:
    """rows with entries: the answer's first JSON list, each entry's aspect and sentiment known and its quote in the text, an aspect and
    sentiment once; and how many of the n_entries were dropped as unknown, ungrounded or repeated."""
    r = salvaged(rows, answer, "aspects")
    body = F.when(F.col("found").startswith("{"), F.get_json_object("found", "$.aspects")).otherwise(F.col("found"))
    parsed = F.coalesce(F.from_json(body, ENTRY), F.from_json(F.lit("[]"), ENTRY))
    entries = F.transform(parsed, lambda e: F.struct(aspect(e["aspect"]).alias("aspect"), sentiment(e["sentiment"]).alias("sentiment"), F.trim(e["quote"]).alias("quote")))
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    known = F.filter("entries", lambda e: e["aspect"].isNotNull() & e["sentiment"].isNotNull())
    grounded = F.filter("known", lambda e: F.coalesce((e["quote"] != "") & (F.length(e["quote"]) <= most) & F.contains(fold(F.col(text)), fold(e["quote"])), F.lit(False)))
    once = F.filter("grounded", lambda e, i: ~F.exists(F.slice("grounded", F.lit(1), i), lambda b: (b["aspect"] == e["aspect"]) & (b["sentiment"] == e["sentiment"])))
    r = r.withColumn("entries", entries).withColumn("known", known).withColumn("grounded", grounded).withColumn("once", once)
    n = {"n_entries": F.size("entries"), "n_unknown": F.size("entries") - F.size("known"), "n_ungrounded": F.size("known") - F.size("grounded"), "n_repeated": F.size("grounded") - F.size("once")}
    return r.select(*rows.columns, "outcome", F.col("once").alias("entries"), *(v.alias(k) for k, v in n.items()))


def one_key(text: str | None, key: str) -> list | None:
    """The list of an answer that is one object with that key alone, within one fence or none, no key repeated; else null."""
    body = re.sub(r"\A```(?:json)?[ \t]*\r?\n(.*?)\r?\n[ \t]*```\Z", r"\1", (text or "").strip(), flags=re.S | re.I)
    clean, _ = diagnosis(body)
    value = json.loads(body) if clean else None
    return value[key] if isinstance(value, dict) and set(value) == {key} and isinstance(value[key], list) else None


#: Statuses, and the department of each category.
STATUSES = ("REAL_PENDING", "REAL_RESOLVED", "HYPOTHETICAL", "POSITIVE_COMMENT", "UNCERTAIN")
DEPARTMENT_OF = {"equipment_fault": "maintenance", "cleanliness": "housekeeping", "pests": "housekeeping", "linen": "housekeeping", "food_beverage": "food_and_beverage", "service_response": "reception", "policy": "management", "access": "management", "other": "other"}
ISSUES = "array<struct<problem:string,excerpt:string,evidence:struct<reported:string,hypothetical:string,resolved:string>,status:string,category:string>>"


def issues(rows: DataFrame, answer: str, text: str, most: int = 5) -> DataFrame:
    """rows with issues (numbered from 1, with department, status and review_reasons) and refused: why the whole answer isn't used.

    Quotes must stand in the text. A status that its evidence doesn't bear out becomes UNCERTAIN: pending needs what was reported and
    neither of the others, resolved needs the report and the fix, hypothetical that alone, praise none."""

    @F.pandas_udf("string")
    def strict(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (found := one_key(t, "issues")) is None else json.dumps(found, ensure_ascii=False))

    r = rows.withColumn("listed", strict(F.col(answer))).withColumn("parsed", F.from_json("listed", ISSUES))
    field = lambda c: F.coalesce(F.length(F.trim(c)).between(3, LONGEST), F.lit(False))
    here = lambda c: F.coalesce(F.contains(F.col(text), c), F.lit(False))
    quotes = lambda e: [e["evidence"][k] for k in ("reported", "hypothetical", "resolved")]
    fine = lambda e: field(e["problem"]) & field(e["excerpt"]) & F.coalesce(e["status"].isin(*STATUSES) & e["category"].isin(*DEPARTMENT_OF) & e["evidence"].isNotNull(), F.lit(False))
    grounded = lambda e: here(e["excerpt"]) & ~sum((F.when(q.isNotNull() & ~(field(q) & here(q)), 1).otherwise(0) for q in quotes(e)), F.lit(0)).cast("boolean")
    refused = F.when(F.col("parsed").isNull(), "no_object").when(F.size("parsed") > most, "too_many").when(~F.forall("parsed", fine), "fields").when(~F.forall("parsed", grounded), "quotes")
    refused = refused.when(F.size(F.array_distinct(F.transform("parsed", lambda e: e["excerpt"]))) < F.size("parsed"), "repeated_excerpt")

    def judged(e, i):
        reported, hypothetical, resolved = (q.isNotNull() for q in quotes(e))
        bad = F.when((e["status"] == "REAL_PENDING") & (~reported | hypothetical | resolved), "pending").when((e["status"] == "REAL_RESOLVED") & (~reported | ~resolved | hypothetical), "resolved")
        bad = bad.when((e["status"] == "HYPOTHETICAL") & (~hypothetical | reported | resolved), "hypothetical").when((e["status"] == "POSITIVE_COMMENT") & (reported | hypothetical | resolved), "praise")
        status = F.when(bad.isNotNull(), "UNCERTAIN").otherwise(e["status"])
        reasons = F.array_compact(F.array(F.concat(bad, F.lit("_evidence")), F.when(status == "UNCERTAIN", "uncertain_issue"), F.when(e["category"].isin("access", "other"), "department_needs_confirmation")))
        department = F.element_at(_lookup(list(DEPARTMENT_OF.items())), e["category"])
        return F.struct((i + 1).alias("issue_id"), e["problem"].alias("problem"), e["excerpt"].alias("excerpt"), status.alias("status"), e["status"].alias("model_status"), department.alias("department"), reasons.alias("review_reasons"))

    r = r.withColumn("refused", refused)
    return r.withColumn("issues", F.when(F.col("refused").isNull(), F.transform("parsed", judged))).select(*rows.columns, "issues", "refused")


MEASURES = "array<struct<issue_id:int,measure:string,to_confirm:array<string>>>"


def measures(rows: DataFrame, answer: str, issues: str = "issues", most: int = 2) -> DataFrame:
    """rows with actions: each measure of the answer with the problem, excerpt and department of the pending issue that it names, each
    issue once; null where the answer breaks a rule."""

    @F.pandas_udf("string")
    def strict(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (found := one_key(t, "actions")) is None else json.dumps(found, ensure_ascii=False))

    r = rows.withColumn("given", F.from_json(strict(F.col(answer)), MEASURES)).withColumn("pending", F.filter(issues, lambda i: i["status"] == "REAL_PENDING"))
    named = lambda m: F.filter("pending", lambda i: i["issue_id"] == m["issue_id"])
    field = lambda c: F.coalesce(F.length(F.trim(c)).between(3, LONGEST), F.lit(False))
    fine = lambda m: field(m["measure"]) & (F.size(named(m)) == 1) & F.coalesce(F.size(m["to_confirm"]).between(0, 5), F.lit(False)) & F.coalesce(F.forall(m["to_confirm"], field), F.lit(False))
    whole = F.col("given").isNotNull() & (F.size("given") <= most) & F.forall("given", fine) & (F.size(F.array_distinct(F.transform("given", lambda m: m["issue_id"]))) == F.size("given"))
    joined = F.transform("given", lambda m: F.struct(*(named(m)[0][c].alias(c) for c in ("problem", "excerpt", "department")), m["measure"].alias("measure"), m["to_confirm"].alias("to_confirm")))
    return r.withColumn("actions", F.when(whole, joined)).select(*rows.columns, "actions")


def batch_answers(rows: DataFrame, answer: str, items: str, types: tuple[str, ...]) -> DataFrame:
    """rows with labels (item -> sorted types) and refused. items: the numbers sent; the answer must cover exactly these, each once, with
    known types."""
    body = F.regexp_replace(F.trim(answer), r"(?s)^```[^\n]*\n(.*)```.*$", "$1")
    r = rows.withColumn("parsed", F.from_json(body, "labels array<struct<item:int,types:array<string>>>")["labels"])
    got = F.transform("parsed", lambda e: e["item"])
    odd = F.exists("parsed", lambda e: e["item"].isNull() | e["types"].isNull() | F.exists(e["types"], lambda t: ~t.isin(*types)))
    refused = F.when(F.col("parsed").isNull(), "no_object").when(F.array_sort(got) != F.array_sort(F.col(items).cast("array<int>")), "items").when(F.coalesce(odd, F.lit(True)), "types")
    labels = F.map_from_entries(F.transform("parsed", lambda e: F.struct(e["item"], F.array_sort(F.array_distinct(e["types"])))))
    return r.withColumn("refused", refused).withColumn("labels", F.when(F.col("refused").isNull(), labels)).drop("parsed")


def label_matrix(labels: DataFrame, items: DataFrame, item: str, types: list[str]) -> DataFrame:
    """items with a 0/1 column for each type, none and failed. labels: item, type (null: the item was answered with no type); items
    without any row of labels failed."""
    present = labels.groupBy(item).agg(*(F.max(F.when(F.col("type") == t, 1).otherwise(0)).alias(t) for t in types), F.lit(1).alias("__answered"))
    j = items.join(present, item, "left")
    some = sum((F.coalesce(F.col(t), F.lit(0)) for t in types), F.lit(0))
    failed = F.col("__answered").isNull().cast("int")
    return j.select(*items.columns, *(F.coalesce(t, F.lit(0)).alias(t) for t in types), ((some == 0) & (failed == 0)).cast("int").alias("none"), failed.alias("failed"))


def cost(rows: DataFrame, reported: str, prompt: str, completion: str, price_in: float, price_out: float) -> DataFrame:
    """rows with cost_usd, as reported or else from the tokens at prices for a million, and cost_source."""
    estimate = (F.coalesce(F.col(prompt), F.lit(0)) * price_in + F.coalesce(F.col(completion), F.lit(0)) * price_out) / 1e6
    return rows.withColumns({"cost_usd": F.coalesce(F.col(reported).cast("double"), estimate), "cost_source": F.when(F.col(reported).isNull(), "estimated").otherwise("reported")})


def cost_summary(rows: DataFrame, reported: str) -> DataFrame:
    """attempts, how many report a cost, their sum (null, not 0, where none does), and whether all do."""
    n, k = F.count("*"), F.count(reported)
    return rows.agg(n.alias("attempts"), k.alias("with_cost"), F.sum(reported).alias("cost_sum"), ((n > 0) & (n == k)).alias("complete"))


def run_summary(rows: DataFrame, *flags: str) -> DataFrame:
    """n and for each flag its count and rate; rates are null without rows."""
    n = F.count("*")
    return rows.agg(n.alias("n"), *(x for f in flags for x in (F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f), F.round(F.try_divide(F.count_if(F.coalesce(F.col(f), F.lit(False))), n), 4).alias(f"{f}_rate"))))


def label_of(c: Column, labels: tuple[str, ...] = ("positive", "negative")) -> Column:
    """The label that the first labelled word of a generated text starts with; else positive where the text holds it, else negative."""
    t = F.lower(F.trim(c))
    word = F.regexp_extract(t, rf"(?:^|[\s.,])({'|'.join(labels)})", 1)
    return F.when(word != "", word).when(F.contains(t, F.lit("positive")), "positive").otherwise("negative")


#: What the demonstration analyser looks for, in order, and how it reads the outcome.
KEYWORDS = (
    ("hvac_failure", r"air[- ]?con\w*|\ba/?c\b|κλιματισ\w*|θέρμανσ\w*|heating"),
    ("cleanliness", r"dirty|stain\w*|filthy|mou?ld\w*|λερωμ\w*|βρώμικ\w*|άπλυτ\w*|μουχλ\w*"),
    ("pests", r"cockroach\w*|bed ?bugs?|\bmice\b|κατσαρίδ\w*|κοριο\w*|ποντίκ\w*"),
    ("plumbing_major", r"no hot water|leak\w*|toilet\w* (?:was )?(?:blocked|broken)|ζεστό νερό|διαρρο\w*|τουαλέτα"),
    ("security_fault", r"(?:lock|door|safe) (?:was )?broken|broken (?:lock|door|safe)|κλειδαρι\w*|χρηματοκιβώτι\w*"),
    ("wifi", r"wi-?fi"),
    ("noise_internal", r"noisy neighbou?rs?|corridor noise|θόρυβ\w*"),
    ("staff_service", r"\brude\b|αγεν\w*"),
    ("food_beverage", r"breakfast was (?:poor|bad|cold)|πρωινό ήταν"),
)
RESOLVED = r"fixed|repaired|replaced|επισκεύασ\w*|διόρθωσ\w*|αντικατέστησ\w*|φτιάξ\w*"
PENDING = r"until (?:we|i) left|whole stay|never (?:fixed|worked)|μέχρι την αναχώρηση|όλη (?:τη|την) διαμονή|ποτέ δεν"


def keyword_findings(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with language (el where there is a Greek letter) and findings: for each kind the first sentence that names it, with resolved,
    pending or unclear as that sentence says."""
    found = lambda p: lambda s: F.rlike(s, F.lit(f"(?iuU){p}"))
    sentences = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!;?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    status = lambda s: F.when(found(RESOLVED)(s), "resolved").when(found(PENDING)(s), "pending").otherwise("unclear")
    r = rows.withColumn("__s", sentences)
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("excerpt"), status(s).alias("status"))
    first = [F.transform(F.slice(F.filter("__s", found(p)), 1, 1), named(kind)) for kind, p in KEYWORDS]
    language = F.when(F.rlike(F.col(text), F.lit("[Ͱ-Ͽ]")), "el").otherwise("en")
    return r.withColumns({"language": language, "findings": F.concat(*first)}).drop("__s")


def urgent_flags(types: Column, chosen: Column, order: list[str]) -> Column:
    """A review's types that the hotel set as urgent, in the catalogue's order."""
    return F.filter(F.array(*map(F.lit, order)), lambda t: F.array_contains(types, t) & F.array_contains(chosen, t))


def source_spans(text: str, longest: int = LONGEST) -> list[str]:
    """A review in numbered slices at its sentences and lines, each 3 to `longest` characters of the text as it is; what is too short
    joins the slice after it, or the last one."""
    edges = [m.end() for m in re.finditer(r"(?<=[.!?;])\s+|\n+", text)]
    slices, start = [], 0
    for end in [*edges, len(text)]:
        if len(text[start:end].strip()) >= 3:
            slices.append([start, end])
            start = end
    if not slices:
        slices = [[0, len(text)]]
    slices[-1][1] = len(text)
    out: list[str] = []
    for a, b in slices:
        rest = text[a:b].strip()
        while len(rest) > longest:
            most = longest - 3
            at = max((m.start() for m in re.finditer(r"\s+", rest[: most + 1]) if m.start() >= 3), default=most)
            if len(rest[at:].strip()) < 3:
                at = most
            out.append(rest[:at].rstrip())
            rest = rest[at:].lstrip()
        out += [rest] if rest else []
    return out


def with_spans(rows: DataFrame, text: str, most: int = 4000) -> DataFrame:
    """rows with spans (null where the text has fewer than 3 characters or more than `most`)."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: source_spans(t) if t is not None and 3 <= len(t.strip()) and len(t) <= most else None)

    return rows.withColumn("spans", cut(F.col(text)))
