"""Checks of frames, sheets, records and artefacts before anything is computed from them.

Each check is one aggregate or join that yields problems as rows, whatever their number; the functions that raise list at most
`MOST` of them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 60


class Refused(ValueError):
    """Input that is refused whole, with its first problems."""


def refuse(problems: DataFrame, what: str, column: str = "problem") -> None:
    """Raises where there is any problem; one job, MOST + 1 rows at most on the driver."""
    found = [r[0] for r in problems.select(column).orderBy(column).limit(MOST + 1).collect()]
    if found:
        more = f"\n... and {problems.count() - MOST} more" if len(found) > MOST else ""
        raise Refused(f"{what}: nothing is used\n" + "\n".join(found[:MOST]) + more)


def frame_problems(rows: DataFrame, text: str, label: str, labels: tuple) -> DataFrame:
    """(check_name, value): nulls, blank texts, labels outside the known ones, and how many of the known ones are missing."""
    t, y = F.col(text), F.col(label)
    counts = rows.agg(
        F.count_if(t.isNull() | y.isNull()).alias("null_values"),
        F.count_if(F.trim(t) == "").alias("blank_texts"),
        F.count_if(y.isNotNull() & ~y.isin(*labels)).alias("unknown_labels"),
        (F.lit(len(labels)) - F.countDistinct(F.when(y.isin(*labels), y))).alias("missing_labels"),
    )
    return counts.unpivot([], counts.columns, "check_name", "value")


def require_columns(rows: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in rows.columns]:
        raise Refused(f"missing columns {missing}")


def repeated_in_split(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(split, repeated): rows beyond the first of each key within a split."""
    n = rows.groupBy(split, key).agg(F.count("*").alias("n"))
    return n.groupBy(split).agg(F.sum(F.col("n") - 1).alias("repeated"))


def sheet_problems(sheet: DataFrame, expected: DataFrame, item: str, values: dict[str, tuple[str, ...]], done: str = "done") -> DataFrame:
    """(item, problem) of a filled sheet: every expected item once, no other, each column's value known, the done column yes.
    sheet: strings; expected: the items, as numbers."""
    raw = F.trim(F.coalesce(F.col(item), F.lit("")))
    number = F.when(F.rlike(raw, F.lit("^[0-9]+$")), raw.cast("long"))
    s = sheet.withColumn("raw", raw).withColumn("number", number)
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    wrong = [F.when(~clean(c).isin(*known), F.concat(F.lit(f"{c} is "), F.col(c))) for c, known in values.items()]
    per_row = F.array_compact(F.array(*wrong, F.when(clean(done) != "yes", F.lit("not done"))))
    rows = s.where("number is not null").select("number", F.explode(per_row).alias("problem"))
    seen = s.where("number is not null").groupBy("number").agg(F.count("*").alias("n"))
    e = expected.select(F.col(item).cast("long").alias("number"), F.lit(1).alias("known")).distinct()
    presence = seen.join(e, "number", "full_outer").select("number", F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "appears more than once"), F.when(F.col("known").isNull(), "not in the sample"), F.when(F.col("n").isNull(), "missing")))).alias("problem"))
    odd = s.where("number is null").select(F.lit(None).cast("long").alias("number"), F.concat(F.lit("no number: "), F.col("raw")).alias("problem"))
    return rows.unionByName(presence).unionByName(odd).withColumnRenamed("number", "item")


def marks(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """The sheet with labels that were written as 1.0 or 0.0 read as 1 and 0, and how many of a row's were."""
    t = {c: F.trim(F.col(c)) for c in columns}
    float_like = {c: t[c].isin("1.0", "0.0") for c in columns}
    out = sheet.withColumn("repaired", sum((F.coalesce(v, F.lit(False)).cast("int") for v in float_like.values()), F.lit(0)))
    return out.withColumns({c: F.when(float_like[c], F.substring(t[c], 1, 1)).otherwise(F.col(c)) for c in columns})


def multi_label_problems(sheet: DataFrame, drawn: DataFrame, item: str, types: list[str], text: str = "text") -> DataFrame:
    """(item, problem): the drawn items each once with the text drawn for them, cells empty, 0 or 1, done, and either a type or none.
    drawn: item, text_sha256."""
    cell = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    known = F.lit(True)
    for c in (*types, "none", "done"):
        known = known & cell(c).isin("", "0", "1")
    typed = F.lit(False)
    for c in types:
        typed = typed | (cell(c) == "1")
    none = cell("none") == "1"
    s = sheet.withColumn("sha", F.sha2(F.col(text), 256)).withColumn("found", F.lit(True)).withColumn("n", F.lit(1))
    j = s.join(drawn.select(item, "text_sha256"), item, "full_outer")
    here = F.coalesce(F.col("found"), F.lit(False))
    said = F.array_compact(F.array(
        F.when(~here, "missing"), F.when(here & F.col("text_sha256").isNull(), "not in the sample"), F.when(here & (F.col("sha") != F.col("text_sha256")), "another text"),
        F.when(here & ~known, "unknown value"), F.when(here & (cell("done") != "1"), "not done"), F.when(here & typed & none, "type and none"), F.when(here & ~typed & ~none, "neither type nor none"),
    ))
    rows = j.select(F.col(item).alias("item"), F.explode(said).alias("problem"))
    twice = sheet.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n")).where("n > 1").select("item", F.lit("appears more than once").alias("problem"))
    return rows.unionByName(twice)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join that raises where a key repeats on either side."""
    for side, rows in (("left", left), ("right", right)):
        if rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise Refused(f"{key} repeats in the {side} table")
    return left.join(right, key, "left")


def misaligned(a: DataFrame, b: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, problem) for what keeps two tables from being compared row by row: keys on one side alone, columns that differ."""
    l, r = a.select(key, F.struct(*columns, F.lit(1).alias("here")).alias("l")), b.select(key, F.struct(*columns, F.lit(1).alias("here")).alias("r"))
    j = l.join(r, key, "full_outer")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    said = F.array_compact(F.array(F.when(F.col("l").isNull(), "only right"), F.when(F.col("r").isNull(), "only left"), *(F.when(both & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(f"{c} differs")) for c in columns)))
    return j.select(key, F.explode(said).alias("problem"))


def manifest_problems(now: dict[str, str], recorded: dict[str, str]) -> list[str]:
    """How digests by name differ from the recorded ones."""
    return [f"{k}: {'missing' if k not in now else 'not recorded' if k not in recorded else 'changed'}" for k in sorted(now.keys() | recorded.keys()) if now.get(k) != recorded.get(k)]


def redrawn(rows: DataFrame, recorded: DataFrame, columns: list[str]) -> DataFrame:
    """(side, rows in it alone): a draw made again must equal the recorded one, repeated rows included; empty where it does."""
    a, b = rows.select(columns), recorded.select(columns)
    return a.exceptAll(b).select(F.lit("drawn").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("recorded").alias("side"), "*"))


def record_problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with problems: the names of the rules that a row breaks. A rule that is null for a row is broken."""
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))))


def cache_problems(cached: DataFrame, inputs: DataFrame, key: str, position: str, probabilities: str, model: str) -> DataFrame:
    """(key, problem) of cached upstream answers: the inputs' keys in their places, distributions that sum to 1, one model."""
    moved = misaligned(cached, inputs, key, position)
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    off = cached.where((F.abs(total - 1) > 1e-6) | F.exists(probabilities, lambda x: (x < 0) | (x > 1))).select(key, F.lit("no distribution").alias("problem"))
    first = cached.agg(F.min(model).alias("first"))
    other = cached.join(F.broadcast(first), F.col(model) != F.col("first")).select(key, F.lit("another model").alias("problem"))
    return moved.unionByName(off).unionByName(other)


def same(a, b, tolerance: float = 1e-9, at: str = "") -> list[str]:
    """Where two nested results differ: numbers up to a relative tolerance, everything else exactly; True is not 1."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k in sorted(a.keys() | b.keys(), key=str) for x in (same(a[k], b[k], tolerance, f"{at}.{k}") if k in a and k in b else [f"{at}.{k}: on one side"])]
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return [f"{at}: lengths {len(a)} and {len(b)}"] if len(a) != len(b) else [x for i, (u, v) in enumerate(zip(a, b, strict=True)) for x in same(u, v, tolerance, f"{at}[{i}]")]
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    fine = math.isclose(a, b, rel_tol=tolerance, abs_tol=0.0) or a == b if number(a) and number(b) else type(a) is type(b) and a == b
    return [] if fine else [f"{at}: {a!r} and {b!r}"]


def verified(stored: dict, recompute: dict[str, Callable[[], object]], tolerance: float = 1e-9) -> list[str]:
    """Where recorded results differ from those computed again."""
    return [x for k, f in recompute.items() for x in (same(stored[k], f(), tolerance, k) if k in stored else [f"{k}: not recorded"])]
