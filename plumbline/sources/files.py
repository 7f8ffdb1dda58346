"""Sources and sinks with declared schemas; validation comes as rows, and a bad file is refused whole."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from csv import reader as csv_reader
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv(spark: SparkSession, path, schema: T.StructType | str, rows: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.limit(rows) if rows else df


def csv_strings(spark: SparkSession, path) -> DataFrame:
    """All columns as strings, nothing read as missing, a byte order mark dropped from the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\x00", emptyValue="")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).na.fill("")


def sheet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one sheet; their columns must be the same."""
    frames = [csv_strings(spark, p) for p in paths]
    if len({tuple(f.columns) for f in frames}) > 1:
        raise ValueError("the sheets have different columns")
    return reduce(DataFrame.unionByName, frames)


def import_problems(reviews: DataFrame) -> DataFrame:
    """(reason, hotel_id, source, external_review_id) of reviews that an import refuses."""
    from plumbline.functions.text import looks_english

    key = ["hotel_id", "source", "external_review_id"]
    n = F.length(F.trim("text"))
    checks = {"missing": F.col("external_review_id").isNull() | F.col("text").isNull(), "length": ~n.between(3, 8000), "language": ~looks_english(F.col("text"))}
    bad = [reviews.where(F.coalesce(c, F.lit(False))).select(F.lit(k).alias("reason"), *key) for k, c in checks.items()]
    twice = reviews.groupBy(*key).count().where("count > 1").select(F.lit("repeated").alias("reason"), *key)
    hotels = reviews.select("hotel_id").distinct()
    many = hotels.crossJoin(hotels.agg(F.count("*").alias("k"))).where("k > 1").select(F.lit("hotels").alias("reason"), "hotel_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("external_review_id"))
    return reduce(DataFrame.unionByName, [*bad, twice, many])


REQUIRED = ("hotel_id", "source", "external_review_id", "text")


def import_reviews(reviews: DataFrame) -> DataFrame:
    """The reviews, or an error with the first problems; those of a file that was read by `numbered` name their lines."""
    if missing := [c for c in REQUIRED if c not in reviews.columns]:
        raise ValueError(f"missing columns: {missing}")
    problems = import_problems(reviews)
    if "line" in reviews.columns:
        key = ["hotel_id", "source", "external_review_id"]
        first = reviews.groupBy(*key).agg(F.min("line").alias("line"))
        problems = problems.join(first, key, "left").orderBy("line")
    bad = [r.asDict() for r in problems.limit(60).collect()]
    if bad:
        raise ValueError(json.dumps(bad, default=str))
    return reviews


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows as strings with line, the physical line on which each begins: 1 for the header. A quoted line break counts as a line.
    One file is read by one task: lines have numbers only from its start."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    header = rows.select(F.split(F.split("value", "\r?\n", 2)[0], ",").alias("h")).first()["h"]

    @F.pandas_udf("array<struct<line:int,cells:array<string>>>")
    def read(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            lines = csv_reader(io.StringIO(text, newline=""))
            found, at = [], 1
            for cells in lines:
                found.append((at, cells))
                at = lines.line_num + 1
            out.append([{"line": a, "cells": c} for a, c in found[1:]])
        return pd.Series(out)

    r = rows.select(F.explode(read("value")).alias("r"))
    return r.select("r.line", *(F.try_element_at("r.cells", F.lit(i + 1)).alias(h.strip().strip('"')) for i, h in enumerate(header)))


def loose_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole files as text, by their byte order mark or UTF-8, else as Latin-1."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 2))
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.coalesce(utf8, F.decode("content", "ISO-8859-1")))
    return raw.select("path", F.regexp_replace(text, "^\ufeff", "").alias("value"))


def paragraphs(texts: DataFrame, column: str = "value") -> DataFrame:
    """(source row, position, text): blank lines end a review, white space is collapsed."""
    r = texts.select("*", F.posexplode(F.split(F.col(column), r"\n\s*\n")).alias("position", "piece"))
    return r.select(*(c for c in texts.columns if c != column), "position", F.trim(F.regexp_replace("piece", r"(?U)\s+", " ")).alias("text")).where("text <> ''")


#: Headers of review columns.
REVIEW_HEADER = r"(?i)review|text|comment|κριτικ"


def review_column(df: DataFrame) -> str:
    """The column whose name says so, else the one with the longest texts."""
    named = [c for c, t in df.dtypes if t == "string" and re.search(REVIEW_HEADER, c)]
    if named:
        return named[0]
    texts = [c for c, t in df.dtypes if t == "string"]
    means = df.agg(*(F.avg(F.length(c)).alias(c) for c in texts)).first()
    return max(texts, key=lambda c: means[c] or 0)


def jsonl(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def catalogue(spark: SparkSession, entries: list[dict], departments: tuple[str, ...], priorities: tuple[str, ...] = ("urgent", "high", "normal")) -> DataFrame:
    """Problem types with priority, department and deadline, checked against each other."""
    bad = [e for e in entries if e.get("department") not in departments or e.get("priority") not in priorities or not e.get("type")]
    if bad or len({e["type"] for e in entries}) != len(entries):
        raise ValueError(f"catalogue: {bad or 'repeated types'}")
    return spark.createDataFrame(entries, "type string, label string, priority string, department string, deadline_hours int")


def digests(spark: SparkSession, path) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def digest_of_files(spark: SparkSession, path) -> str:
    """One digest over many files: of their names and digests in the order of names."""
    d = digests(spark, path).select(F.concat_ws("  ", "sha256", F.substring_index("path", "/", -1)).alias("line"), F.substring_index("path", "/", -1).alias("name"))
    return hashlib.sha256("\n".join(r["line"] for r in d.orderBy("name").toLocalIterator()).encode()).hexdigest()


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes beside the path and renames: readers see the old folder or the whole new one. A path that is there already is an error."""
    spark = df.sparkSession
    jvm, beside = spark.sparkContext._jvm, f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    df.write.format(form).save(beside)
    if not store.rename(source, target):
        store.delete(source, True)
        raise OSError(f"{path} could not be put in place")


def yaml_entries(text: str) -> list[dict]:
    """Entries of a catalogue written in YAML, where that library is at hand."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    found = yaml.safe_load(text)
    entries = found.get("types", []) if isinstance(found, dict) else found
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("the catalogue is no list of types")
    return entries


def assert_identity(spark: SparkSession, path: str, length: int, sha256: str) -> None:
    r = digests(spark, path).first()
    if r is None or (r["length"], r["sha256"]) != (length, sha256):
        raise ValueError(f"{path} is not the expected file")


def write_once(df: DataFrame, path: str, form: str = "parquet", *partition: str) -> None:
    w = df.write.mode("errorifexists").format(form)
    (w.partitionBy(*partition) if partition else w).save(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    write_once(df, path, "parquet", split)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    return spark.read.parquet(path).where(F.col(split) == name)


def json_report(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def findings_csv(df: DataFrame, path: str) -> None:
    """quotes joined by ' | ', one file, with a byte order mark so that spreadsheets read UTF-8."""
    out = df.withColumn("quotes", F.array_join("quotes", " | "))
    first, *rest = out.columns
    out.coalesce(1).select(F.col(first).alias("﻿" + first), *rest).write.mode("errorifexists").option("header", True).csv(path)


def wrapped_csv(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines that were quoted whole: the outer quotes undone, inner ones undoubled, then parsed."""
    inner = F.regexp_replace(F.regexp_extract(column, r'^"(.*)"\s*$', 1), '""', '"')
    text = F.when(F.rlike(column, F.lit(r'^".*"\s*$')), inner).otherwise(F.col(column))
    return lines.select(F.from_csv(text, schema).alias("r")).select("r.*")


def with_ordinal(df: DataFrame, *order: str, buckets: int = 256) -> DataFrame:
    """df with ordinal from 0 in the order of source columns, the first of them a number, date or timestamp; ties in all of them are
    numbered in any order. Rows are numbered within ranges of the first column, between approximate quantiles, and moved up by the
    counts of the ranges before, so no task orders the whole table. Nulls come first."""
    first = F.col(order[0])
    shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    bounds = sorted(set(df.agg(F.percentile_approx(first, shares, 10_000).alias("q")).first()["q"] or []))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= first)) if bounds else F.lit(0)
    r = df.withColumn("__bucket", F.when(first.isNull(), -1).otherwise(place))
    before = r.groupBy("__bucket").agg(F.count("*").alias("n")).select("__bucket", (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1
    return r.withColumn("__k", inner).join(F.broadcast(before), "__bucket").select(*df.columns, (F.col("__before") + F.col("__k")).cast("long").alias("ordinal"))
