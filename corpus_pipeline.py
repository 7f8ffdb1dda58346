"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns documents' columns, but for the
last, which returns the packed pieces. run() writes each stage as Parquet to the shared folder and reads it again.

1. quality: rejects documents that the classifier, learned from `labels`, scores below 0.3.
2. near_duplicates: of documents linked by 5-word shingles at a similarity of 0.75 or more the smallest doc_id stays.
3. repeats: cuts bytes covered by a 50-byte string that starts in a document with a smaller doc_id; n_chars follows.
4. decontamination: rejects documents that hold ten consecutive words of a `benchmark` item, or a shorter item whole.
5. packing: best-fit packing into sequences of 4096 tokens.

Defined cases, each by its operator's docstring: null and empty texts stay where the classifier keeps them, are linked and cut with
nothing, hold no item, and pack to their end id; rows that repeat a doc_id are judged each by its own text; rows with a null doc_id are
linked with nothing and count as larger than every other for repeats; an empty table gives empty stages; extra columns, whatever
their names, stay until packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, jaccard, packing, quality, repeats
from plumbline.llm.common import stored
from plumbline.llm.entries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier scores 0.3 or more; null and empty texts are scored like any other."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row or rows with the smallest doc_id; without shingles a text links with nothing."""
    return jaccard.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the repeats of documents with a smaller doc_id; null texts stay null."""
    return repeats.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item; null texts hold none."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of every document; null and empty texts are their end id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
