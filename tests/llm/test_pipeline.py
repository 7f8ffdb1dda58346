"""The corpus pipeline's stages against brute force, one after another, on rows with nulls, empty and repeated texts, clashing columns."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import decontam, jaccard, packing, quality, repeats
from plumbline.llm.common import encoder

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key string, x double, d int, slot long"


def words(rng, n, pool=300):
    return " ".join(f"w{rng.integers(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    item = words(rng, 14, 5000)
    base, passage = words(rng, 100), words(rng, 30)
    good = [base, base + " and so on", base, words(rng, 60) + " " + passage, passage + " " + words(rng, 60), words(rng, 40) + " " + item + " " + words(rng, 20), item.upper(), "", None, " \n", "two words", "ü" * 70 + words(rng, 30), words(rng, 3000)] + [words(rng, 50) for _ in range(60)]
    bad = ["buy!! " * 80 + words(rng, 3) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), f"k{i}", i / 2, i % 7, -i) for i, t in enumerate(good + bad)]
    rows += [(3, good[4], None, None, None, None, None, None, None), (None, base, "en", "s", 1, "k", 0.5, 1, 1), (None, None, None, None, None, None, None, None, None), (2, base, "en", "s2", len(base), "k2", 1.0, 2, -2)]
    labels = [(i, int(i < len(good)), 0) for i in range(len(rows)) if i % 3] + [(None, 1, 0), (4, None, 1)]
    return rows, labels, [("a", item), ("b", ""), ("c", None), (None, "never said before")]


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    rows, labels, items = data
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """Rows whose doc_id isn't linked, directly or by others, with a smaller one."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {i: [shingles(r[1]) for r in rows if r[0] == i] for i in ids}
    least = {i: i for i in ids}
    linked = [(a, b) for a, b in itertools.combinations(ids, 2) if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s, t in itertools.product(sets[a], sets[b]))]
    for _ in ids:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return [r for r in rows if r[0] is None or least[r[0]] == r[0]]


def cut(rows):
    first, top = {}, 2**63
    for r in rows:
        b = (r[1] or "").encode()
        for p in range(len(b) - 49):
            k = b[p : p + 50]
            first[k] = min(first.get(k, top), top if r[0] is None else r[0])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (top if r[0] is None else r[0]):
                gone[p : p + 50] = True
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        out.append((r[0], text, *r[2:4], len(text), *r[5:]) if gone.any() else r)
    return out


def clean(rows, items, window=10):
    table = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    said = {tuple(w[k : k + window]) for _, t in items if (w := table(t)) for k in range(max(1, len(w) - window + 1))}
    sizes = {len(x) for x in said}
    holds = lambda w: any(tuple(w[k : k + n]) in said for n in sizes for k in range(len(w) - n + 1))
    return [r for r in rows if not holds(table(r[1]))]


def test_stages_one_after_another(spark, data, folder):
    rows, _, items = data
    docs = corpus_pipeline.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "decontamination", "packing"]
    now = stages["quality"](spark, docs, folder)
    kept = sorted(map(tuple, now.collect()), key=repr)
    # the classifier's own decisions: those of its scores, row by row; the junk goes, the prose stays
    scored = {(r["doc_id"], r["predicted"]) for r in quality.scores(docs, corpus_pipeline.table(spark, folder, "labels")).collect()}
    assert now.columns == docs.columns and {r[0] for r in kept} == {i for i, p in scored if p}
    ids = [r[0] for r in kept]
    assert not any(r[1] and r[1].startswith("buy!!") for r in kept) and sum(i is not None and 13 <= i < 73 for i in ids) == 60
    for name, brute in (("near_duplicates", near), ("repeats", cut), ("decontamination", lambda r: clean(r, items))):
        now = spark.createDataFrame(kept, SCHEMA).repartition(4)
        now = stages[name](spark, now, folder)
        assert now.columns == docs.columns
        got = sorted(map(tuple, now.collect()), key=repr)
        kept = sorted(brute(kept), key=repr)
        assert got == kept, name
    path = corpus_pipeline.vocabulary("word_bpe_49k.json")
    packed = stages["packing"](spark, spark.createDataFrame(kept, SCHEMA), folder).collect()
    size = sum(len(encoder(path)(r[1] or "")) // 4 + 1 for r in kept)
    assert sum(r["length"] for r in packed) == size and len({(r["doc_id"], r["piece"], r["start"]) for r in packed}) >= len({r[0] for r in kept})
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in whole.collect()) == sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_on_empty_tables_and_clashing_names(spark, data, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
    labels = corpus_pipeline.table(spark, folder, "labels")
    docs = spark.createDataFrame([(1, "a b c", 1.0), (None, None, None), (2, "", 2.0)], "doc_id int, text string, x double")
    assert quality.keep_good(docs, labels.where("false")).schema.simpleString() == docs.schema.simpleString()
    assert quality.keep_good(docs, labels.where("false")).count() == 3  # without labels every score is one half
    twice = spark.createDataFrame([(5, "same text of a few words here", "p", 1, 2, 3), (4, "same text of a few words here", "q", 1, 2, 3), (None, "same text of a few words here", "r", 1, 2, 3), (9, None, "s", 1, 2, 3), (8, "", "t", 1, 2, 3)], "doc_id int, text string, component_id string, id int, a int, node int")
    assert sorted(r["component_id"] for r in jaccard.one_of_each(twice).collect()) == ["q", "r", "s", "t"]
    assert jaccard.one_of_each(twice).schema == twice.schema
    assert decontam.clean_documents(twice, corpus_pipeline.table(spark, folder, "benchmark").where("false")).count() == 5
    assert repeats.without_repeats(twice).schema == twice.schema and packing.pack(twice, corpus_pipeline.vocabulary("word_bpe_49k.json")).count() == 5


def test_near_duplicates_write_files_by_their_size(spark):
    """Few edges and documents go to few files, whatever the number of shuffle partitions; links are the same."""
    from pathlib import Path

    from plumbline.llm.common import local_path, shared_root

    base = [" ".join(f"w{(i * 7919 + k) % 5000}" for k in range(60)) for i in range(12)]
    docs = spark.createDataFrame([(i, base[i % 12] + (" tail" if i >= 24 else "")) for i in range(36)] + [(99, None)], "doc_id long, text string")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    root = Path(local_path(shared_root(spark)))
    before = set(root.glob("*"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = jaccard.one_of_each(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == [*range(12), 99]
        assert kept.rdd.getNumPartitions() <= 8
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    made = [len(list(d.glob("part-*"))) for d in set(root.glob("*")) - before]
    assert made and max(made) <= 8
