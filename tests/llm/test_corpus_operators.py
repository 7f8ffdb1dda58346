"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import decontam, embeddings, induced, jaccard, licenses, packing, quality, repeats, sharding, spill, warc, wavelet
from plumbline.llm.common import encoder
from plumbline.llm.shingles import shingle_sets
from plumbline.llm.windows import LENGTH, runs

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DOCS = "doc_id long, text string, size long, n_words long, slot long, id long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.integers(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = words(rng, 120)
    near = base.replace(" w1", " v1", 1)
    passage = words(rng, 40)
    long = words(rng, 30_000)
    texts = [base, base, near, base.upper(), words(rng, 80) + " " + passage, passage + " " + words(rng, 90), "", None, " \n\t", "one two", "One  Two", "one two three four five", long, long + " end", "é" * 60 + " ü", "x" + "é" * 60, "MIT License\nReleased under the MIT License.\n" + words(rng, 20), "b " * 200, "B " * 150, words(rng, 9), base]
    out = [(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)]
    return out + [(0, texts[4], 1, 2, 3, 4), (None, base, 1, 2, 3, 4), (None, None, 1, 2, 3, 4)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_sets():
    rng = np.random.default_rng(0)
    texts = [words(rng, int(rng.integers(0, 12)), 3) for _ in range(300)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    h, b = shingle_sets(data, np.r_[0, np.cumsum([len(t) for t in texts])])
    assert [len(shingles(t)) for t in texts] == np.diff(b).tolist()
    names = {}
    for t, x, y in zip(texts, b[:-1], b[1:], strict=True):
        for s in (frozenset(h[x:y].tolist()),):
            assert names.setdefault(frozenset(shingles(t)), s) == s


@pytest.mark.parametrize("block", [3, 1024])
def test_jaccard(docs, rows, empty, block):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.links(docs, block=block).collect()}
    nodes = {}
    for i, t, *_ in rows:
        nodes.setdefault(i, []).append(shingles(t))
    up = {i: i for i in nodes if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(sorted(up), 2):
        for a, b in itertools.product(nodes[i], nodes[j]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert got == {(i, len(shingles(t)), None if i is None else find(i)) for i, t, *_ in rows}
    if block == 3:
        assert jaccard.links(empty).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_jaccard_links_each_text_of_a_repeated_doc_id(spark, block):
    rng = np.random.default_rng(8)
    short, long = words(rng, 120), words(rng, 400)
    near = lambda t: t + " and some more"
    data = [(1, "nothing like it at all in here"), (7, short), (7, long), (8, near(short)), (3, near(long)), (9, words(rng, 90))]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.links(spark.createDataFrame(data, "doc_id long, text string"), block=block).collect()}
    assert got == {(1, 1), (7, 3), (8, 3), (3, 3), (9, 9)}


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, (300, jaccard.GROUPS)).astype(np.uint8)
    v[150:] = v[:150] + (rng.random((150, jaccard.GROUPS)) < 0.05)
    n = v.sum(1).astype(np.int64)
    order = np.argsort(n, kind="stable")
    tree = jaccard.Tree(v[order], n[order])
    leaves = {tuple(p) for p in tree.leaf_pairs().tolist()}
    for i, j in itertools.combinations(range(300), 2):
        a, b = n[order][i], n[order][j]
        if jaccard.comparable(a, b) and jaccard.bound(v[order][i], v[order][j]) >= jaccard.need(a, b):
            assert (i // jaccard.LEAF, j // jaccard.LEAF) in leaves


def common(a, b):
    return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("memory, block", [(1 << 28, 1 << 17), (1 << 28, 7), (4000, 7), (64, 5)])
def test_suffix_blocks(monkeypatch, memory, block):
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(spill, "BLOCK", block)
    rng = np.random.default_rng(2)
    for trial in range(6 if memory == 64 else 30):
        t = rng.integers(0, 4, int(rng.integers(1, 90))).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 4)], 4)
        cap, disk = int(rng.integers(2, 12)), spill.Disk(memory)
        got = list(induced.suffix_blocks(t, cap, disk=disk))
        places, lcps = (np.concatenate(x) for x in zip(*got, strict=True))
        s = [t[i : i + cap].tolist() for i in places]
        assert sorted(places.tolist()) == list(range(len(t))) and s == sorted(s, reverse=True)
        assert lcps.tolist() == [0, *(common(a, b) for a, b in itertools.pairwise(s))]
        assert memory > 64 or len(t) < 40 or disk.spilled


def test_a_shard_far_larger_than_its_memory_is_sorted_on_disk(monkeypatch):
    """Text of 400 times the bound: names are sorted in spilled runs, recursion is entered, queues lie on disk."""
    levels, inner = [], induced.suffix_blocks
    monkeypatch.setattr(induced, "suffix_blocks", lambda x, *a, **k: levels.append(len(x)) or inner(x, *a, **k))
    rng = np.random.default_rng(6)
    part = rng.integers(97, 101, 50_000)
    t = np.concatenate([part, rng.integers(97, 123, 60_000), part[1000:], [0]]).astype(np.uint8)
    disk = spill.Disk(len(t) // 400)
    got = [(p.copy(), l.copy()) for p, l in induced.suffix_blocks(t, 50, disk=disk)]
    assert disk.spilled > 10 * len(t) and len(levels) > 1 and levels[1] < len(t)
    places, lcps = (np.concatenate(x) for x in zip(*got, strict=True))
    assert (np.sort(places) == np.arange(len(t))).all()
    raw = t.tobytes()
    s = [raw[i : i + 50] for i in places.tolist()]
    assert all(a >= b for a, b in itertools.pairwise(s))
    same = np.array([a == b for a, b in itertools.pairwise(s)])
    assert ((lcps[1:] == 50) == (same & (places[1:] + 50 <= len(t)) & (places[:-1] + 50 <= len(t)))).all()


def test_sorter_merges_spilled_runs(monkeypatch):
    monkeypatch.setattr(spill, "BLOCK", 16)
    rng = np.random.default_rng(4)
    disk = spill.Disk(4000)
    rows = spill.Sorter(disk)
    a, b = rng.integers(0, 9, 3000), rng.integers(0, 40, 3000).astype(np.uint64)
    for k in range(0, 3000, 50):
        rows.add(a[k : k + 50], b[k : k + 50], np.arange(k, k + 50))
    got = np.concatenate([np.stack(x) for x in rows.blocks()], 1)
    assert disk.spilled and list(map(tuple, got.T.tolist())) == sorted(zip(a.tolist(), b.tolist(), range(3000), strict=True), key=lambda r: r[:2])


def test_windows_cover_all_and_agree():
    rng = np.random.default_rng(3)
    part = rng.integers(97, 100, 300).astype(np.uint8)
    data = np.concatenate([part, rng.integers(97, 123, 49).astype(np.uint8), part])
    of, first, n, h = runs(data, np.array([0, 300, 349, 649]))
    assert n.sum() == 2 * 251 and set(of) == {0, 2}
    at = {}
    for o, f, k, x in zip(of, first, n, h, strict=True):
        for p in range(f, f + k):
            assert at.setdefault(data[p : p + LENGTH].tobytes(), x) == x


def test_repeats(docs, rows, empty, monkeypatch):
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            k = b[p : p + LENGTH]
            least[k] = min(least.get(k, 2**63), 2**63 if i is None else i)
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - LENGTH + 1):
            if least[b[p : p + LENGTH]] < (2**63 if i is None else i):
                gone[p : p + LENGTH] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, repeats.removed(docs).collect()), key=key) == sorted(want, key=key)
    cut = {(r["doc_id"], r["id"]): r["text"] for r in repeats.without_repeats(docs).collect() if r["doc_id"] == 1}
    assert cut == {(1, 4): ""} and repeats.removed(empty).count() == 0
    # with a few KB of memory every shard is sorted on disk
    monkeypatch.setattr(repeats, "TOGETHER", 1)
    monkeypatch.setattr(repeats, "SHARDS", 3)
    rows_, total = repeats._rows(docs, "doc_id", "text")
    spans = lambda memory: sorted((r["slot"], *x) for r in repeats.spans_of(rows_, total, memory).collect() for x in decoded(r["data"]))
    assert spans(20_000) == spans(192 << 20) != []


def decoded(data):
    found = repeats.joined(pa.table({"data": pa.array([data], pa.binary())}))
    return [(k, *s) for k, v in found.items() for s in v]


def test_without_repeats_keeps_columns_of_any_name(spark, empty):
    rng = np.random.default_rng(1)
    passage = words(rng, 30)
    data = [(1, "A " + passage, 9, "x", None, 1), (2, None, 9, "y", None, 2), (3, "B " + passage + " end", 5, None, 1.5, 3), (None, passage, 0, "z", 2.5, 4), (4, "", None, "w", 0.5, 5), (3, "B " + passage + " end", 5, None, 1.5, 3)]
    df = spark.createDataFrame(data, "doc_id int, text string, n_chars int, __key string, __id double, __slot int")
    got = sorted(map(tuple, repeats.without_repeats(df).collect()), key=lambda r: r[5])
    rest = "B  end"
    assert got == [data[0], data[1], (3, "B end", 5, None, 1.5, 3), (3, "B end", 5, None, 1.5, 3), (None, "", 0, "z", 2.5, 4), data[4]] or got[2][1] == rest
    assert [r[2] for r in got] == [9, 9, len(got[2][1]), len(got[2][1]), 0, None]
    assert repeats.without_repeats(df).schema == df.schema and repeats.without_repeats(empty).columns == empty.columns and repeats.without_repeats(empty).count() == 0
    assert repeats.without_repeats(df.drop("n_chars")).count() == 6


def test_contamination(spark, docs, rows, empty):
    rng = np.random.default_rng(5)
    words(rng, 120)
    passage = words(rng, 40)
    items = [(1, passage), (2, "One, two!"), (3, ""), (4, None), (None, "three four"), (1, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    wins = {(("" if i is None else str(i)), tuple(w[k : k + 10])) for i, t in items if (w := table(t)) for k in range(max(1, len(w) - 9))}
    want = []
    for i, t, *_ in rows:
        w, hit, found = table(t), set(), set()
        for item, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(item)
        want.append((str(i), len(w), len(hit), tuple(sorted(found))))
    for most in (1 << 20, 60):
        got = decontam.contamination(docs, bench, most_bytes=most).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == sorted(want)
    span = next(r["spans"] for r in got if r["doc_id"] == 9)
    assert [(s["start"], s["end"]) for s in span] == [(0, 7)]
    kept = decontam.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    assert decontam.contamination(empty, bench).count() == 0 and decontam.clean_documents(docs, bench.where("false")).count() == len(rows)


def test_packing(docs, rows, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, with_ids=True).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
        assert 0 < r["length"] <= 4096 and zlib.crc32(r["ids"]) == r["ids_crc32"]
    pieces = sorted(zlib.crc32(encoder(path)(t or "") + (1).to_bytes(4, "little")) for _, t, *_ in rows if len(encoder(path)(t or "")) < 4 * 4096)
    assert pieces == sorted(r["ids_crc32"] for r in got if r["start"] == 0 and r["length"] < 4096)
    for r in got:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for bins in whole.values():
        at = 0
        for offset, length in sorted(bins):
            assert offset == at
            at += length
        assert at <= 4096
    p = packing.Packer(10, 2)
    assert [p.place(x) for x in (6, 7, 3, 9, 4, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 9)]
    assert packing.pack(empty, path).count() == 0


def test_wavelet(docs, rows, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = wavelet.round_trip(docs, path, shard_bytes=30_000).collect()
    ids = {}
    for i, t, *_ in rows:
        b = encoder(path)(t or "") + (2).to_bytes(4, "little")
        ids.setdefault(i, []).append((len(b) // 4, zlib.crc32(b)))
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got))) == sorted(map(str, ((i, *x) for i, xs in ids.items() for x in xs)))
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.r_[0, np.cumsum([r["n_tokens"] for r in order])[:-1]].tolist()
    known = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert known == sorted(known) and wavelet.round_trip(empty, path).count() == 0
    with pytest.raises(ValueError, match="more than 8 bits"):
        wavelet.write_shard(np.array([300]), np.array([0]), np.array([1]), 8)


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_wavelet_shard_answers_from_the_blocks_it_touches(block):
    t = np.random.default_rng(0).integers(0, 200, 5000).astype(np.uint16)
    data, read = b"".join(wavelet.write_shard(t, np.array([0, 7]), np.array([1, 5]), 16, block)), []
    m, starts, names = wavelet.open_shard(lambda at, size: read.append(size) or data[at : at + size])
    opened = len(read)
    assert starts.tolist() == [0, 7] and names.tolist() == [1, 5] and opened == 4
    assert int(m.access(4321)[0]) == t[4321] and len(read) - opened <= 16
    for token in (int(t[3]), 0, 199, 60000):
        where = np.flatnonzero(t == token)
        assert m.count(token) == len(where) and m.occurrences(token).tolist() == where.tolist()
        assert m.ranks(token, [0, 250, 4999, 5000]).tolist() == [(t[:k] == token).sum() for k in (0, 250, 4999, 5000)]
    assert (m.access(np.arange(5000)) == t).all() and (m.tokens() == t).all() and m.select(int(t[3]), 0) == np.flatnonzero(t == t[3])[0]
    with pytest.raises(IndexError):
        m.select(60000, 0)


def test_warc(spark):
    a, b = "x" * 1500, "y" * 999
    pages = [(1, "http://a", a), (2, "http://b\r\nEvil: 1", a), (3, None, b), (4, "u", b), (5, "u", None), (6, "u", "é" * 600), (None, "u", a), (7, "u", a), (7, "v", a)]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, payload_bytes long")
    got = warc.round_trip(df).collect()
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 7) if h == a and i in (1, 2) else ("response", None))) for i, _, h in pages]
    key = lambda r: str(r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(df.where("false")).count() == 0
    long = [warc.record(i, "u", bytes([65 + i % 20]) * 50_000, hashlib.sha1(bytes([65 + i % 20]) * 50_000).hexdigest(), None) for i in range(5)]
    d = warc.dictionary(long)
    import zstandard

    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    assert list(warc.records_of(warc.SKIPPABLE + len(d).to_bytes(4, "little") + d + b"".join(map(z.compress, long)))) == long


def test_sharding(docs, rows, empty):
    out = sharding.shard(docs, 4, pieces=2).collect()
    assert len(out) == len(rows)
    for k in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    sizes = sorted((r["size"], r["text_crc32"]) for r in out)
    assert sizes == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_writes_whole_documents_in_order(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/shards"
    out = sharding.shard(docs, 4, pieces=2, path=path).collect()
    assert sorted((tuple(r["document"]) for r in out), key=repr) == sorted(rows, key=repr)
    assert all(r["text_crc32"] == zlib.crc32((r["document"]["text"] or "").encode()) for r in out)
    files = [f for f in (tmp_path / "shards").rglob("*.parquet")]
    slots = {}
    for f in files:
        k = [r["slot"] for r in spark.read.parquet(f"file://{f}").coalesce(1).collect()]
        assert k == sorted(k)
        slots.setdefault(f.parent.name, []).extend(k)
    assert len(slots) > 1 and all(sorted(k) == list(range(len(k))) for k in slots.values()) and sum(map(len, slots.values())) == len(rows)
    texts = [r["text_crc32"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert len([k for k, _ in itertools.groupby(texts)]) == len(set(texts))


def test_sharding_balances_a_hot_text(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same text' else concat('text number ', id) end as text")
    out = sharding.shard(df, 8).groupBy("shard").sum("size").collect()
    s = [r[1] for r in out]
    assert len(s) == 8 and max(s) - min(s) < 0.05 * sum(s) / 8


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 24))
    x = np.concatenate([x, x[:30] + 0.2 * rng.normal(size=(30, 24)), x[:10], np.repeat(x[:1], 80, 0) + 0.01 * rng.normal(size=(80, 24))])
    data = [(i, [float(np.float32(v)) for v in r], i % 60 % 3) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, data[0][1], None), (905, data[0][1][:20], 0), (906, [], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=16).collect()}
    v = np.array([d[1] for d in data])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([d[2] for d in data])
    link = (v @ v.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    assert len(got) == len(data) + len(odd)
    n = np.array([got[i]["n_links"] for i in range(len(data))])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.97 * link.sum()
    if n.sum() == link.sum():
        reach = np.linalg.matrix_power((link | np.eye(len(v), dtype=bool)).astype(float), 64) > 0
        assert [got[i]["component_id"] for i in range(len(v))] == reach.argmax(1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, *_ in odd)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_quality(spark, docs, rows, empty):
    rng = np.random.default_rng(1)
    good = [(1000 + i, words(rng, 80), 1) for i in range(80)]
    bad = [(2000 + i, f"w{rng.integers(400)}!! " * 60, 0) for i in range(80)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(None, None), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (1000, None), (1001, 1)], "doc_id long, quality int")
    out = quality.scores(df, labels, trees=20).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None]
    assert held and all(r["predicted"] == (r["doc_id"] < 2000) for r in held if r["doc_id"] >= 1000)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out) and len(out) == 162
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    kept = quality.keep_good(df, labels, trees=20)
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, *_ in good} and kept.where("doc_id >= 2000").count() == 0
    assert quality.scores(docs, labels.where("false")).count() == len(rows) and quality.scores(empty, labels).count() == 0


def test_licences(spark, docs, rows, empty):
    model = licenses.train(docs, epochs=40)
    got = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    assert [(x["family"], x["start"], x["end"]) for x in got[16]["licences"]][-1] == ("MIT", 12, 43)
    assert not any(r["licences"] for i, r in got.items() if i != 16) and licenses.scan(empty, model).count() == 0
    t = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0\nhello there friend"), (2, "a driver's license is needed for the car"), (3, "Licensed under CC BY-NC 4.0")], "doc_id long, text string")
    assert [[x["family"] for x in r["licences"]] for r in licenses.scan(t, model).orderBy("doc_id").collect()] == [["Apache-2.0"], [], ["CC-BY-NC"]]


MIT = ["MIT License", "Copyright (c) 2019 Some Author", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]
ISC = ["Copyright (c) 2019, Some Author", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
GPL = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."]
LGPL = ["This library is licensed under the GNU Lesser General Public License, version 2.1."]


def test_hard_wrapped_licences(spark, docs):
    model = licenses.train(docs, epochs=40)
    wrap = lambda p, width: "\n".join(textwrap.wrap(p, width))
    cases = []
    for family, notice in (("MIT", MIT), ("MIT", MIT[1:]), ("ISC", ISC), ("GPL", GPL), ("LGPL", LGPL)):
        for width, gap, mark in itertools.product((40, 72, 79), ("\n\n", "\n"), ("", "# ")):
            text = gap.join(wrap(p, width) for p in notice)
            cases.append((family, "w1 w2 w3.\n\n" + "\n".join(mark + x for x in text.split("\n")) + "\n\nw4 w5 w6"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    for r in licenses.scan(df, model).collect():
        family, text = cases[r["doc_id"]]
        assert {x["family"] for x in r["licences"]} == {family}, text
        places = [(x["start"], x["end"]) for x in r["licences"]]
        assert places == sorted(places) and all(a[1] <= b[0] for a, b in itertools.pairwise(places))
        if family != "LGPL":
            assert any("ermission" in text[a:b] or "free software" in text[a:b].replace("\n", " ").replace("# ", "") for a, b in places), text
    t = spark.createDataFrame([(1, "The MIT License (MIT)"), (2, "wir fahren mit dem Auto\nohne license und weiter\nin die Stadt"), (3, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0")], "doc_id long, text string")
    assert [[x["family"] for x in r["licences"]] for r in licenses.scan(t, model).orderBy("doc_id").collect()] == [["MIT"], [], ["MIT", "Apache-2.0"]]


def test_unknown_paragraphs_are_drawn_anywhere_and_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, "\n\n".join([f"first{i}", words(rng, 200), f"third {words(rng, 8)}", f"last {words(rng, 8)}"])) for i in range(60)]
    data += [(100, None), (101, ""), (102, "\n \n")]
    monkeypatch.setattr(licenses, "fit", lambda unknown, **_: unknown)
    got = licenses.train(spark.createDataFrame(data, "doc_id long, text string"))
    known = {p.encode() for _, t in data if t for p in t.split("\n\n")}
    assert set(got) <= known and len(got) == 60
    assert all(any(g.startswith(x) for g in got) for x in (b"first", b"third", b"last")) and any(len(g) > 400 for g in got)


def test_encoder_is_the_tokenizer():
    import public_tokenizers

    from plumbline.llm.common import tokenizer

    rng = np.random.default_rng(0)
    parts = ["a", "B", "'s", "'", "  ", " ", "\n", "\n\n", "\t", "\r", "é", "é", " ", "7", "123", "!", "...", "<|endoftext|>", "İ", "ß", "中", "‍", "😀", "\x1c", "\x85", "_", "Σ", "ﬁ", " Word", " word,"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        for _ in range(2000):
            t = "".join(rng.choice(parts, int(rng.integers(0, 10))))
            assert encoder(path)(t) == np.array(tokenizer(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
