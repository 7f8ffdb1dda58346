"""Operators without SQL against independent, naive versions; recall and accuracy where no exact answer exists."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import embeddings, licenses, packing, quality, sharding
from plumbline.llm.common import encoder, tokenizer


def naive_boost(x, y, trees, depth, rate, bins, l2, least):
    """Boosting by exhaustive search over rows, one node at a time, without histograms or arrays of nodes."""
    share = (sum(y) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for c in x.T]
    f, model = [base] * len(y), []

    def grow(rows, level, g, h):
        if level == depth:
            return rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + l2)
        gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None, None)
        for c in range(x.shape[1]):
            for cut in cuts[c]:
                left = [i for i in rows if x[i, c] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < least or ht - hl < least:
                    continue
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, c, cut)
        _, c, cut = best
        if c is None:  # every row goes left at all levels below
            return grow(rows, level + 1, g, h)
        return c, cut, grow([i for i in rows if x[i, c] <= cut], level + 1, g, h), grow([i for i in rows if x[i, c] > cut], level + 1, g, h)

    def walk(node, row):
        while isinstance(node, tuple):
            c, cut, low, high = node
            node = high if row[c] > cut else low
        return node

    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in f]
        tree = grow(list(range(len(y))), 0, [b - a for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-9) for a in p])
        model.append(tree)
        f = [v + walk(tree, row) for v, row in zip(f, x, strict=True)]
    return lambda rows: np.array([base + sum(walk(t, r) for t in model) for r in rows])


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trees_are_those_of_an_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 4)).round(2)
    y = (x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * rng.normal(size=120) > 0).astype(float)
    options = {"trees": 4, "depth": 3, "rate": 0.3, "bins": 8, "l2": 2.0, "least": 4.0}
    fresh = np.concatenate([x, rng.normal(size=(50, 4))])
    assert np.allclose(quality.fit(x, y, **options).log_odds(fresh), naive_boost(x, y, **options)(fresh), atol=1e-9)


def test_statistics_of_a_text_by_hand():
    s = dict(zip(quality.NAMES, quality.statistics(b"The cat sat. The dog!\n\nab ab"), strict=True))
    assert math.isclose(s["log_words"], math.log1p(7)) and math.isclose(s["distinct_words"], 5 / 7) and math.isclose(s["top_word"], 2 / 7)
    assert math.isclose(s["repeats"], 1 / 7) and math.isclose(s["lines"], 2 / 7) and math.isclose(s["exclamations"], 1 / 28) and math.isclose(s["short_words"], 5 / 7)


def naive_best_fit(lengths, size, most):
    """Open bins as a plain list; the fullest closes first, the best fit by search."""
    bins, made, out = [], 0, []
    for n in lengths:
        fits = [b for b in bins if size - b[1] >= n]
        if fits:
            b = max(fits, key=lambda b: b[1])
            # of equally full ones the last to get there
            b = [x for x in bins if x[1] == b[1]][-1]
        else:
            if len(bins) >= most:
                fullest = max(b[1] for b in bins)
                bins.remove([x for x in bins if x[1] == fullest][-1])
            b = [made, 0]
            made += 1
            bins.append(b)
        out.append((b[0], b[1]))
        bins.remove(b)
        b[1] += n
        if b[1] < size:
            bins.append(b)
    return out


def test_packer_is_the_naive_best_fit():
    rng = random.Random(1)
    for trial in range(60):
        size, most = rng.choice([8, 50, 300]), rng.choice([1, 2, 5, 64])
        lengths = [rng.randint(1, size) for _ in range(400)]
        p = packing.Packer(size, most)
        assert [p.place(n) for n in lengths] == naive_best_fit(lengths, size, most), trial


def test_packed_pieces_are_the_documents(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"word{rng.integers(900)}," for _ in range(n))
    data = [(i, text(int(n))) for i, n in enumerate([0, 1, 5, 40, 700, 1400, 2000, 3000, 9000] + [200] * 60)] + [(100, None), (None, "null id"), (3, text(40)), (4, "")]
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(4)
    got = packing.pack(df, path, with_ids=True, size=512).collect()
    t = tokenizer(path)
    want = sorted((str(i), np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in data)
    pieces = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        assert r["start"] == 512 * r["piece"] and r["length"] == len(r["ids"]) // 4 <= 512 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault((str(r["doc_id"]), r["piece"]), []).append(r["ids"])
    once = [w for w in want if sum(w[0] == v[0] for v in want) == 1]
    assert [(i, b"".join(pieces[i, k][0] for k in itertools.takewhile(lambda k: (i, k) in pieces, itertools.count()))) for i, _ in once] == once
    assert sum(len(r["ids"]) for r in got) == sum(len(x) for _, x in want)
    # one sequence more for each open bin and partition than the ids need, at most
    least = -(-sum(r["length"] for r in got) // 512)
    assert least <= len({r["sequence_id"] for r in got}) <= 1.15 * least + 1
    own = {i for i, _ in once}
    assert {r["length"] for r in got if str(r["doc_id"]) in own and (str(r["doc_id"]), r["piece"] + 1) in pieces} == {512}


def test_partitions_are_joined_up_to_their_bytes(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.range(2000).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 20) as text").repartition(50)
    few = packing.pack(df, path).select("sequence_id").distinct().count()
    many = packing.pack(df, path, partition_bytes=1000).select("sequence_id").distinct().count()
    assert few < many


@pytest.mark.parametrize("shards", [3, 8])
def test_shards_follow_the_cumulative_bytes(spark, shards):
    rng = np.random.default_rng(shards)
    data = [(i, "t" * int(rng.integers(0, 400)) + str(i % 300)) for i in range(1200)] + [(5000 + i, None) for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    out = sharding.shard(df, shards, pieces=2).select("doc_id", "size", "shard", "slot", "document.text").collect()
    key = {r["doc_id"]: r[1] for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(out, key=lambda r: (key[r["doc_id"]], r["doc_id"]))
    assert [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))] == [r["doc_id"] for r in order]
    total = sum(r["size"] for r in order)
    ends = np.cumsum([r["size"] for r in order])
    for k in range(1, shards):
        edge = max((e for e, r in zip(ends, order, strict=True) if r["shard"] < k), default=0)
        group = max(sum(r["size"] for r in order if r["text"] == t) for t in {r["text"] for r in order})
        assert abs(edge - total * k / shards) <= sharding.TOLERANCE * total / shards + group
    texts = [r["text"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert len([k for k, _ in itertools.groupby(texts)]) == len(set(texts))


@pytest.mark.parametrize(("width", "least"), [(64, 0.99), (256, 0.98), (768, 0.97)])
def test_recall_at_the_threshold(width, least):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(1500, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1)[:, None] * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1)[:, None]
    a, b = embeddings.codes(x), embeddings.codes(y)
    met = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any((1, 2))
    assert met.mean() >= least


def test_embedding_edges(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.93, math.sqrt(1 - 0.93**2), 0.0, 0.0]
    big, tiny = [1e300, 1e300, 0.0, 0.0], [1e-300, 1e-300, 0.0, 0.0]
    data = [(1, v, 0), (2, w, 0), (3, [0.92, math.sqrt(1 - 0.92**2), 0.0, 0.0], 1), (4, v, 1), (5, big, 2), (6, tiny, 2), (None, v, 0), (7, v, 3), (7, [0.0, 1.0, 0.0, 0.0], 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "'x' as spot", "2 as copies")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)
    by = {}
    for i, n, c, k in got:
        by.setdefault(i, []).append((n, c, k))
    exact = float(np.dot(w, v) / np.sqrt(np.dot(w, w))) >= 0.93
    assert (by[2][0][1] == 1) == exact and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)]
    assert by[5] == [(1, 5, True)] and by[6] == [(1, 5, False)] and len(got) == len(data)


STATED = {
    "MIT": ["This software is released under the MIT License, see LICENSE", "Distributed under the terms of the MIT license", "Code: MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction"],
    "Apache-2.0": ["The code is licensed under the Apache License 2.0", "This file is licensed under the Apache License, Version 2.0 only"],
    "GPL": ["This work is licensed under the GNU General Public License version 2", "It is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "CC-BY": ["The text is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["This page is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License"],
    "BSD": ["Released under the BSD 2-Clause License.", "Redistribution and use in source or binary form, with or without modification, are permitted provided that these conditions are met"],
    "MPL": ["This file is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ISC": ["Available under the ISC License."],
}
OTHER = ["My driver's license was renewed last week.", "The city grants a licence to sell food in the street.", "All of this is available to the public for free.", "Permission to enter the building was granted on Monday.", "The use of this area is free of charge for guests.", "You may not use the pool without a towel.", "Under the law of the land the king may grant it.", "The MIT campus is in Cambridge.", "A public domain name was registered by the company.", "The source of the river lies in the mountains.", "We redistribute the income of the fund every year.", "The library is open to the general public."]


def test_licence_statements_that_are_no_templates(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(OTHER * 5)], "doc_id long, text string")
    model = licenses.train(docs, epochs=60)
    rows = [(f, t) for f, ts in STATED.items() for t in ts] + [(None, t) for t in OTHER]
    assert not {t for _, t in rows} & {t for ts in licenses.TEMPLATES.values() for t in ts}
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    said = {r["doc_id"]: {x["family"] for x in r["licences"]} for r in licenses.scan(df, model).collect()}
    right = sum(said[i] == {f} for i, (f, _) in enumerate(rows) if f)
    claims = sum(bool(s) for s in said.values())
    assert right >= 0.8 * sum(f is not None for f, _ in rows) and right >= 0.95 * claims
    assert not any(said[i] for i, (f, _) in enumerate(rows) if f is None)


@pytest.mark.parametrize("agree", [0.3, 0.5, 0.8])
def test_paragraphs_without_the_needed_words_agree_with_nothing(agree):
    rng = random.Random(7)
    needed = licenses.Needed(agree)
    templates = [licenses.words_of(t.encode()) for ts in (licenses.TEMPLATES, licenses.HEADINGS) for x in ts.values() for t in x]
    pool = sorted({w for t in templates for w in t})
    spared = 0
    for _ in range(6000):
        t = rng.choice(templates)
        a = rng.randrange(len(t))
        words = t[a : a + rng.randint(1, 12)]
        words = [w for w in words if rng.random() < 0.8 or w in licenses.Needed.COMMON] + rng.choices(pool, k=rng.choice([0, 0, 1, 3]))
        words = [w for w in words if w not in needed.words] if rng.random() < 0.7 else words
        if words and not needed(set(words)):
            spared += 1
            assert all(licenses.agreement(f, words) < agree for f in licenses.FAMILIES), words
    assert spared > 300


def test_encoder_of_many_texts_is_that_of_each():
    import public_tokenizers

    rng = np.random.default_rng(5)
    parts = ["the", " and", " Word,", ".", " é;", "\n", "\t", "7", " x y", "", "ß.", "’", " ,.", "…,"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 12)))) for _ in range(500)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        ids, bounds = encoder(path).batch(data, offsets)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer(path).encode(t, add_special_tokens=False).ids, repr(t)
    assert re.fullmatch(r"\w+", "ok")


def test_planes_across_strips():
    """Strips part ids as one stable parting of the whole does, and reading undoes it."""
    import numpy as np

    from plumbline.llm import wavelet as W

    for n in (0, 1, W.STRIP - 1, W.STRIP, 2 * W.STRIP + 9):
        ids = np.random.default_rng(n).integers(0, 1 << 17, n)
        whole = ids
        for k, plane in zip(range(16, -1, -1), W.planes_of(ids, 17), strict=True):
            bit = (whole >> k & 1).astype(bool)
            assert (plane == np.packbits(bit, bitorder="little")).all()
            whole = np.concatenate([whole[~bit], whole[bit]])
        if n:
            assert (W.read_shard(b"".join(W.write_shard(ids, np.array([0]), np.array([5]), 17)))[0].tokens() == ids).all()
