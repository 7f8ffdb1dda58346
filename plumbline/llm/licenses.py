"""Licence scan: a trained paragraph classifier, then a comparison with the templates.

Paragraphs are the lines of a text and the runs of consecutive lines that hold words, joined, so that hard-wrapped notices
are read whole; both are cut at sentences. Lines stand where they agree alone; a joined paragraph takes the place of its
fragments where it shares more with a template than they do and loses that without them. Sparse features are hashed
1- to 3-grams of lower-cased words, numbers reduced to one sign, weighted to unit length. A softmax over the licence
families and one class for everything else is fitted on the driver by gradient steps: on variants of the templates (names,
versions, wording around them, cut-outs) and, for the class of everything else, on a bounded sample of the corpus's own
paragraphs that hold no licence word, beside scrambled templates. Its temperature is set on held-out variants, and the
least probability for a family is the one that held-out paragraphs of the unknown class don't reach. A prediction counts
only where the share of a template's n-grams in the paragraph, or of the paragraph's in the template, confirms it; for
headings, which are short, it is the share of both together.

Defined cases: null and empty texts have no paragraphs; long paragraphs are read whole; repeated documents give repeated
rows; an empty table gives no rows; extra columns are ignored."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes

#: How the families are stated in files and documents.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Released under the Apache 2.0 license"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2", "You should have received a copy of the GNU General Public License along with this program."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD License"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0", "Available under the CC BY license", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0", "Available under the CC BY-NC license"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
}
#: Headings of licence files.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "Apache-2.0": ["Apache License", "Apache License, Version 2.0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1"],
    "BSD": ["BSD License", "BSD 3-Clause License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0": ["CC0 1.0 Universal"],
    "ISC": ["ISC License"],
    "Unlicense": ["The Unlicense"],
}
FAMILIES = list(TEMPLATES)
BITS = 16
SAMPLE = 5_000
HOLDS_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]")
#: A line that names the owner; it belongs to no licence's wording.
OWNER = re.compile(rb"\W*copyright\s*(?:\(c\)|\xc2\xa9|[12][0-9]{3})", re.I)
WORDS = re.compile(rb"[a-z]+|[0-9][0-9.]*|[^\x00-\x7f]+")
CUT = re.compile(rb"(?<=[.!?])\s+(?=[A-Z])")
HINT = re.compile(rb"licen[cs]e|redistribut|copyright|warrant|permission|public domain|free software|spdx|creative commons|\bcc[ -]?(?:by|0)", re.I)


def words_of(paragraph: bytes) -> list[bytes]:
    return [b"0" if w[:1].isdigit() else w for w in WORDS.findall(paragraph.lower())]


def grams(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def vector(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.unique(np.fromiter((zlib.crc32(g) & (1 << BITS) - 1 for g in grams(words)), np.int64))
    return at, np.full(len(at), 1 / np.sqrt(max(1, len(at))))


class Model:
    """weights: 2**BITS x (families + 1); the last class is everything else."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.5):
        self.weights, self.bias, self.temperature, self.least = weights, bias, temperature, least

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        at, v = vector(words)
        z = (v @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


_TEMPLATE_GRAMS = {f: [grams(words_of(t.encode())) for t in ts] for f, ts in TEMPLATES.items()}
_HEADING_GRAMS = {f: [grams(words_of(t.encode())) for t in ts] for f, ts in HEADINGS.items()}


def best(family: str, words: list[bytes]) -> tuple[float, int]:
    """(agreement, shared n-grams) with the template or heading that agrees best."""
    g = grams(words)
    if not g:
        return 0.0, 0
    full = [(max(n / len(t), n / len(g) if 2 * len(g) >= len(t) else 0.0), n) for t in _TEMPLATE_GRAMS[family] for n in (len(g & t),)]
    return max([*full, *((len(g & t) / len(g | t), len(g & t)) for t in _HEADING_GRAMS[family])], default=(0.0, 0))


def agreement(family: str, words: list[bytes]) -> float:
    """The best share of a template's n-grams found in the paragraph, or of the paragraph's found in the template where that
    is at least half as long as the template; with a heading, of those in both among those in either."""
    return best(family, words)[0]


def variants(rng: np.random.Generator, each: int) -> tuple[list[list[bytes]], list[int]]:
    """Template variants for the families, scrambled templates for the last class."""
    around = ["", "Copyright 2019 The Authors.", "All rights reserved.", "Code and data:", "See the file for details.", "Note that"]
    xs, ys = [], []
    for k, (_, ts) in enumerate(TEMPLATES.items()):
        for t in ts:
            base = words_of(t.encode())
            for i in range(each):
                w = list(base)
                if i and rng.random() < 0.5:
                    w = words_of(rng.choice(around).encode()) + w
                if i and rng.random() < 0.5:
                    w = w + words_of(rng.choice(around).encode())
                if i and len(w) > 12 and rng.random() < 0.3:
                    cut = int(rng.integers(1, len(w) // 3))
                    w = w[:-cut] if rng.random() < 0.5 else w[cut:]
                xs.append(w)
                ys.append(k)
            xs.append([base[i] for i in rng.permutation(len(base))][: max(2, len(base) // 2)])
            ys.append(len(FAMILIES))
        for t in HEADINGS[FAMILIES[k]]:
            xs += [words_of(t.encode())] * each
            ys += [k] * each
    return xs, ys


def fit(unknown: list[bytes], *, seed: int = 3, epochs: int = 60, rate: float = 8.0, each: int = 8) -> Model:
    rng = np.random.default_rng(seed)
    xs, ys = variants(rng, each)
    other = [w for p in unknown if (w := words_of(p))]
    hard = ["a license to operate", "the driver's license", "copyright law in general", "permission was not granted", "public domain of a function", "free software movement"]
    other += [words_of(h.encode()) for h in hard]
    xs, y = xs + other, np.array(ys + [len(FAMILIES)] * len(other))
    held = rng.random(len(xs)) < 0.2
    vectors = [vector(w) for w in xs]
    size = np.array([len(v[0]) for v in vectors])
    rows, cols, vals = np.repeat(np.arange(len(xs)), size), np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
    used, cols = np.unique(cols, return_inverse=True)
    n_class = len(FAMILIES) + 1
    w, b = np.zeros((len(used), n_class)), np.zeros(n_class)
    weight = (1 / np.bincount(y, minlength=n_class))[y] * ~held
    weight /= weight.sum()
    onehot = np.eye(n_class)[y]

    def logits():
        z = np.zeros((len(xs), n_class))
        for k in range(n_class):
            z[:, k] = np.bincount(rows, vals * w[cols, k], len(xs))
        return z + b

    for _ in range(epochs):
        z = logits()
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (onehot - p) * weight[:, None]
        for k in range(n_class):
            w[:, k] += rate * n_class * np.bincount(cols, vals * d[rows, k], len(used))
        b += rate * d.sum(0)
    z = logits()
    best = min(np.geomspace(0.1, 3, 25), key=lambda t: -np.log(np.maximum(_softmax(z[held] / t)[np.arange(held.sum()), y[held]], 1e-12)).sum() if held.any() else 0)
    p = _softmax(z[held] / best)[y[held] == len(FAMILIES)][:, :-1].max(1, initial=0) if held.any() else np.zeros(0)
    full = np.zeros((1 << BITS, n_class))
    full[used] = w
    return Model(full, b, float(best), float(min(0.9, max(0.5, np.quantile(p, 0.999) if len(p) else 0.5))))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def blocks(text: bytes):
    """Runs of consecutive lines that hold words, each a list of (start, end) bytes; a line that names the owner stands alone."""
    at, run = 0, []
    for line in text.split(b"\n"):
        owner = OWNER.match(line)
        if run and (owner or not HOLDS_WORD.search(line)):
            yield run
            run = []
        if owner:
            yield [(at, at + len(line))]
        elif HOLDS_WORD.search(line):
            run.append((at, at + len(line)))
        at += len(line) + 1
    if run:
        yield run


def sentences(text: bytes, start: int, end: int):
    """(start, end) bytes of the sentences between two places."""
    last = start
    for m in CUT.finditer(text, start, end):
        yield last, m.start()
        last = m.end()
    yield last, end


def paragraphs(lines: list[tuple[int, int]], text: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the sentences of each line, and of those sentences of the joined lines that aren't among them."""
    single = [s for a, b in lines for s in sentences(text, a, b)]
    known = set(single)
    return single, [s for s in sentences(text, lines[0][0], lines[-1][1]) if s not in known] if len(lines) > 1 else []


def judged(text: bytes, start: int, end: int, model: Model, agree: float) -> dict | None:
    words = words_of(text[start:end])
    if not needed(agree)(set(words)):
        return None
    p = model.probabilities(words)
    k = int(p[:-1].argmax())
    if p[k] >= model.least and p[k] > p[-1]:
        s, shared = best(FAMILIES[k], words)
        if s >= agree:
            return {"start": start, "end": end, "family": FAMILIES[k], "probability": float(p[k]), "agreement": s, "shared": shared}
    return None


def in_block(text: bytes, lines: list[tuple[int, int]], model: Model, agree: float) -> list[dict]:
    single, joined = paragraphs(lines, text)
    hits = [h for a, b in single if (h := judged(text, a, b, model, agree))]
    for a, b in joined:
        if not (whole := judged(text, a, b, model, agree)):
            continue
        inside = [h for h in hits if h["start"] < b and a < h["end"]]
        at, rest = a, []
        for h in inside:
            rest += words_of(text[at : max(at, h["start"])])
            at = max(at, h["end"])
        rest += words_of(text[at : max(at, b)])
        # statements of their own share little with its template; the lines beside them are read again below
        alone, lost = sum(h["shared"] for h in inside), whole["shared"] - best(whole["family"], rest)[1]
        if whole["shared"] > alone and 2 * lost > alone or not inside:
            hits = sorted([h for h in hits if h not in inside] + [whole], key=lambda h: h["start"])
    run, out = [], list(hits)
    for a, b in [*lines, (-1, -1)] if hits else []:
        if a >= 0 and not any(h["start"] < b and a < h["end"] for h in hits):
            run.append((a, b))
            continue
        if len(run) > 1:
            out += in_block(text, run, model, agree)
        run = []
    return out


def found(text: bytes, model: Model, agree: float) -> list[dict]:
    out = [h for lines in blocks(text) for h in in_block(text, lines, model, agree)]
    return [{k: v for k, v in h.items() if k != "shared"} for h in sorted(out, key=lambda h: (h["start"], h["end"]))]


def train(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE, **options) -> Model:
    """Unknown paragraphs: one from each of at most `sample` documents, by the order of a hash of the text; of the paragraphs
    that `scan` judges in it the one whose place the hash draws, whole."""
    order = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    # a cut that leaves about `sample` rows, so that no partition sends more than it must
    cut = int(min(1.0, sample / max(1, docs.count())) * (1 << 30))
    rows = docs.where(F.col(text).isNotNull() & (order < F.lit(cut))).select(F.col(text).alias("t"), order.alias("h"))

    def draw(batches):
        for batch in batches:
            h, drawn = [], []
            for k, t in zip(batch.column("h").to_pylist(), as_bytes(batch.column("t")), strict=True):
                if spans := [s for lines in blocks(t) for part in paragraphs(lines, t) for s in part]:
                    a, b = spans[zlib.crc32(t) % len(spans)]
                    h.append(k)
                    drawn.append(t[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(drawn, pa.binary())], names=["h", "p"])

    drawn = rows.select(F.col("h").cast("long").alias("h"), F.col("t").cast("string").alias("t")).mapInArrow(draw, "h long, p binary")
    got = [bytes(r["p"]) for r in drawn.orderBy("h", "p").limit(sample).collect()]
    return fit([g for g in got if not HINT.search(g)], **options)


SPANS = "array<struct<start:long,end:long,family:string,probability:double,agreement:double>>"


def scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", agree: float = 0.5) -> DataFrame:
    """doc_id, n_paragraphs (its lines), licences (byte spans with family, probability and agreement) for every document.

    A paragraph that lacks the words with which it could agree with any template (Needed) skips the model, which changes no result: no
    prediction for it would be confirmed."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())])

    def run(batches):
        for batch in batches:
            n, spans = [], []
            for t in as_bytes(batch.column("text")):
                n.append(t.count(b"\n") + 1 if t else 0)
                spans.append(found(t, shared.value, agree) if needed(agree).text(t) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(struct))], names=["doc_id", "n_paragraphs", "licences"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_paragraphs long, licences {SPANS}")


LETTERS = bytes(b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
DIGIT = re.compile(rb"[0-9]")


class Needed:
    """Words without which a paragraph can't agree with any template: one of `words`, or for one of `groups` so many of its words.

    With agreement `agree` a paragraph shares at least agree / 2 of a template's n-grams: it holds that share of them, or that share of
    its own n-grams are the template's and it has half as many at least; with a heading it is more. So rare words are taken from each
    template, the longest first, until the n-grams free of them are too few. Where common words alone still make up enough, the
    group is of the words in these n-grams, with the least number of them that any n-grams enough can be made of."""

    #: Too frequent to be worth a search.
    COMMON = frozenset(b"the of and in to a is this you it for by with or be on as at an any are that from can may not without use all see no under".split())

    def __init__(self, agree: float):
        # (words, their n-grams, how many of them an agreeing paragraph holds at least)
        every = [(w, grams(w), agree * len(grams(w)) / half) for ts, half in ((TEMPLATES, 2), (HEADINGS, 1)) for f in FAMILIES for w in (words_of(t.encode()) for t in ts[f])]
        chosen: set[bytes] = set()
        free = lambda own: [g for g in own if chosen.isdisjoint(g.split(b" "))]
        for words, own, least in every:
            for w in sorted(set(words) - self.COMMON - {b"0"}, key=lambda w: (w not in chosen, -len(w), w)):
                if len(free(own)) < least:
                    break
                chosen.add(w)
        groups = set()
        for _, own, least in every:
            rest = [frozenset(g.split(b" ")) for g in free(own)]
            if len(rest) >= least:
                common = frozenset().union(*rest)
                groups.add((common, next(k for k in range(len(common) + 1) if any(sum(g <= set(some) for g in rest) >= least for some in itertools.combinations(common, k)))))
        self.words, self.groups = frozenset(chosen), tuple(groups)
        if any(k < 1 or any(w != b"0" and not (w.isalpha() and w.isascii()) for w in own) for own, k in groups):
            raise ValueError("a template has no words that tell whether a paragraph may agree with it")

    def __call__(self, words: set[bytes]) -> bool:
        return not self.words.isdisjoint(words) or any(len(own & words) >= k for own, k in self.groups)

    def text(self, text: bytes) -> bool:
        """Whether any paragraph of a text can."""
        words = set(text.translate(LETTERS).split())
        if DIGIT.search(text):
            words.add(b"0")
        return self(words)


_NEEDED: dict[float, Needed] = {}


def needed(agree: float) -> Needed:
    if agree not in _NEEDED:
        _NEEDED[agree] = Needed(agree)
    return _NEEDED[agree]
