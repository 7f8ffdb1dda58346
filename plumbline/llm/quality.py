"""Quality classifier: histogram gradient-boosted trees over document statistics, in arrays that numpy walks.

Statistics come from whole texts in one pass. The trees learn on the driver from at most `sample` labelled rows (those
first in the order of a hash of doc_id, so the sample doesn't depend on partitions); that bound is a parameter. Trees
are complete binary trees of one depth, stored level by level, so a walk is `depth` vector steps over all rows.

Defined cases: null and empty texts have the statistics of no words and get a score like any other; rows of labels
without doc_id or label are ignored, of several labels of one doc_id the least counts; without labels, or with one
class only, the score is the smoothed share of label 1; repeated documents get equal scores; extra columns are ignored
by `scores` and kept by `keep_good`."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import LOWER, as_bytes, stored

SAMPLE = 20_000
THRESHOLD = 0.3
NAMES = ("log_bytes", "log_words", "word_length", "distinct_words", "top_word", "next_word", "repeats", "distinct_pairs", "upper", "digits", "marks", "exclamations", "non_ascii", "lines", "distinct_lines", "line_words", "stops", "capitals", "short_words", "long_words", "packed", "symbols", "spaces", "distinct_lower", "longest_word", "brackets")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "marks": b".,;:?!", "exclamations": b"!", "symbols": b"#$%&*+<=>@^_|~\\{}", "spaces": b" \t", "brackets": b"()[]<>{}\"'"}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _v in enumerate(_CLASSES.values()):
    _TABLE[list(_v), _k] = 1


def statistics(text: bytes) -> list[float]:
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [math.log1p(n)] + [0.0] * (len(NAMES) - 1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    top = sorted(counts.values())[-2:]
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digits, marks, bangs, symbols, spaces, brackets = (histogram @ _TABLE / n).tolist()
    lines = [x for x in text.split(b"\n") if x]
    lengths = list(map(len, words))
    lowered = text.translate(LOWER).split()
    pairs = len(set(zip(lowered, lowered[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(w), (n - w + 1) / w, len(counts) / w, top[-1] / w, (top[0] if len(top) > 1 else 0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, pairs / max(1, w - 1), upper, digits, marks, bangs,
        float(histogram[128:].sum()) / n, len(lines) / w, len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))),
        text.count(b". ") / w, sum(map(_UPPER.__getitem__, map(bytes.__getitem__, words, [0] * w))) / w,
        sum(x < 4 for x in lengths) / w, sum(x > 12 for x in lengths) / w, len(zlib.compress(text, 1)) / n, symbols, spaces,
        len(set(lowered)) / w, math.log1p(max(lengths)), brackets,
    ]


@dataclass
class Trees:
    """feature, cut: trees x inner nodes; leaf: trees x leaves; base: log-odds. A row goes right where its value > cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner if len(x) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Second-order boosting of the log loss; split gains from histograms of binned statistics."""
    share = (float(y.sum()) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    n, m = binned.shape
    width = bins
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    f, flat = np.full(n, base), binned + np.arange(m) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (m * width) + flat).ravel()
            gs = np.bincount(at, np.repeat(g, m), k * m * width).reshape(k, m, width).cumsum(2)
            hs = np.bincount(at, np.repeat(h, m), k * m * width).reshape(k, m, width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = -1
            for j, best in enumerate(gain.reshape(k, -1).argmax(1)):
                c, b = divmod(int(best), width)
                if gain[j, c, b] > 1e-6 and b < len(cuts[c]):
                    out.feature[t, first + j], out.cut[t, first + j] = c, cuts[c][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        out.leaf[t] = value
        f = f + value[leaf]
    return out


def _features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in as_bytes(batch.column("text"))], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {kind}, x array<double>")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(features: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", sample: int = SAMPLE, **options) -> Trees:
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("y"))
    # those first in the order of a hash, by a cut that leaves about `sample`, so that no partition sends more than it must
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    known = known.where(order < F.lit(int(min(1.0, sample / max(1, known.count())) * (1 << 30))))
    rows = features.join(known, "doc_id").orderBy(order, "doc_id").limit(sample).collect()
    if not rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.array([r["x"] for r in rows]), np.array([float(r["y"]) for r in rows]), **options)


def scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    features = stored(_features(docs, doc_id, text), "statistics")
    model = train(features, labels, doc_id=doc_id, **options)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(NAMES)) if batch.num_rows else np.zeros((0, len(NAMES)))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.mapInArrow(run, f"doc_id {kind}, score double, predicted int").select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold. Texts are read once: the documents are stored with their
    statistics, which the model learns from and scores."""

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in as_bytes(batch.column("d").field(text))]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(x, pa.list_(pa.float64()))], names=["d", "x"])

    whole = docs.select(F.struct(*docs.columns).alias("d"))
    schema = T.StructType([*whole.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    held = stored(whole.mapInArrow(run, schema), "statistics")
    model = train(held.select(F.col("d")[doc_id].alias("doc_id"), "x"), labels, doc_id=doc_id, **options)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy().reshape(len(x), len(NAMES))) if len(x) else [], pa.float64())

    return held.where(score("x") >= threshold).select("d.*")
