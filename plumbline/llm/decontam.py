"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Normal form: A-Z lower-cased, words are runs of digits, letters a-z and bytes from 0x80, joined by single spaces. A
window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. A document word
inside any occurrence of a window is hit.

Defined cases: null texts have no words; items with null or empty text have no windows; repeated items count once for
each item_id, a null item_id counts as the empty string; an empty benchmark hits nothing; extra columns are ignored by
`contamination` and kept by `clean_documents`. Where the items exceed `most_bytes` they are dealt into several automata
of that size, each carried through the same scan, so the driver never holds more than one group at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, as_bytes, parts_for, text_bytes

#: Bytes that stand in no word become spaces; letters are lower-cased.
NORMAL = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in LOWER)
WINDOW = 10
MOST_BYTES = 64 << 20

_AUTOMATA: dict[str, object] = {}


def windows_of(text: bytes, window: int) -> set[bytes]:
    words = text.translate(NORMAL).split()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def patterns_of(rows: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Window, between spaces, as Latin-1 of its bytes -> (words in it, item ids)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in rows:
        for w in windows_of(text, window):
            found.setdefault(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, set()))[1].add(item)
    return {k: (n, sorted(items)) for k, (n, items) in found.items()}


def automaton(patterns: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in patterns.items():
        a.add_word(k, v)
    if patterns:
        a.make_automaton()
    return a


class Scan:
    """Counts and hits of one text."""

    def __init__(self, text: bytes, a):
        words = text.translate(NORMAL).split()
        self.n_words, self.items, self.hit = len(words), set(), np.zeros(0, bool)
        if not words or not len(a):
            return
        line = f" {b' '.join(words).decode('latin-1')} "
        spaces = None
        for end, (n, items) in a.iter(line):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                edges = np.zeros(len(words) + 1, np.int64)
            last = int(np.searchsorted(spaces, end))
            edges[last - n] += 1
            edges[last] -= 1
            self.items.update(items)
        if spaces is not None:
            self.hit = np.cumsum(edges[:-1]) > 0


def spans_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the original text for runs of hit words."""
    if not hit.any():
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    # the same white space that bytes.split() knows is all mapped to 32, so runs of other bytes are the words
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    run = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(run[::2], run[1::2], strict=True)]


def _cached(token: str, patterns):
    if token not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[token] = automaton(patterns)
    return _AUTOMATA[token]


def item_groups(benchmark: DataFrame, window: int, most_bytes: int, text: str, item_id: str):
    """Patterns for each group of items; one group where the items' texts stay below most_bytes."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    n = parts_for(2 * (total := text_bytes(rows, "t")), most_bytes) if (total := text_bytes(rows, "t")) > most_bytes else 1
    for k in range(n):
        group = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield patterns_of([(r["i"], r["t"].encode()) for r in group.collect()], window)


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (sorted ids), spans (byte spans of hit words in the original)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("binary").alias("mask"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for patterns in item_groups(benchmark, window, most_bytes, item_text, item_id):
        token = hashlib.sha256(repr(sorted(patterns.items())).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def scan(batches, token=token, shared=shared):
            a = None
            for batch in batches:
                a = a or _cached(token, shared.value)
                masks, counts, items = [], [], []
                for t, before, mask in zip(as_bytes(batch.column("text")), batch.column("items").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                    s = Scan(t, a)
                    hit = s.hit
                    if mask:
                        old = np.unpackbits(np.frombuffer(mask, np.uint8), count=s.n_words).astype(bool)
                        hit = old | hit if len(hit) else old
                    masks.append(np.packbits(hit).tobytes() if len(hit) and hit.any() else None)
                    counts.append(s.n_words)
                    items.append(sorted(s.items.union(before or ())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(masks, pa.binary()), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "mask", "n_words", "items"])

        out = out.mapInArrow(scan, schema)

    def finish(batches):
        for batch in batches:
            spans, hits = [], []
            for t, n, mask in zip(as_bytes(batch.column("text")), batch.column("n_words").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool) if mask else np.zeros(0, bool)
                hits.append(int(hit.sum()))
                spans.append([{"start": a, "end": b} for a, b in spans_of(t, hit)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return out.mapInArrow(finish, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents, all columns, that hold no window of any item."""
    out = docs
    at = docs.columns.index(text)
    for patterns in item_groups(benchmark, window, most_bytes, item_text, item_id):
        token = hashlib.sha256(repr(sorted(patterns.items())).encode()).hexdigest()
        shared = docs.sparkSession.sparkContext.broadcast(patterns)

        def keep(batches, token=token, shared=shared):
            a = None
            for batch in batches:
                a = a or _cached(token, shared.value)
                keeps = [not Scan(t, a).items for t in as_bytes(batch.column(at))]
                yield batch.filter(pa.array(keeps, pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
