"""What the training-data operators share: scratch tables, text chunks, tokenizer caches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one is set, on one machine alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder. The folder is scratch space; whoever owns it empties it after the job."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """A mounted path for a file: URI of the shared folder; other stores go through pyarrow's file systems."""
    return re.sub(r"^file:/*", "/", uri)


def write_file(uri: str, parts: list[bytes]) -> None:
    """Writes one file whole: to a name of its own first, then renamed, so a retried task leaves one good copy."""
    if uri.startswith(("file:", "/")):
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}.part"
        with open(temporary, "wb") as out:
            for x in parts:
                out.write(x)
        os.replace(temporary, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(temporary) as out:
            for x in parts:
                out.write(x)
        store.move(temporary, path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column without a copy for each row; null becomes empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def table_of(batches) -> pa.Table | None:
    """All batches of a partition; None where it has no rows."""
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def lean(run):
    """run over a partition, after which the worker returns the memory that it freed to the system."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # no glibc
            pass

    return wrapped


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def text_bytes(df: DataFrame, *columns: str) -> int:
    """UTF-8 bytes of the columns over all rows."""
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0)).alias("b")).first()["b"])


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-total // each))


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """One tokenizer for each worker process; strings of special tokens in a text are ordinary text."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


class Cache(dict):
    """Two generations of about `most` entries each: when the young one is full it becomes the old one, so frequent keys stay."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


def _flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


class Encoder:
    """ids of whole texts, exactly as the tokenizer gives them, from pieces that it treats apart, many texts at once.

    A piece is a run of spaces and line feeds with the other characters that follow it, and ends between a Latin letter and a
    mark. Byte-level BPE with the common pattern never puts a character and the white space after it into one token, nor a letter
    and a mark, and word BPE drops white space, so the ids of a text are those of its pieces. Arrow finds the different pieces of
    a few MB of text; each is looked up once. Texts with any other white space are encoded whole.
    A piece that isn't cached goes through the tokenizer's own model, word by word; words that aren't plain come from its normalizer and
    pre-tokenizer. Where a probe shows that a tokenizer treats plain pieces otherwise, they do as well."""

    #: White space, Latin letters: in such a piece the pre-tokenizers' words can be read off.
    PLAIN = re.compile("([ \\n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)").fullmatch
    LETTER, MARK, SPACE = _flags([*range(65, 91), *range(97, 123)]), _flags(b".,!?;:"), _flags(b" \n")
    #: First bytes of other white space and of characters without width.
    RARE = _flags([9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
    #: Fixed values of byte-level BPE: bytes that stand for themselves; the others stand as U+0100 and on, in their order.
    SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]

    def __init__(self, path: str, most: int = 200_000):
        t = tokenizer(path)
        self.encode, self.tokenize = t.encode, t.model.tokenize
        if hasattr(t.model, "_resize_cache"):
            t.model._resize_cache(0)  # the pieces are cached here
        self.normalize, self.divide = t.normalizer and t.normalizer.normalize_str, t.pre_tokenizer.pre_tokenize_str
        self.pieces = Cache(self._piece, most)
        others = [b for b in range(256) if b not in set(self.SELF)]
        self.letters = {b: 256 + i for i, b in enumerate(others)}
        self.byte_level = t.normalizer is None
        probe = "Ab\u00c9 cd, ef\ngh!? \u00e9; ij.kl"
        self.plain = True
        self.plain = self(probe) == self._ids(probe)
        self.pieces.clear()
        self.pieces.old = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [x.id for x in self.tokenize(word)]).tobytes()

    def _mapped(self, word: str) -> str:
        return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.plain and (m := self.PLAIN(text)):
            space, word = m.groups()
            if not self.byte_level:
                return self._word(self._mapped(word.lower()))
            if space == " ":
                return self._word("\u0120" + self._mapped(word))
            return self._word(self._mapped(space)) + self._word(self._mapped(word)) if space else self._word(self._mapped(word))
        if self.normalize:
            text = self.normalize(text)
        return b"".join([self._word(word) for word, _ in self.divide(text)])

    def _found(self, words: list[bytes]) -> list[bytes]:
        """ids of each piece, from the cache or the model."""
        young, old, tokenize = self.pieces, self.pieces.old, self.tokenize
        found = list(map(young.get, words))
        if not self.plain:
            return [young[w] if v is None else v for w, v in zip(words, found, strict=True)]
        for k in [k for k, v in enumerate(found) if v is None]:
            w = words[k]
            v = old.get(w)
            if v is None:
                # the bulk of new pieces: a space and ASCII letters
                if w[0] == 32 and (rest := w[1:]).isalpha():
                    v = array("I", [x.id for x in tokenize("\u0120" + rest.decode() if self.byte_level else rest.lower().decode())]).tobytes()
                else:
                    v = self._piece(w)
            found[k] = v
            if len(w) <= 64:
                young[w] = v
        self.pieces.turn()
        return found

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold white space other than space and line feed, or characters without width."""
        at = np.flatnonzero(self.RARE[data])
        if not len(at):
            return at
        n = len(data)
        x, y, z = data[at], data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
        two = (x < 32) | (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        wide = (x == 0xE2) & ((y == 0x80) & ((z <= 0x8F) | (z >= 0xA8) & (z <= 0xAF)) | (y == 0x81) & (z >= 0x9F) & (z <= 0xA4))
        single = (x == 0xE1) & ((y == 0x9A) & (z == 0x80) | (y == 0xA0) & (z == 0x8E)) | (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xEF) & (y == 0xBB) & (z == 0xBF)
        return np.unique(np.searchsorted(offsets, at[two | wide | single], "right") - 1)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 bounds) of n texts, given as their bytes and offsets."""
        n, texts = len(data), len(offsets) - 1
        if not n:
            return np.zeros(0, "<u4"), np.zeros(texts + 1, np.int64)
        space = self.SPACE[data]
        begins = np.zeros(n, bool)
        begins[1:] = space[1:] & ~space[:-1]
        if self.plain:
            letter = self.LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            begins[1:] |= self.MARK[data[1:]] & letter[:-1]
        for k in (whole := self._whole(data, offsets)):
            begins[offsets[k] : offsets[k + 1]] = False
        filled = offsets[:-1][np.diff(offsets) > 0]
        begins[filled] = True
        at = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, n)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which, words = pieces.indices.to_numpy(), pieces.dictionary.to_pylist()
        if len(whole):
            special = set(which[np.searchsorted(at, offsets[whole])].tolist())
            found = iter(self._found([w for k, w in enumerate(words) if k not in special]))
            found = [self._ids(w.decode()) if k in special else next(found) for k, w in enumerate(words)]
        else:
            found = self._found(words)
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), "<u4")
        del words, found
        count = size[which]
        ends = np.cumsum(count)
        ids = ids[np.repeat((np.cumsum(size) - size)[which] - (ends - count), count) + np.arange(int(ends[-1]))]
        first = np.searchsorted(at, offsets)
        return ids, np.append(0, ends)[first]

    def __call__(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.batch(data, np.array([0, len(data)]))[0].tobytes()


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and bounds of texts with an end id after each."""
    k = len(bounds) - 1
    out = np.full(len(ids) + k, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(k), np.diff(bounds))] = ids
    return out, bounds + np.arange(k + 1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
