"""WARC archives with dictionary compression.

One archive for each partition: a skippable frame that holds a Zstandard dictionary built from that archive's own
records, then one frame for each record, compressed with it. Records are WARC/1.1: response records carry an HTTP header
and the payload, revisit records the header alone and the record they refer to.

Defined cases: null html is an empty payload; null urls give an empty target; line breaks in urls are escaped; equal
payloads below `least` bytes are all responses; of equal longer ones the largest page_id is the response and the others
revisit it, rows with null page_id or repeating the largest one are responses themselves; an empty table gives no
archives and no rows; extra columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import scratch, stored, write_file

LEAST = 1000
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
DICTIONARY, SAMPLES = 32 << 10, 1 << 20
DATE = "2024-01-01T00:00:00Z"
HEADER = re.compile(rb"^([A-Za-z0-9-]+): ?(.*?)\r?$", re.M)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the records; where they are too few or too alike for training, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def decoder(data: bytes):
    """The archive's decompressor and the place of its first record."""
    if data[:4] != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    end = 8 + int.from_bytes(data[4:8], "little")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end])), end


def records_of(data: bytes):
    """The records of an archive, decompressed one by one."""
    z, at = decoder(data)
    while at < len(data):
        one, out = z.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = data[at : at + 8192]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def parsed(data: bytes) -> dict:
    """Type, page, target, payload facts of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.decode() for k, v in HEADER.findall(head)}
    block = rest[: int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = {k.lower(): v for k, v in HEADER.findall(http)}
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    kind = fields[b"warc-type"]
    digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    return {"page_id": number(fields[b"warc-record-id"]), "url": fields[b"warc-target-uri"], "payload_bytes": int(sizes[b"content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get(b"warc-refers-to")), "payload": payload}


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives; returns (path, records), stored. Who revisits whom is settled on digests alone; the pages
    themselves move once, dealt by page_id, so a frequent payload doesn't meet in one task."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    facts = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    first = facts.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = facts.join(first, "digest").where("page_id < refers_to").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "refers_to"))).alias("revisits"))
    dealt = rows.join(revisits, "page_id", "left").select("page_id", "url", "html", F.element_at("revisits", F.sha1("html")).alias("refers_to"))

    def run(batches):
        part, out, z, waiting, size, n = TaskContext.get().partitionId(), [], None, [], 0, 0

        def start():
            d = dictionary(waiting)
            out.extend([SKIPPABLE, len(d).to_bytes(4, "little"), d])
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d))
            out.extend(map(z.compress, waiting))
            return z

        for batch in batches:
            pages_, urls, bodies, to = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for p, u, b, r in zip(pages_.to_pylist(), urls.to_pylist(), bodies.cast(pa.binary()).to_pylist(), to.to_pylist(), strict=True):
                one = record(p, u, b, hashlib.sha1(b).hexdigest(), r)
                n += 1
                if z:
                    out.append(z.compress(one))
                else:
                    waiting.append(one)
                    size += len(one)
                    if size >= SAMPLES:
                        z, waiting = start(), []
        if n:
            if not z:
                start()
            path = f"{folder}/pages-{part:06d}.warc.zst"
            write_file(path, out)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return stored(dealt.mapInArrow(run, "path string, records long"), "archives")


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for x in records_of(data.as_py()):
                    rows.append(parsed(x))
                    if not payloads:
                        rows[-1].pop("payload")
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in names], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in names], names=names)

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    if not write_archives(pages, folder, **options).limit(1).count():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder)
