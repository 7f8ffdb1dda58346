"""Streams over events: windowed counts with watermarks, sessions, idempotent ingestion, latest-wins sinks."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files named `name` in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def windowed(events: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None, value: str | None = None) -> DataFrame:
    """(window_start, keys, n, total) in tumbling or sliding windows."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *keys)
    return g.agg(F.count("*").alias("n"), (F.sum(value) if value else F.lit(0.0)).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def ingest_once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows with a key seen within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch once, whatever is retried: batches are directories named by their number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; on one machine, where that is unset, below its temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def landed(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream over what is there now; its updated rows are written by batches, and the last one of each key is returned. Nothing
    passes through the driver, and a batch that is tried again overwrites its own folder."""
    spark = stream.sparkSession
    path = scratch_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/part={number}")

    q = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    log = spark.read.schema(schema).parquet(f"{path}/rows")
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(stream.columns)


RETRY = "send_id string, state string, attempts int, next_attempt_at timestamp"


def retries(tries: DataFrame, *, base_seconds: int = 30, most: int = 5) -> DataFrame:
    """(send_id, state, attempts, next_attempt_at) of a stream of tries (send_id string, at timestamp, ok boolean), kept for each message
    between batches: a success ends it, a failure waits twice as long as the one before, and `most` of them end it. What comes after its
    end changes nothing. Tries of one batch count in the order of their time."""

    def step(key, frames, state):
        status, n, due = state.get if state.exists else ("pending", 0, None)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for at, ok in zip(rows["at"], rows["ok"], strict=True):
            if status == "pending":
                n += 1
                status = "sent" if ok else "failed" if n >= most else "pending"
                due = (at + pd.Timedelta(seconds=base_seconds * 2 ** (n - 1))).to_pydatetime() if status == "pending" else None
        state.update((status, n, due))
        yield pd.DataFrame({"send_id": [key[0]], "state": [status], "attempts": [n], "next_attempt_at": [due]})

    kept = "state string, attempts int, next_attempt_at timestamp"
    return tries.groupBy("send_id").applyInPandasWithState(step, RETRY, kept, "update", "NoTimeout")
