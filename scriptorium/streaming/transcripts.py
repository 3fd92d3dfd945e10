"""Structured Streaming twins of the transcript operators.

Input is a stream of ``events`` rows. Its zone-less times are cast, as watermarks need
``timestamp``. For results equal to the batch forms use complete mode without a
watermark; with one, rows later than it are dropped and state is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.transcripts import MONEY
from scriptorium.sources.tables import SCHEMAS

FINAL = "user_id long, event_type string, ts timestamp, event_id long"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder's Parquet files."""
    rows = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def watermarked(events: DataFrame, delay: str | None) -> DataFrame:
    return events.withWatermark("ts", delay) if delay else events


def tumbling(events: DataFrame, width: str = "1 day", delay: str | None = None) -> DataFrame:
    return watermarked(events, delay).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", delay: str | None = None) -> DataFrame:
    return watermarked(events, delay).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    rows = watermarked(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast(MONEY)).alias("total")).select("user_id", F.col("s.start").alias("start"), "n", "total")


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once, remembered for as long as the watermark allows repeats."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _keep_latest(idle_ms: int | None):
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for batch in batches:
            for ts, event_id in zip(batch["us"], batch["event_id"]):
                if best is None or (ts, event_id) > best:
                    best = (int(ts), int(event_id))
        state.update(best)
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(best[0] // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "us": [best[0]], "event_id": [best[1]]})

    return keep


def finalized(events: DataFrame, delay: str | None = None, idle_ms: int = 86_400_000) -> DataFrame:
    """The latest version of each (user_id, event_type), in update mode: a row per key that a
    batch touched. State is one (time, id) per key, and batches of a key are folded one
    after the other.

    With ``delay`` there is a watermark: rows later than it are dropped, and a key's state
    goes when the watermark is ``idle_ms`` past its last row. A later row of the key starts
    anew and is newer than what was forgotten, so a table that is kept up by
    :func:`save_finalized` stays right."""
    rows = watermarked(events, delay).select("user_id", "event_type", "ts", F.unix_micros("ts").alias("us"), "event_id")
    timeout = "EventTimeTimeout" if delay else "NoTimeout"
    latest = rows.groupBy("user_id", "event_type").applyInPandasWithState(_keep_latest(idle_ms if delay else None), "user_id long, event_type string, us long, event_id long", "us long, event_id long", "update", timeout)
    return latest.select("user_id", "event_type", F.timestamp_micros("us").alias("ts"), "event_id")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process all there is and return the memory sink's table; for tests and small tools."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def save_finalized(stream: DataFrame, path: str, checkpoint: str):
    """Keep :func:`finalized` segments in a Parquet table: each batch is a folder of its own,
    named by the batch's number and written anew if the batch is run again, so a restart
    neither loses nor doubles rows. Read it with :func:`read_finalized`."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_finalized(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, event_type, ts, event_id): the last saved version of each key. The greatest
    struct combines within tasks."""
    last = spark.read.schema(FINAL).parquet(path).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select("user_id", "event_type", F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))


def compact_finalized(spark: SparkSession, path: str, target: str) -> None:
    """The table's last versions as one folder at ``target``: a base to read from, written
    beside the table so that a lost run harms neither."""
    read_finalized(spark, path).write.mode("overwrite").parquet(f"{target}/batch=-1")
