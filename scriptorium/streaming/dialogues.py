"""Dialogues as they are spoken: turns stitched once a conversation is idle, and prompts joined
with their replies.

Input is a stream of turns (conv_id, turn, role, text, ts). State is kept in RocksDB, which
spills to disk; the session must name that provider (:data:`STATE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TURNS = "conv_id long, turn long, role string, text string, ts timestamp"


def read_turns(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder's Parquet files of turns."""
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class Stitcher(StatefulProcessor):
    """Per conversation a list of its turns and one timer: ``idle_ms`` after the latest of them.
    When it fires the turns are put in order, given out as one text, and forgotten."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn string, role string, text string")
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else None
        latest = due
        for batch in rows:
            self.turns.appendList([tuple(None if x is None or x != x else x for x in r) for r in zip(batch["turn"], batch["role"], batch["text"])])
            end = int(batch["ms"].max()) + self.idle_ms
            latest = end if latest is None else max(latest, end)
        if latest != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(latest)
            self.due.update((latest,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns = sorted(self.turns.get(), key=lambda r: (r[0] is not None, int(r[0] or 0), r[1] or "", r[2] or ""))
        text = "\n".join(f"{role}: {text}" for _, role, text in turns if role is not None and text is not None)
        self.turns.clear()
        self.due.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "text": [text], "n": [len(turns)]})

    def close(self) -> None:
        pass


def stitched(turns: DataFrame, idle: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """(conv_id, text, n): each conversation's turns in order, a line each, once the watermark is
    ``idle`` seconds past its last turn. Turns may come in any order within ``delay``; later
    ones are dropped, as long as the watermark is past them. A conversation that goes on
    after it was given out is given out again with its new turns alone. Rows without a
    conversation or a time are left out; so are lines without a role or text."""
    rows = turns.where("conv_id is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.select("conv_id", "ts", F.col("turn").cast("string").alias("turn"), "role", "text", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("conv_id").transformWithStateInPandas(Stitcher(idle * 1000), "conv_id long, text string, n long", "Append", "EventTime")


def paired(turns: DataFrame, again: DataFrame, bound: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """(conv_id, turn, prompt, reply, asked, answered): each user turn with the assistant turn that
    follows it within ``bound``; a prompt without one comes out with nulls when none can come
    any more. ``turns`` and ``again`` are two readings of one stream. Both sides have a
    watermark and the join a range of time, so a turn is held for bound + delay at most."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), F.col("ts").alias("asked")).withWatermark("asked", delay)
    answered = again.where("role = 'assistant'").select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.col("text").alias("reply"), F.col("ts").alias("answered")).withWatermark("answered", delay)
    meet = F.expr(f"conv_id = of and at = turn + 1 and answered >= asked and answered <= asked + interval {bound}")
    return asked.join(answered, meet, "leftOuter").select("conv_id", "turn", "prompt", "reply", "asked", "answered")


def save(stream: DataFrame, path: str, checkpoint: str):
    """Append what the stream gives out to a Parquet table, exactly once over restarts."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
