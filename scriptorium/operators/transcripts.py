"""Transcript and event streams as tables: sessions, windows, final segments, stitched
dialogues, turn pairs and as-of context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.blocks import hours, ranged, with_carried
from scriptorium.plans.store import materialise, scoped

MONEY = "decimal(18,2)"


@scoped
def segment_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n, total): gap sessions per speaker. Events exactly a gap apart are
    one session; events without a time are in none.

    Events lie in ranges of (user, time) and sessions are told within each; where the first
    of a range starts within a gap of the last of the range before, they are one. That is
    decided over ranges, a row each, so no task holds all of a user."""
    limit = F.expr(f"interval {gap}")
    rows = events.where("ts is not null").select("user_id", "ts", F.col("value").cast(MONEY).alias("x"), F.monotonically_increasing_id().alias("row"))
    rows = ranged(rows, ("user_id",), ("ts", "row"), "sessions")
    order = Window.partitionBy("user_id", "block").orderBy("ts", "row")
    opens = F.coalesce(F.col("ts") - F.lag("ts").over(order) > limit, F.lit(True)).cast("int")
    told = rows.withColumn("opens", opens).withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = told.groupBy("user_id", "block", "part").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.sum("x").alias("x"))
    parts = materialise(parts, "session-parts")
    ends = parts.groupBy("user_id", "block").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.max("part").alias("parts"))
    of_user = Window.partitionBy("user_id").orderBy("block")
    joins = F.coalesce(F.col("first") - F.lag("last").over(of_user) <= limit, F.lit(False))
    # The range in which the session began that is open at a range's end.
    ends = ends.withColumn("joins", joins).withColumn("began", F.last(F.when(~F.col("joins") | (F.col("parts") > 1), F.col("block")), ignorenulls=True).over(of_user.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("from", F.when(F.col("joins"), F.lag("began").over(of_user)))
    # A session that joins goes by the last part of the range it began in.
    heads = ends.select("user_id", "block", "from", "parts")
    whole = with_carried(parts, heads, ("user_id",))
    mine = F.col("part") == 1
    own = F.when(mine & F.col("from").isNotNull(), F.col("from")).otherwise(F.col("block"))
    open_end = (F.col("part") == F.col("parts")) | (mine & F.col("from").isNotNull())
    number = F.when(open_end, F.lit(0)).otherwise(F.col("part"))
    done = whole.groupBy("user_id", own.alias("of"), number.alias("number")).agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.sum("x").cast("decimal(38,2)").alias("total"))
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


def segment_tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def segment_sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def finalized_segments(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, ts): the last version of each (user, type). The
    greatest struct combines within tasks, so no key's history is gathered or sorted."""
    last = events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"))


def turn_stitch(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): the turns of each conversation in order, a line each."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, reply): user turns that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    next_ = conversations.select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(w).alias("r"), F.lead("text").over(w).alias("reply"))
    return next_.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", "prompt", "reply")


def asof_context(events: DataFrame, kind: str = "purchase", width: int = 24) -> DataFrame:
    """(event_id, prior_id): the latest earlier event of ``kind`` by the same user (ties in
    time by event_id). Users' events are looked at in blocks of ``width`` hours; each block
    starts with the last such event of those before it, as a row ahead of its own."""
    rows = events.select("user_id", "event_id", "ts", F.when(F.col("event_type") == kind, F.col("event_id")).alias("prior"), hours("ts", width).alias("block"))
    lasts = rows.groupBy("user_id", "block").agg(F.max(F.when(F.col("prior").isNotNull(), F.struct("ts", "prior"))).alias("m"))
    earlier = Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("m", ignorenulls=True).over(earlier)["prior"]
    start = lasts.select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), carried.alias("prior"), "block", F.lit(0).alias("own"))
    order = Window.partitionBy("user_id", "block").orderBy("own", "ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("own", F.lit(1)).unionByName(start).withColumn("prior_id", F.last("prior", ignorenulls=True).over(order))
    return found.where("own = 1").select("event_id", "prior_id")
