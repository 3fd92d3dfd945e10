"""Usage and cost. Money is summed as decimals. No window holds all of a user's or a
feature's events: see ``blocks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.blocks import before, hours, ranged, with_carried
from scriptorium.operators.transcripts import MONEY
from scriptorium.plans.store import scoped

TOTAL = "decimal(38,2)"


def usage_cube(events: DataFrame) -> DataFrame:
    """(event_type, user_id, day, n, cost, gid) for every grouping of the three. Events are
    summed at the finest grain before the cube multiplies rows."""
    fine = events.groupBy("event_type", "user_id", F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast(MONEY)).alias("cost"))
    return fine.cube("event_type", "user_id", "day").agg(F.sum("n").cast("long").alias("n"), F.sum("cost").cast(TOTAL).alias("cost"), F.grouping_id().cast("long").alias("gid"))


@scoped
def usage_rolling(events: DataFrame) -> DataFrame:
    """(event_id, s): the user's spend over the trailing day, the event's own time included.

    It is the sum up to the event's time less the sum before a day earlier: an event asks for
    both by a row of its own, sorted in among the events. Sums run on in ranges of (user,
    time), each from the sum of those before it, so work grows with the rows alone and a
    user's day may be of any size. Events without a time see each other; null if nothing in
    the day has a value."""
    x, day = F.col("value").cast(MONEY), F.expr("interval 1 day")
    rows = events.select("event_id", "user_id", "ts", x.alias("x"), F.monotonically_increasing_id().alias("row"))
    # 0 asks for what is before a time, 1 is an event, 2 asks for what is up to a time.
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), at.alias("at"), amount.alias("x"), n.alias("n")) for kind, at, amount, n in ((0, F.col("ts") - day, F.lit(None).cast(MONEY), F.lit(0)), (1, F.col("ts"), F.col("x"), F.col("x").isNotNull().cast("int")), (2, F.col("ts"), F.lit(None).cast(MONEY), F.lit(0)))])
    asked = ranged(rows.select("event_id", "user_id", "row", F.explode(kinds).alias("k")).select("event_id", "user_id", "row", "k.*"), ("user_id",), ("at", "kind", "row"), "rolling")
    totals = asked.groupBy("user_id", "block").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    carried = totals.select("user_id", "block", before(("user_id",), "x").cast(TOTAL).alias("x_before"), before(("user_id",), "n").alias("n_before"))
    order = Window.partitionBy("user_id", "block").orderBy("at", "kind", "row").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0)) + F.coalesce(f"{c}_before", F.lit(0))
    told = with_carried(asked, carried, ("user_id",)).select("row", "event_id", "kind", run("x").cast(TOTAL).alias("x"), run("n").alias("n")).where("kind <> 1")
    up_to, less = F.max(F.when(F.col("kind") == 2, F.struct("x", "n"))), F.max(F.when(F.col("kind") == 0, F.struct("x", "n")))
    both = told.groupBy("row").agg(F.max("event_id").alias("event_id"), up_to.alias("a"), less.alias("b"))
    return both.select("event_id", F.when(F.col("a.n") > F.col("b.n"), F.col("a.x") - F.col("b.x")).cast(TOTAL).alias("s"))


@scoped
def usage_percentiles(events: DataFrame) -> DataFrame:
    """(event_type, p90, p50), exact, interpolated between the two nearest values; null where
    a type has no value. Equal values are counted within tasks first; values then lie in
    ranges, and ranks are counted on from range to range."""
    counts = events.groupBy("event_type", "value").agg(F.count("value").alias("n"))
    rows = ranged(counts, ("event_type",), ("value",), "values")
    totals = rows.groupBy("event_type", "block").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("event_type"))
    told = with_carried(rows, totals.select("event_type", "block", F.coalesce(before(("event_type",), "n"), F.lit(0)).alias("earlier"), whole.alias("total")), ("event_type",))
    order = Window.partitionBy("event_type", "block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = told.withColumn("run", F.col("earlier") + F.sum("n").over(order))
    at = {name: share * (F.col("total") - 1) for name, share in (("p90", 0.9), ("p50", 0.5))}
    nearest = [F.min(F.when(F.col("run") > side(x), F.col("value"))).alias(f"{name}_{side.__name__}") for name, x in at.items() for side in (F.floor, F.ceil)]
    found = run.groupBy("event_type").agg(F.first("total").alias("total"), *nearest)
    out = []
    for name, x in at.items():
        low, high = F.col(f"{name}_floor"), F.col(f"{name}_ceil")
        out.append(F.when(low == high, low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high).alias(name))
    return found.select("event_type", *out)


def usage_props(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def budget_breach(events: DataFrame, budget: int = 1000, width: int = 24) -> DataFrame:
    """(user_id, event_id): the first event at which a user's running cost passes the budget.
    Costs run within blocks of ``width`` hours; each block starts with the sum of those
    before it, as a row ahead of its own."""
    rows = events.select("user_id", "event_id", "ts", F.col("value").cast(MONEY).cast(TOTAL).alias("x"), hours("ts", width).alias("block"))
    totals = rows.groupBy("user_id", "block").agg(F.sum("x").alias("x"))
    start = totals.select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), before(("user_id",), "x").cast(TOTAL).alias("x"), "block", F.lit(0).alias("own"))
    order = Window.partitionBy("user_id", "block").orderBy("own", "ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("own", F.lit(1)).unionByName(start).withColumn("run", F.sum("x").over(order)).where((F.col("own") == 1) & (F.col("run") > budget))
    return run.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))
