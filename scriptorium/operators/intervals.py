"""Joins of intervals that overlap, without a nested loop.

Two intervals overlap if one of them starts within the other, so a pair is told by where the
later of the two starts: the starts of one side are points, and the other side's intervals are
joined to the points within them, and the other way round. Points lie in the order of (keys, start),
cut into blocks of equal numbers, and an interval is copied to the blocks that it spans. So what is
exchanged grows with the rows and with the pairs of a block, not with how dense or how long they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.store import counted, materialise, scoped

#: Points of a block, and intervals that are joined to a block as one; more are dealt over copies of its
#: points. So few are gone through again and again in memory (Spark keeps up to 4,096 of a key there).
BLOCK = 4_000
#: Candidate pairs of a task, of which few bytes may make many, and tasks of the join at most.
PAIRS, TASKS = 20_000_000, 10_000
#: Blocks that are told apart at most; the driver and each task hold where they start (16 bytes each).
CUTS = 50_000
#: Blocks with many intervals that are broadcast (about 30 bytes each).
SMALL = 100_000
#: Bits of a row's place in its partition, as in Spark's monotonically_increasing_id.
PLACE = 33


def instant(df: DataFrame, name: str) -> Column:
    """A time, date or number as a long: microseconds, days, or itself."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    if kind == "timestamp":
        return F.unix_micros(name)
    return F.datediff(F.col(name), F.lit("1970-01-01").cast("date")).cast("long") if kind == "date" else F.col(name).cast("long")


def _placed(df: DataFrame, span: tuple[str, str], keys: dict[str, str], side: str) -> DataFrame:
    """A written row per row with both bounds in order: of, keys (cast to a type), hash of keys, lo, hi, id."""
    typed = {k: F.col(k).cast(kind) + F.lit(0.0).cast(kind) if kind in ("float", "double") else F.col(k).cast(kind) for k, kind in keys.items()}  # -0.0 is 0.0
    rows = df.select(F.struct(*df.columns).alias(side), *[c.alias(f"{side}_{k}") for k, c in typed.items()], instant(df, span[0]).alias(f"{side}_lo"), instant(df, span[1]).alias(f"{side}_hi"))
    rows = rows.where(F.col(f"{side}_lo") <= F.col(f"{side}_hi"))
    for k in keys:
        rows = rows.where(F.col(f"{side}_{k}").isNotNull())
    h = F.xxhash64(*[f"{side}_{k}" for k in keys]) if keys else F.lit(0).cast("long")
    return materialise(rows.withColumns({f"{side}_h": h, f"{side}_id": F.monotonically_increasing_id()}), f"intervals-{side}")


def _spans(cuts: np.ndarray):
    """First and last of the blocks, which start at ``cuts`` (h, lo), that may hold points of an interval."""
    hashes, times = np.unique(cuts[:, 0]), np.unique(cuts[:, 1])
    width = len(times) + 1
    starts = np.searchsorted(hashes, cuts[:, 0]) * width + np.searchsorted(times, cuts[:, 1])

    def before(h: np.ndarray, t: np.ndarray, side: str) -> np.ndarray:
        """Cuts before (h, t), or (side right) up to it."""
        at = np.searchsorted(hashes, h)
        there = np.append(hashes, 0)[at] == h
        there &= at < len(hashes)
        return np.searchsorted(starts, at * width + np.where(there, np.searchsorted(times, t, side), 0))

    def spans(h: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        first = np.maximum(before(h.to_numpy(), lo.to_numpy(), "left") - 1, 0)
        return pd.DataFrame({"first": first, "last": before(h.to_numpy(), hi.to_numpy(), "right") - 1})

    return F.pandas_udf(spans, "first long, last long")


def _starts_within(points: DataFrame, spans: DataFrame, keys: tuple[str, ...], sides: tuple[str, str], later: int, block: int, pairs: int) -> DataFrame:
    """(left, right): the rows of ``points`` that start within a row of ``spans``, from ``later`` after
    its start. ``sides`` are the names of both."""
    p, s = sides
    spark, order = points.sparkSession, [f"{p}_h", f"{p}_lo"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = points.repartitionByRange(parts, *order, f"{p}_id").sortWithinPartitions(*order)
    laid = materialise(laid.withColumn("at", F.monotonically_increasing_id()), f"points-{p}")
    # Cells are the finest cuts; a block is of as many as an interval spans in the mean, within ``block`` points.
    part, place = F.shiftright("at", PLACE), F.col("at").bitwiseAND((1 << PLACE) - 1)
    cell = max(1, -(-laid.count() // max(1, CUTS - parts)))
    cells = laid.groupBy(part.alias("part"), F.floor(place / cell).alias("cell")).agg(F.min(F.struct(*order)).alias("cut")).select("part", "cell", "cut.*").orderBy("part", "cell").collect()  # CUTS at most
    first = {}
    for i, r in enumerate(cells):
        first.setdefault(r["part"], i)
    cuts = np.array([r[2:] for r in cells], np.int64).reshape(-1, 2)
    bounds = lambda cuts: _spans(cuts)(f"{s}_h", F.col(f"{s}_lo") + later, f"{s}_hi")
    mean = spans.select(bounds(cuts).alias("c")).agg(F.avg(F.greatest(F.lit(0), F.col("c.last") - F.col("c.first") + 1))).head()[0] or 0
    cells_of = int(max(1, min(block // cell, mean)))
    offsets = F.lit([first.get(i, 0) for i in range(max(first, default=0) + 1)])
    mine = laid.withColumn("block", F.floor((F.get(offsets, part.cast("int")) + F.floor(place / cell)) / cells_of)).drop("at")
    copies = spans.withColumn("c", bounds(cuts[::cells_of])).where("c.first <= c.last").withColumn("block", F.explode(F.sequence("c.first", "c.last"))).drop("c")
    sizes = materialise(copies.groupBy("block").agg(F.count("*").alias("n")), f"blocks-{p}")
    in_all = (sizes.agg(F.sum("n")).head()[0] or 0) * cell * cells_of
    tasks = int(min(TASKS, max(parts, -(-in_all // pairs))))
    hot = counted(materialise(sizes.where(F.col("n") > block).select("block", F.ceil(F.col("n") / block).cast("int").alias("parts")), f"hot-blocks-{p}"), SMALL)
    n = F.coalesce("parts", F.lit(1))
    copies = copies.join(hot, "block", "left").withColumn("deal", F.pmod(F.xxhash64(f"{s}_id"), n).cast("int"))
    mine = mine.join(hot, "block", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), n - 1)))
    at = lambda df, side: df.select(F.col("block").alias(f"{side}_block"), F.col("deal").alias(f"{side}_deal"), side, f"{side}_lo", *([f"{side}_hi"] if side == s else []), *[f"{side}_{k}" for k in keys])
    meet = (F.col(f"{s}_lo") + later <= F.col(f"{p}_lo")) & (F.col(f"{p}_lo") <= F.col(f"{s}_hi"))
    for c in ("block", "deal", *keys):
        meet = meet & (F.col(f"{p}_{c}") == F.col(f"{s}_{c}"))
    # A given number of partitions is left as it is when the plan adapts to the bytes exchanged. Keys
    # stay out of it: few keys would not fill the tasks, and blocks do.
    x, y = (at(df, side).repartition(tasks, f"{side}_block", f"{side}_deal") for df, side in ((copies, s), (mine, p)))
    return x.join(y.hint("merge"), meet).select("left", "right")


@scoped
def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: tuple[str, ...] = (), block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """(left, right), structs of the two sides' rows: every pair of equal ``keys`` whose intervals
    (start, end, both ends included) overlap, once. A point is an interval with the same
    column twice. Rows with a null bound or key, or an end before the start, overlap nothing.
    Repeated rows are rows of their own; column names may clash. Bounds are times, dates or
    whole numbers, of one kind on both sides.

    Tasks are as many as keep them at about ``pairs`` candidates, and not as the bytes have it."""
    kinds = {f.name: f.dataType.simpleString() for f in left.select(*keys).union(right.select(*keys)).schema.fields} if keys else {}
    a, b = _placed(left, left_span, kinds, "left"), _placed(right, right_span, kinds, "right")
    told = _starts_within(b, a, keys, ("right", "left"), 0, block, pairs)
    longer = b.where("right_lo < right_hi")
    if longer.isEmpty():
        return told
    return told.union(_starts_within(a, longer, keys, ("left", "right"), 1, block, pairs))
