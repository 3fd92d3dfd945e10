"""Ordered work over keys of any size: rows of a key are cut into blocks, each block is a
window of its own, and what a block needs of those before it is carried to it.

The windows over blocks see a row a block, never a row an event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.plans.store import counted, materialise

#: Carried rows (a key and a block each, under 100 bytes) up to this number are broadcast.
CARRIED = 200_000


def hours(ts: str, width: int = 24) -> Column:
    """The block of a zone-less time: hours since 1970, in steps of ``width``; null of null."""
    since = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(ts)
    return F.floor(since / width)


def ranged(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """``df`` as a written table in ranges of (keys, order), with the range's number as
    ``block``: a key with a third of all rows has a third of all blocks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *keys, *order).withColumn("block", F.spark_partition_id()), name)


def before(keys: tuple[str, ...], column: str) -> Column:
    """The sum of ``column`` over the earlier blocks of a key; null for the first."""
    return F.sum(column).over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def with_carried(rows: DataFrame, carried: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns of ``carried`` (keys, block, ...), null keys included."""
    small = materialise(carried, "carried")
    named = small.select(*[F.col(c).alias(f"{c}_of") if c in (*keys, "block") else F.col(c) for c in small.columns])
    same = F.lit(True)
    for c in (*keys, "block"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return rows.join(counted(named, CARRIED), same).drop(*[f"{c}_of" for c in (*keys, "block")])


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """``df`` with ``place``, from 0, of a row among those of its keys, and ``n``, their number.
    ``order`` should tell rows apart; windows over rows see one range of them each."""
    rows = ranged(df, keys, order, name)
    sizes = rows.groupBy(*keys, "block").agg(F.count("*").alias("size"))
    carried = sizes.select(*keys, "block", F.coalesce(before(keys, "size"), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy(*keys)).alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(*order))
    return with_carried(rows, carried, keys).withColumn("place", F.col("start") + own - 1).drop("block", "start")
