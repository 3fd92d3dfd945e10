"""Copies of tables laid out for the joins and windows that will read them.

Rows are hashed into buckets and sorted in each: a join or window on the bucket columns of
tables with as many buckets reads them as they lie, without an exchange. ``partition_by``
gives a folder a value: a join that filters another table's rows prunes folders while it
runs. Laid-out tables are entries of the session's catalogue over files in a given path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans.store import drop_path

#: Bytes that a bucket should have at most.
BUCKET_BYTES = 256_000_000


def buckets_for(bytes_in_all: int, least: int = 8) -> int:
    """A power of two, so that tables of different sizes have buckets that divide each other."""
    n = least
    while n * BUCKET_BYTES < bytes_in_all:
        n *= 2
    return n


def rows_bytes(df: DataFrame) -> int:
    """About what the rows of ``df`` take when they are sorted: their number by Spark's own size of a row."""
    return df.count() * df._jdf.schema().defaultSize()


def lay_out(df: DataFrame, name: str, path: str, bucket_by: tuple[str, ...] = (), buckets: int = 8, sort_by: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` under ``path`` as table ``name`` and read it. Rows are exchanged once, so that a
    bucket (of a partition) is one file and not one a task."""
    keys = (*partition_by, *bucket_by)
    writer = (df.repartition(buckets, *(bucket_by or keys)) if keys else df).write.mode("overwrite").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*(sort_by or bucket_by))
    elif sort_by:
        raise ValueError("rows are sorted within buckets: name bucket columns")
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    drop_path(spark, path)
