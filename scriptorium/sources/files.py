"""File and database sources and sinks. Schemas are given, never inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: one of {', '.join(FORMATS)}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema: inference would read the data twice")
    reader = spark.read.options(**({"header": True} if fmt == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: one of {', '.join(FORMATS)}")
    writer = df.write.mode(mode).options(**({"header": True} if fmt == "csv" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)


def read_jdbc(spark: SparkSession, url: str, dbtable: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options) -> DataFrame:
    """A database table, read in ranges of ``partition_column`` where one is named. The
    database's driver jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, dbtable: str, mode: str = "append", partitions: int | None = None, batch: int = 5000, **options) -> None:
    """Rows into a database table, over at most ``partitions`` connections at a time."""
    out = df.coalesce(partitions) if partitions else df
    out.write.format("jdbc").mode(mode).option("url", url).option("dbtable", dbtable).option("batchsize", batch).options(**options).save()
