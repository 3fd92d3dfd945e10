"""The turn log connector: round trips, pruning, streams, lost appends."""

import os

import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.sources import turnlog
from scriptorium.sources.tables import table


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    turnlog.register(spark)
    path = f"file://{tmp_path_factory.mktemp('log')}/turns"
    extra = spark.createDataFrame([(2**60 + 1, 0, "user", "l'été\n\"x\" \U0001f600"), (None, None, None, None)], turnlog.SCHEMA)
    rows = table(spark, parity.SF, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra).cache()
    low = F.col("conv_id") < 8
    for part in (rows.where(low).repartitionByRange(4, "conv_id"), rows.where(~F.coalesce(low, F.lit(False))).repartitionByRange(4, "conv_id")):
        part.write.format("turnlog").mode("append").save(path)
    return path, rows


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_round_trip(spark, log):
    path, rows = log
    df = spark.read.format("turnlog").option("bytes", 1000).load(path)
    assert told(df) == told(rows) and df.rdd.getNumPartitions() > 2
    with pytest.raises(Exception, match="appended"):
        rows.write.format("turnlog").mode("overwrite").save(path)


@pytest.mark.parametrize("condition", ["conv_id = 3", "conv_id > 9 and conv_id <= 11", "conv_id in (1, 2)", f"conv_id >= {2**60}", "conv_id is null", "conv_id < 3 and role = 'user'"])
def test_filters_leave_files_out(spark, log, condition):
    path, rows = log
    assert told(spark.read.format("turnlog").load(path).where(condition)) == told(rows.where(condition))


def test_pruned_reads_touch_fewer_files(log):
    path, _ = log
    count = lambda *filters: sum(len(p.names) for p in _planned(path, filters))
    every = count()
    assert every >= 6 and 0 < count(turnlog.EqualTo(("conv_id",), 3)) < every / 2
    assert count(turnlog.GreaterThan(("conv_id",), 2**61)) == 0
    assert 0 < count(turnlog.GreaterThanOrEqual(("conv_id",), 2), turnlog.LessThan(("conv_id",), 4)) < every / 2
    assert count(turnlog.EqualTo(("role",), "user")) == every


def _planned(path, filters):
    reader = turnlog.TurnReader(path, turnlog.BYTES)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return reader.partitions()


def test_streams_read_each_commit_once(spark, log, tmp_path):
    path, out, checkpoint = f"file://{tmp_path}/log", str(tmp_path / "out"), str(tmp_path / "c")
    _, rows = log
    parts = [rows.where(F.coalesce(F.col("conv_id"), F.lit(0)) % 3 == i) for i in range(3)]

    def run():
        spark.readStream.format("turnlog").load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for i, part in enumerate(parts):
        part.write.format("turnlog").mode("append").save(path)
        if i != 1:
            run()
    assert told(spark.read.parquet(out)) == told(rows) == told(spark.read.format("turnlog").load(path))


def test_a_lost_append_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    spark.createDataFrame([(1, 0, "user", "a")], turnlog.SCHEMA).write.format("turnlog").mode("append").save(path)
    bad = spark.range(4).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("b").alias("text"))
    with pytest.raises(Exception):
        bad.write.format("turnlog").mode("append").save(path)
    assert [r.text for r in spark.read.format("turnlog").load(path).collect()] == ["a"]
    assert os.listdir(f"{tmp_path}/log/commits") == ["00000000.json"]


def test_an_empty_log(spark, tmp_path):
    assert spark.read.format("turnlog").load(f"file://{tmp_path}/none").count() == 0
    spark.createDataFrame([], turnlog.SCHEMA).write.format("turnlog").mode("append").save(f"file://{tmp_path}/empty")
    assert spark.read.format("turnlog").load(f"file://{tmp_path}/empty").count() == 0
