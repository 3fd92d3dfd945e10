"""Laid-out tables: the same rows, joins and windows without an exchange, pruned partitions."""

import uuid

import parity
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.plans import registry
from scriptorium.plans.store import fresh_path
from scriptorium.sources import layout
from scriptorium.sources.tables import table


@pytest.fixture()
def laid(spark):
    made = []

    def lay(df, **how):
        name, path = f"t_{uuid.uuid4().hex}", fresh_path(spark, "laid")
        made.append((name, path))
        return layout.lay_out(df, name, path, **how)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lay
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name, path in made:
        layout.drop(spark, name, path)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_sides_are_not_exchanged(spark, laid):
    orders, items = table(spark, parity.SF, "orders"), table(spark, parity.SF, "lineitem")
    a, b = laid(orders, bucket_by=("o_orderkey",)), laid(items, bucket_by=("l_orderkey",))
    assert sorted(a.collect()) == sorted(orders.collect())
    joined = a.join(b, a.o_orderkey == b.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    plain = orders.join(items, orders.o_orderkey == items.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    assert sorted(joined.collect()) == sorted(plain.collect())
    assert "Exchange" not in final_plan(joined) and "Exchange" in final_plan(plain)
    ranked = b.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate")))
    assert "Exchange" not in final_plan(ranked)


def test_partitions_are_pruned_while_a_join_runs(spark, laid):
    events = table(spark, parity.SF, "events").withColumn("day", F.col("ts").cast("date"))
    laid_events = laid(events, partition_by=("day",), bucket_by=("user_id",))
    days = events.groupBy("day").agg(F.count("*").alias("n")).orderBy("day").limit(3)
    days = spark.createDataFrame(days.collect(), days.schema)
    joined = laid_events.join(days.where("n > 0"), "day")
    plan = final_plan(joined)
    assert "dynamicpruning" in plan
    assert joined.count() == days.agg(F.sum("n")).head()[0]
    assert laid_events.where("day = '2024-01-02'").count() == events.where("day = '2024-01-02'").count()


def test_bucket_numbers(spark):
    assert layout.buckets_for(0) == 8 and layout.buckets_for(100 * 10**12) == 2**19
    with pytest.raises(ValueError):
        layout.lay_out(spark.range(3), "x", "y", sort_by=("id",))


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    """A task of the laid-out join sorts a bucket: more rows are more buckets, and no larger ones."""
    rows = spark.range(1000).select("id", F.lit("x").alias("t"))
    assert layout.rows_bytes(rows) == 28_000
    made, plain = [], layout.lay_out
    monkeypatch.setattr(layout, "lay_out", lambda df, name, path, keys, buckets=8: made.append(buckets) or plain(df, name, path, keys, buckets))
    monkeypatch.setattr(layout, "BUCKET_BYTES", 50_000)
    registry.queries()["layout_buckets"](spark, "/root/testdata/sf0.001")
    assert len(made) == 2 and made[0] == made[1] >= 16
