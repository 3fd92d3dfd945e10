"""Usage kept in batches against one batch run: re-runs, lost runs, corrections, late days, errors."""

import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import usage
from scriptorium.operators.usage_store import UsageStore
from scriptorium.plans.store import fresh_path
from scriptorium.sources.tables import table


@pytest.fixture()
def store(spark):
    return UsageStore(spark, fresh_path(spark, "usage"))


@pytest.fixture(scope="module")
def events(spark):
    more = spark.sql("select 900000L + id as event_id, if(id % 5 = 0, null, timestamp_ntz'2024-03-01 00:00:00') as ts, if(id % 3 = 0, null, 7L) as user_id, 'click' as event_type, if(id % 2 = 0, null, 2.5D) as value, if(id % 4 = 0, null, '{\"k\": 3}') as props from range(40)")
    return table(spark, parity.SF, "events").unionByName(more).cache()


def told(df):
    return sorted(map(tuple, df.select("event_type", "user_id", "day", "n", "cost", "gid").collect()), key=repr)


def test_appends_equal_one_run(spark, store, events):
    late = F.col("ts").cast("date") == "2024-01-02"
    batches = [events.where(~F.coalesce(late, F.lit(False)) & (F.col("event_id") % 3 == i)) for i in range(3)]
    for i, batch in enumerate(batches):
        assert store.append(batch, f"b{i}") and not store.append(batch, f"b{i}")
    before = set(store.commits().values())
    store.append(events.where(late), "late")
    assert before < set(store.commits().values())
    assert told(store.cube()) == told(usage.usage_cube(events))
    store.compact()
    assert len(store.commits()) == 1 and told(store.cube()) == told(usage.usage_cube(events))
    assert not store.append(batches[0], "b0")
    extra = events.where("event_id < 50")
    store.append(extra, "again")
    store.append(extra, "taken back", retract=True)
    assert told(store.cube()) == told(usage.usage_cube(events))
    store.compact()
    assert told(store.cube()) == told(usage.usage_cube(events)) and not store.append(batches[0], "b0")


def test_a_lost_append_changes_nothing(spark, store, events, monkeypatch):
    store.append(events.where("event_id % 2 = 0"), "even")
    before = told(store.cube())
    with monkeypatch.context() as m:
        m.setattr(UsageStore, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(events.where("event_id % 2 = 1"), "odd")
        with pytest.raises(ZeroDivisionError):
            store.append(events.where("event_id % 2 = 1"), "more")
            store.compact()
    assert told(store.cube()) == before
    assert store.append(events.where("event_id % 2 = 1"), "odd") and told(store.cube()) == told(usage.usage_cube(events))


def test_nothing(store, events):
    assert store.cube().count() == 0 and store.states().count() == 0
    store.append(events.where("false"), "none")
    store.compact()
    assert store.cube().where("n > 0").count() == 0


@pytest.mark.parametrize("by", [(), ("event_type",), ("day",), ("event_type", "day")])
def test_estimates_are_within_their_bounds(spark, by):
    rows = table(spark, "/root/testdata/sf0.01", "events").withColumn("props", F.to_json(F.struct((F.col("event_id") % 2000).alias("k"))))
    store = UsageStore(spark, fresh_path(spark, "usage"))
    for i in range(3):
        store.append(rows.where(F.col("event_id") % 3 == i), f"b{i}")
    exact = rows.withColumn("day", F.col("ts").cast("date")).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("props", "$.k")).alias("kinds"), F.sort_array(F.collect_list("value")).alias("v"))
    true = {tuple(r[c] for c in by): r for r in exact.collect()}
    got = store.rollup(*by).collect()
    assert len(got) == len(true)
    for r in got:
        t = true[tuple(r[c] for c in by)]
        assert r.n == t.n and abs(r.kinds - t.kinds) <= 0.08 * t.kinds + 1
        for q, x in ((0.5, r.p50), (0.9, r.p90)):
            low, high = sum(v < x for v in t.v) / t.n, sum(v <= x for v in t.v) / t.n
            assert low - 0.03 - 1 / t.n <= q <= high + 0.03 + 1 / t.n
