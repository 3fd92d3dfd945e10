import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import transcripts
from scriptorium.sources.tables import table
from scriptorium.streaming import transcripts as streaming


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """events in four shuffled files, a batch each."""
    path = str(tmp_path_factory.mktemp("events"))
    table(spark, parity.SF, "events").repartition(4, F.pmod("event_id", F.lit(7))).write.mode("overwrite").parquet(path)
    return path


def run(spark, folder, tmp_path, make, mode="complete", name="t"):
    return streaming.run_available(make(streaming.read_events(spark, folder)), name, str(tmp_path / "c"), mode)


def test_windows_equal_batch(spark, folder, tmp_path):
    got = {(str(r.start), r.n) for r in run(spark, folder, tmp_path, streaming.tumbling, name="tumbling_t").collect()}
    assert got == {(str(r.start), r.n) for r in transcripts.segment_tumbling(table(spark, parity.SF, "events")).collect()}


def test_sessions_equal_batch(spark, folder, tmp_path):
    got = {(r.user_id, str(r.start), r.n) for r in run(spark, folder, tmp_path, streaming.sessions, name="sessions_t").collect()}
    assert got == {(r.user_id, str(r.start), r.n) for r in transcripts.segment_sessions(table(spark, parity.SF, "events")).collect()}


def test_finalized_keeps_the_last_version(spark, folder, tmp_path):
    rows = run(spark, folder, tmp_path, streaming.finalized, "update", "final_t").collect()
    last = {}
    for r in rows:
        key = (r.user_id, r.event_type)
        last[key] = max(last.get(key, (r.ts, r.event_id)), (r.ts, r.event_id))
    assert {(k, v[1]) for k, v in last.items()} == {((r.user_id, r.event_type), r.event_id) for r in transcripts.finalized_segments(table(spark, parity.SF, "events")).collect()}


def test_repeats_are_dropped(spark, tmp_path):
    rows = table(spark, parity.SF, "events").limit(50)
    rows.union(rows).repartition(1).write.parquet(str(tmp_path / "twice"))
    got = run(spark, str(tmp_path / "twice"), tmp_path, streaming.deduplicated, "append", "dedup_t")
    assert got.count() == got.select("event_id").distinct().count() == 50


def test_sliding_windows_equal_batch(spark, folder, tmp_path):
    got = {(str(r.start), r.n) for r in run(spark, folder, tmp_path, streaming.sliding, name="sliding_t").collect()}
    assert got == {(str(r.start), r.n) for r in transcripts.segment_sliding(table(spark, parity.SF, "events")).collect()}


def expected_final(spark):
    return {(r.user_id, r.event_type, str(r.ts), r.event_id) for r in transcripts.finalized_segments(table(spark, parity.SF, "events")).collect()}


def test_finalized_table_survives_restarts(spark, tmp_path):
    """Four files, two before a restart and two after; a batch that ran is then run again."""
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    rows = table(spark, parity.SF, "events").withColumn("part", F.pmod("event_id", F.lit(4)))
    for half in ((0, 1), (2, 3)):
        for part in half:
            rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(source))
        streaming.save_finalized(streaming.finalized(streaming.read_events(spark, str(source))), out, checkpoint).awaitTermination()
    got = lambda path: {(r.user_id, r.event_type, str(r.ts), r.event_id) for r in streaming.read_finalized(spark, path).collect()}
    assert got(out) == expected_final(spark)
    # A commit that was lost: the last batch is run again, over what it has written.
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) >= 4
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    streaming.save_finalized(streaming.finalized(streaming.read_events(spark, str(source))), out, checkpoint).awaitTermination()
    assert got(out) == expected_final(spark)
    streaming.compact_finalized(spark, out, str(tmp_path / "base"))
    assert got(str(tmp_path / "base")) == expected_final(spark)


def timed(spark, path, *batches):
    """Files in the order of their names, a batch each: (event_id, hour of January) rows."""
    for batch in batches:
        spark.createDataFrame(batch, "event_id long, h int").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) as ts", "1L as user_id", "'e' as event_type", "1.0D as value", "cast(null as string) as props").coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows older than the watermark that the batch before began with don't count, and the
    engine says how many these were."""
    path = str(tmp_path / "late")
    timed(spark, path, [(1, 0), (2, 1)], [(3, 100)], [(6, 100)], [(4, 2), (5, 101)])
    stream = streaming.tumbling(streaming.read_events(spark, path), "1 hour", "1 hour")
    query = stream.writeStream.outputMode("append").format("memory").queryName("late_t").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert sum(r.n for r in spark.table("late_t").where("start < '2024-01-02'").collect()) == 2


def test_finalized_state_expires(spark, tmp_path):
    path = str(tmp_path / "idle")
    timed(spark, path, [(1, 0)], [(2, 100)], [(3, 101)])
    rows = streaming.read_events(spark, path).withColumn("user_id", F.col("event_id"))
    query = streaming.save_finalized(streaming.finalized(rows, "1 hour", 3_600_000), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) <= 2 and len(streaming.read_finalized(spark, str(tmp_path / "out")).collect()) == 3
