"""Live stitching and pairing against their batch forms: any order, late turns, restarts, state."""

import datetime
import random

import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import transcripts
from scriptorium.sources.tables import table
from scriptorium.streaming import dialogues

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    key, value = next(iter(dialogues.STATE.items()))
    before, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, value)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def write(spark, folder, rows):
    """One file, a batch of its own: (conv_id, turn, role, text, minutes from the start)."""
    made = [(c, t, r, x, START + datetime.timedelta(minutes=m)) for c, t, r, x, m in rows]
    spark.createDataFrame(made, dialogues.TURNS).coalesce(1).write.mode("append").parquet(folder)


def spoken(spark, n):
    """Turns of ``n`` conversations a minute apart, conversations that start within an hour."""
    rows = table(spark, parity.SF, "conversations").where(F.col("conv_id") < n).collect()
    return [(r.conv_id, r.turn, r.role, r.text, r.conv_id % 60 + r.turn) for r in rows]


def final(conv=-1, minute=10_000):
    return [(conv, 0, "system", "end", minute)]


def test_stitching_equals_batch_in_any_order(spark, tmp_path):
    rows, folder, out, checkpoint = spoken(spark, 15), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    random.Random(1).shuffle(rows)
    write(spark, folder, rows[: len(rows) // 2])
    stream = lambda: dialogues.stitched(dialogues.read_turns(spark, folder), 1800, "2 hours")
    dialogues.save(stream(), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 0
    # After a restart, the rest; then time goes on.
    write(spark, folder, rows[len(rows) // 2 :])
    dialogues.save(stream(), out, checkpoint).awaitTermination()
    write(spark, folder, final())
    write(spark, folder, final(-2, 20_000))
    query = dialogues.save(stream(), out, checkpoint)
    query.awaitTermination()
    got = {r.conv_id: r.text for r in spark.read.parquet(out).where("conv_id >= 0").collect()}
    batch = transcripts.turn_stitch(table(spark, parity.SF, "conversations").where(F.col("conv_id") < 15))
    assert got == {r.conv_id: r.text for r in batch.collect()} and len(got) > 5
    # A further batch finds the state of all but the last conversation gone.
    write(spark, folder, final(-3, 30_000))
    query = dialogues.save(stream(), out, checkpoint)
    query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert min(held) <= 6 and spark.read.parquet(out).where("conv_id >= 0").count() == len(got)


def test_late_turns_are_dropped_and_new_ones_start_anew(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for rows in ([(2**60 + 1, 1, "user", "b", 1), (2**60 + 1, 0, "system", "a", 0), (None, 0, "user", "x", 0)], [(5, 0, "user", "other", 500)], [(6, 0, "user", "more", 505)], [(2**60 + 1, 2, "user", "late", 2), (2**60 + 1, 3, "user", "new", 501)], final()):
        write(spark, folder, rows)
    write(spark, folder, final(-2, 20_000))
    query = dialogues.save(dialogues.stitched(dialogues.read_turns(spark, folder), 1800, "10 minutes"), out, checkpoint)
    query.awaitTermination()
    got = sorted((r.conv_id, r.text, r.n) for r in spark.read.parquet(out).where("conv_id > 0").collect())
    assert got == [(5, "user: other", 1), (6, "user: more", 1), (2**60 + 1, "system: a\nuser: b", 2), (2**60 + 1, "user: new", 1)]


def test_pairs_equal_batch_and_unmatched_prompts_come_out(spark, tmp_path):
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    rows = spoken(spark, 40) + [(900, 0, "user", "nobody answers", 5), (901, 0, "user", "too late", 6), (901, 1, "assistant", "an hour on", 66)]
    random.Random(2).shuffle(rows)
    for part in (rows[::2], rows[1::2]):
        write(spark, folder, part)
    stream = lambda: dialogues.paired(dialogues.read_turns(spark, folder), dialogues.read_turns(spark, folder), "10 minutes", "2 hours")
    dialogues.save(stream(), out, checkpoint).awaitTermination()
    for conv, minute in ((-1, 10_000), (-2, 20_000), (-3, 30_000)):
        write(spark, folder, [(conv, 0, "user", "end", minute), (conv, 1, "assistant", "end", minute)])
    query = dialogues.save(stream(), out, checkpoint)
    query.awaitTermination()
    told = spark.read.parquet(out).where("conv_id >= 0")
    batch = transcripts.turn_pairs(table(spark, parity.SF, "conversations").where(F.col("conv_id") < 40))
    names = ("conv_id", "turn", "prompt", "reply")
    assert sorted(map(tuple, told.where("reply is not null").select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))
    alone = {(r.conv_id, r.turn) for r in told.where("reply is null").collect()}
    asked = {(c, t) for c, t, role, _, _ in rows if role == "user"}
    assert alone == asked - {(r.conv_id, r.turn) for r in batch.collect()} and {(900, 0), (901, 0)} <= alone
    held = [op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"]]
    assert max(held) <= 6
