"""Best-fit packing planned on the histogram of lengths.

How many pieces there are of each length decides the plan, not which they are. The
driver places counts (at most ``capacity`` of them, however large the corpus) with
best-fit decreasing, which gives runs: so many equal bins in a row take so many pieces
of a length each, from such an offset. Pieces then find their slot by joining on their
rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.text import bounded_batches, trimmed
from scriptorium.llm.tokens import TokenizerFile, encoder
from scriptorium.plans.store import materialise, scoped

#: Ranks of a length that share a join key.
BLOCK = 4096
RUN = "length long, first_rank long, n_pieces long, per_bin long, first_bin long, first_offset long"


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of RUN. Bins of the same remaining room are
    kept as ranges of bin numbers, and a whole range is filled in one step."""
    room: dict[int, list[list[int]]] = {}  # room left -> ranges [first bin, number]
    sizes: list[int] = []  # the rooms that have bins, ascending
    runs, bins = [], 0

    def add(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append([first, number])

    for length in sorted(counts, reverse=True):
        to_place, rank = counts[length], 0
        while to_place:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                ranges = room[left]
                first, number = ranges.pop()
                if not ranges:
                    del room[left]
                    sizes.pop(at)
            else:
                left, first, number = capacity, bins, -(-to_place // (capacity // length))
                bins += number
            each = left // length
            full = min(number, to_place // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - left))
                add(left - each * length, first, full)
                rank, to_place = rank + full * each, to_place - full * each
            first, number = first + full, number - full
            if number and to_place:  # fewer than a bin takes are left
                runs.append((length, rank, to_place, to_place, first, capacity - left))
                add(left - to_place * length, first, 1)
                rank, to_place, first, number = rank + to_place, 0, first + 1, number - 1
            add(left, first, number)
    return runs


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity`` and ``tie`` columns to order
    equal lengths) with sequence_id and offset. ``pieces`` should be a written table, as
    it is read three times.

    Ranks: rows of a length are dealt over buckets by a hash of the tie columns, numbered
    within the bucket, and shifted by the counts of the buckets before; so a length that
    a third of all rows share makes no large task. One of the tie columns should number the
    rows, or equal rows share a bucket.
    """
    spark = pieces.sparkSession
    ties = [c for c in pieces.columns if c != "length"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.createDataFrame(plan_runs(counts, capacity), RUN)  # bounded by capacity, not by rows
    buckets = max(256, sum(counts.values()) // 50_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*ties), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*ties))
    ranked = dealt.withColumn("inside", inside - 1).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside")).withColumn("block", F.expr(f"rank div {BLOCK}"))
    slots = runs.withColumn("block", F.explode(F.expr(f"sequence(first_rank div {BLOCK}, (first_rank + n_pieces - 1) div {BLOCK})")))
    fits = (ranked["length"] == slots["length"]) & (ranked["block"] == slots["block"]) & (ranked["rank"] >= slots["first_rank"]) & (ranked["rank"] < slots["first_rank"] + slots["n_pieces"])
    step = F.col("rank") - F.col("first_rank")
    return ranked.join(slots, fits).select(
        *ties,
        ranked["length"],
        (F.col("first_bin") + F.expr("(rank - first_rank) div per_bin")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(step, F.col("per_bin")) * ranked["length"]).alias("offset"),
    )


def _cutter(file: TokenizerFile, end_id: int, capacity: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(file)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.frombuffer(own.packed(text) + end, dtype=own.dtype).astype("<u4")
                head = len(ids) % capacity or capacity
                edges = [0, *range(head, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return trimmed(cut)


def cut_documents(docs: DataFrame, tokenizer: TokenizerFile, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Documents longer than
    ``capacity`` are cut into whole pieces, what is left over going first. Ids pass Python
    as text, as pandas holds a long column with nulls in doubles."""
    cut = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(_cutter(tokenizer, end_id, capacity), "doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))


@scoped
def pack_documents(docs: DataFrame, tokenizer: TokenizerFile, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset: best-fit decreasing.

    Null texts are empty and give one piece, the end id. Null doc_ids and repeated rows
    are packed like any other; the order among equal pieces is by their columns. An
    empty table gives no pieces. Columns other than doc_id and text are ignored.
    """
    with bounded_batches(docs.sparkSession):
        pieces = materialise(cut_documents(docs, tokenizer, capacity, end_id).withColumn("number", F.monotonically_increasing_id()), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
