"""Phrase and proximity search over written positional postings.

``positions`` (w, row, doc_id, places and scope columns) has a row per word and document, in
ranges of (w, row): a query reads the files of its words alone, told by their statistics.
``places`` are the word's ascending places in the text; Parquet stores them as differences
(DELTA_BINARY_PACKED), so a place takes a byte or two. Documents are told apart by ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.text import gathered, letters
from scriptorium.plans.store import drop_path, materialise_to, spread

#: Writer options under which Parquet keeps ascending integers as packed differences.
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element": "false"}


@dataclass(frozen=True)
class Positions:
    """Positional postings that :func:`build_positions` wrote."""

    spark: SparkSession
    path: str
    scope: tuple[str, ...] = ()

    @property
    def postings(self) -> DataFrame:
        more = "".join(f", {c} string" for c in self.scope)
        return self.spark.read.schema(f"w string, row long, doc_id long, places array<int>{more}").parquet(self.path)


def build_positions(documents: DataFrame, path: str, scope: tuple[str, ...] = ()) -> Positions:
    """Write the positional postings of ``documents`` (doc_id, text and ``scope`` columns, kept
    as strings). Tasks gather what a text has of a word where they read it; one exchange puts
    that in order. Null texts have no words."""
    spark = documents.sparkSession
    kept = [F.col(c).cast("string").alias(c) for c in scope]
    rows = spread(documents).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *kept, F.coalesce(letters("text"), F.array().cast("array<string>")).alias("words"))
    held, temporary = materialise_to(gathered(rows, "words").select("w", "row", "doc_id", "places", *scope), "position-rows", **DELTA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held.repartitionByRange(parts, "w", "row").sortWithinPartitions("w", "row").write.options(**DELTA).parquet(path)
    drop_path(spark, temporary)
    return Positions(spark, path, scope)


def _hits(index: Positions, words: list[str], scope: Column | None) -> DataFrame:
    hits = index.postings.where(F.col("w").isin(sorted(set(words))))
    return hits.where(scope) if scope is not None else hits


def _gathered(index: Positions, wanted: list[str], scope: Column | None) -> DataFrame:
    """(row, doc_id, p0, p1, ...): the documents that have all of the words, with each one's places."""
    places = [F.max(F.when(F.col("w") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(wanted)]
    return _hits(index, wanted, scope).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("found"), *places).where(F.col("found") == len(wanted)).drop("found")


def _marked(places: str, word: int) -> Column:
    return F.transform(places, lambda x: F.struct(x.alias("at"), F.lit(word).alias("word")))


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def phrase(index: Positions, words: list[str], scope: Column | None = None) -> DataFrame:
    """(doc_id, n, first): documents in which ``words`` stand one after the other, how often,
    and the first place. A document's places are shifted by each word's offset in the
    phrase and intersected. Occurrences may overlap; no words give no rows."""
    wanted = sorted(set(words))
    if not wanted:
        return index.postings.where("false").select("doc_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first"))
    rows = _gathered(index, wanted, scope)
    shifted = [_shifted(f"p{wanted.index(t)}", offset) for offset, t in enumerate(words)]
    starts = shifted[0]
    for more in shifted[1:]:
        starts = F.array_intersect(starts, more)
    return rows.select("doc_id", starts.alias("starts")).where(F.size("starts") > 0).select("doc_id", F.size("starts").cast("long").alias("n"), F.array_min("starts").cast("long").alias("first"))


def near(index: Positions, words: list[str], within: int, scope: Column | None = None) -> DataFrame:
    """(doc_id, span): documents in which all of ``words``, in any order, stand within ``within``
    words of each other, and the least such span: from the first to the last, both counted.

    Only documents that have all of the words are looked into: their places are put in order and
    gone through once, with the last place of each word so far, so the work is in proportion
    to the places."""
    wanted = sorted(set(words))
    if not wanted:
        return index.postings.where("false").select("doc_id", F.lit(0).cast("long").alias("span"))
    rows = _gathered(index, wanted, scope)
    said = F.concat(*[_marked(f"p{i}", i) for i in range(len(wanted))])
    # The span that ends at a place is whole once every word has stood; before that it is too wide.
    lasts = F.struct(*[F.lit(-(2**30)).alias(f"l{i}") for i in range(len(wanted))], F.lit(2**30).alias("span"))

    def step(state: Column, x: Column) -> Column:
        seen = [F.when(x["word"] == i, x["at"]).otherwise(state[f"l{i}"]) for i in range(len(wanted))]
        first = F.least(*seen) if len(seen) > 1 else seen[0]
        return F.struct(*[c.alias(f"l{i}") for i, c in enumerate(seen)], F.least(state["span"], x["at"] - first + 1).alias("span"))

    spans = rows.select("doc_id", F.aggregate(F.sort_array(said), lasts, step, lambda state: state["span"]).cast("long").alias("span"))
    return spans.where(F.col("span") <= F.least(F.lit(within), F.lit(2**29)))
