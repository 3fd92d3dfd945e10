"""Context assembly: overlap with known passages, and packing ranked passages to a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.blocks import before, ranged, with_carried
from scriptorium.plans.store import counted, materialise, scoped, spread

SEPARATORS = r"[^\p{L}\p{N}]+"
#: Characters of a key of passages without an inner word.
GRAM = 3


def _finder(passages: list[str]):
    """A column function: which passages stand in a text, by one automaton over them all."""

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        known = ahocorasick.Automaton()
        for i, passage in enumerate(passages):
            known.add_word(passage, i)
        known.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({i for _, i in known.iter(text)}) for text in texts])

    return find


def _keys(text: str) -> Column:
    """What a text can be found by: its words, and its runs of 1 to GRAM characters."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))), lambda i: F.concat(F.lit("\n"), *[F.coalesce(F.when(n > k, F.get(chars, i + (k - 1))), F.lit("")) for k in range(GRAM)]))))
    return F.array_distinct(F.concat(F.split(text, SEPARATORS), runs))


def _joined(documents: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """The (doc_id, passage) pairs by joins alone: a word inside a passage (not its first or
    last) stands whole in any text that holds the passage, so texts and passages meet on
    the longest such word, or, without one, on the passage's first characters. Texts are
    known by digest, so null and repeated doc_ids do no harm."""
    words = F.split("passage", SEPARATORS)
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda x: x != "")
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    keyed = known.select("passage", F.coalesce(longest, F.concat(F.lit("\n"), F.substring("passage", 1, GRAM))).alias("w"))
    told = documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "text")
    chars = keyed.where(F.col("w").startswith("\n")).isEmpty()
    keys = F.array_distinct(F.split("text", SEPARATORS)) if chars else _keys("text")
    meet = told.select("h", F.explode(keys).alias("w")).join(counted(keyed, limit), "w").select("h", "passage").distinct()
    meet = materialise(meet, "overlap-candidates")
    texts = told.select("h", "text").join(counted(meet.select("h").distinct(), limit), "h", "left_semi").dropDuplicates(["h"])
    found = materialise(texts.join(meet, "h").where(F.contains("text", "passage")).select("h", "passage"), "overlap-found")
    return told.select("doc_id", "h").join(counted(found, limit), "h").select("doc_id", "passage")


@scoped
def continuity_overlap(documents: DataFrame, passages: DataFrame, limit: int = 100_000, limit_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): passages that stand verbatim in a document, for every row of either.

    Distinct passages up to ``limit`` and ``limit_chars`` in all go to the tasks as one
    automaton (40 bytes a character), which reads each text once where it is. More are joined on keys. Null and
    empty passages, and null texts, match nothing."""
    known = materialise(passages.where("text is not null and text <> ''").select("item_id", F.col("text").alias("passage")), "passages")
    distinct = known.select("passage").distinct()
    n, chars = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("passage")), F.lit(0))).head()
    if n <= limit and chars <= limit_chars:
        rows = [r["passage"] for r in distinct.collect()]  # at most `limit`
        found = _finder(rows)("text") if rows else F.array().cast("array<int>")
        held = spread(documents.where("text is not null")).select("doc_id", found.alias("found"))
        numbered = known.sparkSession.createDataFrame(list(enumerate(rows)), "i int, passage string")
        pairs = held.select("doc_id", F.explode("found").alias("i")).join(F.broadcast(numbered), "i").select("doc_id", "passage")
    else:
        pairs = _joined(documents.where("text is not null").select("doc_id", "text"), distinct, limit)
    return pairs.join(counted(known, limit), "passage").select("doc_id", "item_id")


@scoped
def context_pack(ranked: DataFrame, budget: int, group: str = "source", size: str = "n_chars", order: tuple[str, ...] = ("n_chars", "doc_id")) -> DataFrame:
    """(doc_id, used): per group the ranked passages until the budget is used up.

    Rows lie in ranges of (group, order). A range whose start is beyond the budget is left
    out unread, and each other one is a window that runs on from the ranges before it."""
    columns = dict.fromkeys((group, *order, size, "doc_id"))
    rows = ranged(ranked.select(*columns), (group,), order, "ranked")
    totals = rows.groupBy(group, "block").agg(F.sum(size).alias("x"), F.sum(F.least(F.col(size), F.lit(0))).alias("least"))
    carried = totals.select(group, "block", "least", before((group,), "x").alias("start"))
    carried = carried.where(F.col("start").isNull() | (F.col("start") + F.coalesce("least", F.lit(0)) <= budget)).drop("least")
    own = F.sum(size).over(Window.partitionBy(group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    run = with_carried(rows, carried, (group,)).withColumn("own", own)
    return run.select("doc_id", F.coalesce(F.col("start") + F.col("own"), "start", "own").alias("used")).where(F.col("used") <= budget)
