"""Entities by dictionary: names and aliases found in texts, longest first, and told as one entity.

Names are runs of words. A place of a text and a name meet on their first word, or first two
where the name has as many, so a common first word alone brings nothing together; then the
whole name is compared with the words that follow. Of the names at a place the longest
counts, and places that a chosen name covers start none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from scriptorium.operators.text import letters
from scriptorium.plans.store import broadcast_if, materialise, scoped, spread

#: Names up to this number are broadcast (about 200 bytes each); more are joined by a shuffle.
NAMES = 200_000


@F.pandas_udf(ArrayType(IntegerType()))
def _apart(places: pd.Series, lengths: pd.Series) -> pd.Series:
    """Which of the ascending places are chosen: those that no earlier chosen name reaches."""
    out = []
    for at, n in zip(places, lengths):
        end, chosen = -1, []
        for i, (place, length) in enumerate(zip(at, n)):
            if place >= end:
                end = place + length
                chosen.append(i)
        out.append(chosen)
    return pd.Series(out, dtype=object)


def _key(words: Column) -> Column:
    return F.array_join(F.slice(words, 1, 2), " ")


@scoped
def dictionary_mentions(documents: DataFrame, names: DataFrame, limit: int = NAMES) -> DataFrame:
    """(doc_id, place, n, entity): where names (``names``: entity, alias) stand in texts: the place
    of the first word, and how many words. Words are letter runs, in lower case. An alias of
    several entities is that of the least one. Null or wordless aliases, null entities and
    null texts give nothing; repeated rows of ``documents`` are texts of their own."""
    known = names.where("entity is not null").select("entity", letters("alias").alias("name")).where(F.size("name") > 0)
    known = materialise(known.groupBy("name").agg(F.min("entity").alias("entity")).withColumn("length", F.size("name")), "gazetteer")
    n, longest = known.agg(F.count("*"), F.coalesce(F.max("length"), F.lit(1))).head()
    rows = spread(documents).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), letters("text").alias("words"))
    flat = rows.select("row", "doc_id", "words", F.posexplode("words").alias("place", "w")).select("row", "doc_id", "place", F.slice("words", F.col("place") + 1, F.lit(longest)).alias("ahead"))
    # A name of one word is met by its own key, longer ones by that of two.
    keys = F.array_distinct(F.array(F.get("ahead", F.lit(0)), _key(F.col("ahead"))))
    keyed = flat.withColumn("key", F.explode(keys)).withColumn("single", ~F.col("key").contains(" "))
    listed = known.select(_key(F.col("name")).alias("key"), (F.col("length") == 1).alias("single"), "name", "entity", "length")
    met = keyed.join(broadcast_if(listed, n, limit), ["key", "single"]).where(F.slice("ahead", F.lit(1), F.col("length")) == F.col("name"))
    best = met.groupBy("row", "doc_id", "place").agg(F.max(F.struct("length", "entity")).alias("x"))
    held = F.array_sort(F.collect_list(F.struct("place", "x.length", "x.entity")))  # a text's own places
    texts = materialise(best.groupBy("row", "doc_id").agg(held.alias("m")), "dictionary-matches")
    chosen = texts.select("doc_id", "m", _apart("m.place", "m.length").alias("chosen")).select("doc_id", F.explode(F.transform("chosen", lambda i: F.get("m", i))).alias("x"))
    return chosen.select("doc_id", F.col("x.place").cast("long").alias("place"), F.col("x.length").cast("long").alias("n"), "x.entity")
