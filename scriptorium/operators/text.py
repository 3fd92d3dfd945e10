"""Text of notes: plain text and outlines from html, normal forms, tokens, entities,
contact data, and extractive summaries. Built-in functions but for the grouping of a row's
own words, which higher-order functions do slowly."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from scriptorium.plans.store import broadcast_if, spread

if TYPE_CHECKING:
    from scriptorium.operators.search import Index


def letters(text: Column | str) -> Column:
    """The letter runs of a lower-cased text, in order; null of null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def html_to_text(pages: DataFrame) -> DataFrame:
    """(page_id, text_len): length of the html with its tags removed."""
    return pages.select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("text_len"))


def outline(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text): headings and list items in the order of the page. The
    text runs up to the next tag; inner tags end it."""
    tags = F.regexp_extract_all("html", F.lit(r"<(?:h[1-6]|li)[^>]*>[^<]*"), F.lit(0))
    found = pages.select("page_id", F.posexplode(tags).alias("p", "tag"))
    return found.select("page_id", F.col("p").cast("long").alias("pos"), F.regexp_extract("tag", r"^<(h[1-6]|li)", 1).alias("kind"), F.regexp_extract("tag", r">([^<]*)$", 1).alias("text"))


def normalize_text(documents: DataFrame) -> DataFrame:
    """(doc_id, text): lower case, runs of white space as one space, ends trimmed."""
    return documents.select("doc_id", F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")).alias("text"))


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, w): a row per letter run of the lower-cased text."""
    return documents.select("doc_id", F.explode(letters("text")).alias("w"))


MENTION = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"


def mentions(documents: DataFrame) -> DataFrame:
    """(doc_id, surface): runs of two capitalised words or more."""
    return documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))).alias("surface"))


def entity_mentions(documents: DataFrame) -> DataFrame:
    return mentions(documents).groupBy("surface").agg(F.count("*").alias("n"))


def entity_cooccurrence(documents: DataFrame) -> DataFrame:
    """(a, b, n): documents in which both entities occur, a < b. Pairs are formed inside a
    document's own set of entities, so no row crosses documents."""
    sets = documents.select(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)))).alias("s")).where(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def pii_flags(documents: DataFrame) -> DataFrame:
    """(doc_id, n_emails) of documents with an email-like string."""
    found = documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).cast("long").alias("n_emails"))
    return found.where("n_emails > 0")


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): the text cut after . ! or ? and white space."""
    return documents.select("doc_id", F.posexplode(_cut("text")).alias("pos", "sentence")).where("trim(sentence) <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def _cut(text: str) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\x01"), "\x01")


#: Words that a task holds at once, however many texts a batch has.
PIECE = 100_000


def gathered(texts: DataFrame, words: str) -> DataFrame:
    """``texts`` with a row per distinct word of each row, in place of its array ``words``: ``w``, and
    ``places``, the ascending places of the word from 0. Where ``words`` is an array of
    arrays, a place is that of the inner array, as often as it has the word.

    Rows are grouped where they are read, in Arrow, a piece of at most PIECE words (or one text)
    after the other; nothing is exchanged."""
    nested = isinstance(texts.schema[words].dataType.elementType, ArrayType)
    kept = [f for f in texts.schema.fields if f.name != words]

    def groups(piece: pa.RecordBatch) -> pa.RecordBatch:
        column = piece.column(words)
        row, w = pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column)
        first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())])
        place = np.arange(len(row)) - first[row]
        if nested:
            inner, w = pc.list_parent_indices(w).to_numpy(), pc.list_flatten(w)
            row, place = row[inner], place[inner]
        flat = pa.table({"row": row.astype(np.int64), "w": w, "places": place.astype(np.int32)})
        told = flat.group_by(["row", "w"], use_threads=False).aggregate([("places", "list")]).combine_chunks()
        columns = [piece.column(f.name).take(told["row"].combine_chunks()) for f in kept]
        return pa.RecordBatch.from_arrays([*columns, told["w"].combine_chunks(), told["places_list"].combine_chunks()], [*[f.name for f in kept], "w", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(words)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            if nested:
                within = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(pc.list_flatten(column)), 0).to_numpy())])
                ends = np.cumsum(sizes)
                sizes = within[ends] - within[ends - sizes]
            number, start = np.cumsum(sizes), 0
            while start < batch.num_rows:
                before = number[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(number, before + PIECE, side="right")))
                piece = groups(batch.slice(start, end - start))
                if piece.num_rows:
                    yield piece
                start = end

    return texts.mapInArrow(gather, StructType([*kept, StructField("w", StringType()), StructField("places", ArrayType(IntegerType()))]))


def extractive_summary(documents: DataFrame, index: Index, k: int = 3, limit: int = 500_000) -> DataFrame:
    """(doc_id, pos, rank, score): the k sentences of greatest summed tf * idf per document,
    where tf counts in the document, and idf is ln(1 + N / df), with N and df those of
    ``index``. Scores are in millionths, summed as integers, so that ties do not hang on the
    order of addition.

    A document's words are counted and dealt to its sentences where it is read. Up to
    ``limit`` terms are broadcast: then a row a sentence is all that is exchanged. Beyond
    that words are joined by a shuffle."""
    cut = F.transform(_cut("text"), letters)
    said = spread(documents).where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", cut.alias("said"))
    own = gathered(said, "said").select("row", "doc_id", "w", F.size("places").alias("tf"), F.array_distinct("places").alias("places"))
    terms = index.terms.select("w", "df").crossJoin(F.broadcast(index.stats)).select("w", F.floor(F.log(1 + F.col("N") / F.col("df")) * 1000000).alias("idf"))
    weighed = own.join(broadcast_if(terms, index.terms.count(), limit), "w").select("row", "doc_id", F.explode("places").alias("pos"), (F.col("tf") * F.col("idf")).alias("x"))
    scored = weighed.groupBy("row", "doc_id", "pos").agg(F.sum("x").cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", "pos", "rank", "score")
