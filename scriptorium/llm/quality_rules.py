"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed, and the distinct documents that hold a line are counted
per host. A line of too many documents is boilerplate and is removed; a document of which
too little is left is rejected, as are texts that fail the base rules on their own.

Documents are distinct by their whole texts: exact copies count once. Near copies are
documents of their own, so the lines of an article that one host has in more versions
than ``Limits.max_docs`` are removed like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.columns import unused
from scriptorium.plans.store import counted, materialise, scoped

SPACES = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Limits:
    """A line is removed if it stands in more than ``max_docs`` distinct documents of a
    host, whatever the host's size. A document is depleted if more than
    ``max_removed_share`` of its words are removed."""

    max_docs: int = 20
    max_removed_share: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


#: Tables of lines or documents up to this many rows are broadcast (under 100 bytes each).
SMALL = 50_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_hash(line: Column) -> Column:
    """MD5 of a line in lower case (A-Z), its runs of white space as one, ends trimmed."""
    plain = F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACES, " "))
    return F.unhex(F.md5(plain.cast("binary")))


def measured(docs: DataFrame, host: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of ``docs``: ``carry``, host, content (MD5 of the text), row_id, the
    base measures, and lines (h, n words) of every line with a word.

    Windows of three words are compared by 64-bit hashes from whose low bits the position
    is cut, as few as the text's length needs."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*carry, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    split = base.select("*", _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(A_WORD)).alias("raw"))
    n = F.size("words")
    sized = split.withColumn("n", n).withColumn("mask", F.expr("shiftleft(1L, length(bin(n))) - 1"))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    marked = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: window(i).bitwiseAND(F.bitwise_not("mask")).bitwiseOR(i.cast("long")))
    grams = sized.withColumn("grams", F.sort_array(F.when(F.col("n") >= 3, marked).otherwise(F.array().cast("array<bigint>"))))
    high = lambda x: x.bitwiseAND(F.bitwise_not("mask"))
    equal = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))
    twice = F.filter("grams", lambda x, i: equal(x, F.get("grams", i - 1)) | equal(x, F.get("grams", i + 1)))
    places = grams.withColumn("twice", twice).withColumn("places", F.sort_array(F.transform("twice", lambda x: x.bitwiseAND(F.col("mask")))))
    covered = F.aggregate(F.transform("places", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("places", i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return places.select(
        *carry,
        "host",
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("content"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.transform("raw", lambda x: F.struct(line_hash(x).alias("h"), F.size(_words(x)).alias("n"))).alias("lines"),
    )


def frequent_lines(table: DataFrame, limits: Limits) -> DataFrame:
    """(host, h) of the lines to remove, from a written table of :func:`measured` rows.

    Rows are counted first, as a line in few rows is in few documents; only lines with
    enough of them are counted by distinct contents. Both counts combine within tasks
    before they are exchanged, so a line that all documents of a host have is a row a task
    in the first, and a row a document, dealt by content, in the second."""
    rows = table.select("host", F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    often = materialise(rows.where(F.col("n") > limits.max_docs).select("host", "h"), "often-lines")
    held = table.select("host", "content", F.explode(F.array_distinct("lines.h")).alias("h"))
    close = held.join(counted(often, SMALL), ["host", "h"]).groupBy("host", "h", "content").agg(F.lit(1))
    counts = close.groupBy("host", "h").agg(F.count("*").alias("docs"))
    return materialise(counts.where(F.col("docs") > limits.max_docs).select("host", "h"), "frequent-lines")


@scoped
def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """A row per row of ``docs`` (text, ``host`` and ``carry`` columns): ``carry``, host,
    content, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_words, removed (hashes of the lines to remove) and kept.

    Null texts have no words and fail the base rules; a null host is the host ''. Repeated
    rows are one document in counts and each get a row. An empty table gives no rows.
    Columns not named are ignored. The line table is written once, without the texts.
    Tables of lines and of rows that lose some are broadcast up to SMALL rows, counted;
    beyond it joins are shuffled, and AQE splits a line or host with very many rows."""
    table = materialise(measured(docs, host, carry), "measured")
    frequent = frequent_lines(table, limits)
    gone = table.select("row_id", "host", F.explode("lines").alias("x")).select("row_id", "host", "x.h", "x.n").join(counted(frequent, SMALL), ["host", "h"])
    # A document's removed lines are at most its own lines, so the set is bounded by a text.
    removed = materialise(gone.groupBy("row_id").agg(F.sum("n").alias("n_removed_words"), F.collect_set("h").alias("removed")), "removed-lines")
    full = table.drop("lines").join(counted(removed, SMALL), "row_id", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    depleted = F.col("n_removed_words") > limits.max_removed_share * F.col("n_words")
    return full.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row_id")


@scoped
def clean(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:  # noqa: B008
    """``docs`` with all its columns, without the rejected documents, and without the
    removed lines in ``text`` (and in n_chars, where there is one). Other texts are left as
    they are. Verdicts depend on host and text alone, and are joined on a digest of both.
    Null texts, repeated rows, empty tables: as in :func:`judge`."""
    own_key, own_kept, own_gone = unused(docs, "key", "kept", "gone")
    key = lambda h, c: F.unhex(F.md5(F.concat(c, F.coalesce(h.cast("string"), F.lit("")).cast("binary"))))
    told = judge(docs, limits, host, carry=()).where("not kept or n_removed_words > 0")
    acts = told.select(key(F.col("host"), F.col("content")).alias(own_key), F.col("kept").alias(own_kept), F.when(F.col("kept"), F.col("removed")).alias(own_gone))
    acts = materialise(acts.dropDuplicates([own_key]), "line-acts")
    content = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # The acts grow with the corpus, so they are never broadcast, however few.
    joined = docs.withColumn(own_key, key(F.col(host), content)).join(acts.hint("merge"), own_key, "left").where(F.coalesce(F.col(own_kept), F.lit(True)))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(A_WORD) | ~F.array_contains(own_gone, line_hash(x))), "\n")
    out = joined.withColumn("text", F.when(F.col(own_gone).isNotNull(), left).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(own_gone).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
