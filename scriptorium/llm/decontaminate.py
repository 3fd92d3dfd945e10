"""Benchmark decontamination as a prefix-filtered containment join.

An item's windows are its runs of ``size`` words (one window if it has fewer). A window's
tokens are its shingles of SHINGLE words (one shingle if it has fewer words), ordered by
how often texts have them. As a window must be contained whole, one token is a sufficient
prefix: the rarest. Texts' tokens are joined to these prefixes; a token's place in its
window bounds where the window would start and end in the text, and what is left is
compared word by word.

One pass over the documents finds the tokens they share with the benchmark. Up to
``limit`` distinct tokens are shipped to that pass as sorted hashes, 8 bytes each; beyond
it the pass hands on all tokens of a text, and they meet the benchmark's in a shuffled
join. All that follows is joins between written tables, broadcast only within ``limit``
counted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.columns import unused
from scriptorium.llm.text import bounded_batches, run_hashes, word_hashes, words
from scriptorium.plans.store import broadcast_if, counted, materialise, scoped, spread

SHINGLE = 4
#: Tokens or rows that are shipped or broadcast at most (8 to 200 bytes each).
LIMIT = 200_000
WINDOW = "item_id string, window binary, n int, tokens array<long>"


def _cutter(size: int, step: int = 20_000):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for item_id, body in zip(batch["item_id"], batch["body"]):
                found = words(body)
                hashes = word_hashes(found)
                n = min(size, len(found))
                tokens = run_hashes(hashes, min(SHINGLE, n)).view(np.int64)
                for i in range(len(found) - n + 1 if found else 0):
                    rows.append((item_id, b" ".join(found[i : i + n]), n, tokens[i : i + n - min(SHINGLE, n) + 1]))
                    if len(rows) == step:
                        yield pd.DataFrame(rows, columns=["item_id", "window", "n", "tokens"])
                        rows = []
        yield pd.DataFrame(rows, columns=["item_id", "window", "n", "tokens"])

    return cut


def benchmark_windows(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of the distinct windows (w, window, n, tokens) and of the items that
    have them (w, item_id). A null item_id is the empty string."""
    texts = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("body"))
    cut = materialise(texts.mapInPandas(_cutter(size), WINDOW).withColumn("w", F.unhex(F.md5("window"))), "item-windows")
    one = cut.groupBy("w").agg(F.first(F.struct("window", "n", "tokens")).alias("x")).select("w", "x.*")
    return materialise(one, "windows"), materialise(cut.select("w", "item_id").distinct(), "window-items")


def _scanner(vocabulary: np.ndarray | None, lengths: list[int]):
    """A column function of a text: n_words, and the places and hashes of its tokens that
    are in the sorted ``vocabulary``, or of all of them where that is None."""

    @F.pandas_udf("n_words long, places array<int>, tokens array<long>")
    def scan(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for body in bodies:
            found = words(body)
            hashes, places, tokens = word_hashes(found), [], []
            for n in lengths:
                own = run_hashes(hashes, n)
                at = np.arange(len(own))
                if vocabulary is not None and len(own):
                    at = np.flatnonzero(vocabulary[np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)] == own)
                places.append(at.astype(np.int32))
                tokens.append(own[at].view(np.int64))
            rows.append((len(found), np.concatenate(places) if places else np.empty(0, np.int32), np.concatenate(tokens) if tokens else np.empty(0, np.int64)))
        return pd.DataFrame(rows, columns=["n_words", "places", "tokens"])

    return scan


def _verifier():
    """A column function: whether each candidate (start, window) stands in a text word by
    word, and how many words lie in those that do."""

    @F.pandas_udf("holds array<boolean>, n_hit long")
    def verify(bodies: pd.Series, starts: pd.Series, windows: pd.Series) -> pd.DataFrame:
        rows = []
        for body, places, sought in zip(bodies, starts, windows):
            found = words(body)
            spans = [(int(a), w.split(b" ")) for a, w in zip(places, sought)]
            holds = [found[a : a + len(w)] == w for a, w in spans]
            hit, end = 0, 0
            for a, b in sorted((a, a + len(w)) for (a, w), ok in zip(spans, holds) if ok):
                hit += max(0, b - max(a, end))
                end = max(end, b)
            rows.append((holds, hit))
        return pd.DataFrame(rows, columns=["holds", "n_hit"])

    return verify


def scanned(docs: DataFrame, tokens: DataFrame, n_tokens: int, lengths: list[int], limit: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """A written row per row of ``docs``: of (the carry columns), content (MD5 of the text),
    n_words, places, tokens; ``tokens`` are the benchmark's, ``n_tokens`` of them."""
    vocabulary = np.sort(np.array([r["token"] for r in tokens.collect()], np.int64).view(np.uint64)) if n_tokens <= limit else None  # at most `limit`
    lengths = lengths if n_tokens else []
    body = F.coalesce("text", F.lit("")).cast("binary")
    of = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    return materialise(spread(docs).select(of.alias("of"), F.md5(body).alias("content"), _scanner(vocabulary, lengths)(body).alias("x")).select("of", "content", "x.*"), "scanned")


def _matches(docs: DataFrame, benchmark: DataFrame, size: int, limit: int, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame, int]:
    """(scanned, found, a bound of its spans): ``found`` has a row for each different text with a window of the
    benchmark: content, n_words, spans (start, length), n_hit, n_items, items_sha256."""
    with bounded_batches(docs.sparkSession):
        windows, items = benchmark_windows(benchmark, size)
        flat = windows.select("w", "n", F.posexplode("tokens").alias("place", "token"))
        tokens = materialise(flat.select("token").distinct(), "benchmark-tokens")
        n_tokens = tokens.count()
        lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE
        rows = scanned(docs, tokens, n_tokens, lengths, limit, carry)
        # Equal texts are one from here on; tasks drop their own repeats first.
        texts = rows.where(F.size("tokens") > 0).groupBy("content").agg(F.first(F.struct("n_words", F.arrays_zip("places", "tokens").alias("held"))).alias("x"))
        hits = texts.select("content", "x.n_words", F.explode("x.held").alias("t")).select("content", "n_words", F.col("t.places").alias("at"), F.col("t.tokens").alias("token"))
        if n_tokens > limit:
            hits = hits.join(tokens.hint("merge"), "token", "left_semi")
        hits = materialise(hits, "token-hits")
        # The rarest token of each window that texts have all tokens of.
        often = materialise(hits.groupBy("token").agg(F.count("*").alias("often")), "token-counts")
        known = flat.join(counted(often, limit), "token", "left").groupBy("w").agg(F.min(F.struct("often", "token", "place", "n")).alias("p"), F.max(F.col("often").isNull()).alias("absent"))
        prefixes = materialise(known.where("not absent").select("w", "p.token", "p.place", "p.n"), "prefixes")
        start = F.col("at") - F.col("place")
        near = hits.join(counted(prefixes, limit), "token").select("content", "n_words", "w", "n", start.alias("start")).where("start >= 0 and start + n <= n_words")
        near = materialise(near, "window-candidates")
        # A text's candidates are bounded by its own places.
        sought = near.join(broadcast_if(windows.select("w", "window"), windows.count(), limit), "w").groupBy("content", "n_words").agg(F.collect_list(F.struct("start", "n", "w", "window")).alias("c"))
        sought = materialise(sought, "texts-to-verify")
        body = F.coalesce("text", F.lit("")).cast("binary")
        bodies = docs.select(F.md5(body).alias("content"), body.alias("body")).join(counted(sought.select("content"), limit), "content", "left_semi").groupBy("content").agg(F.first("body").alias("body"))
        told = bodies.join(broadcast_if(sought, near.count(), limit), "content").select("content", "n_words", "c", _verifier()("body", "c.start", "c.window").alias("v"))
        told = told.where("v.n_hit > 0").select("content", "n_words", "c", "v.n_hit", "v.holds")
        kept = F.transform(F.filter(F.arrays_zip("c", "holds"), lambda x: x["holds"]), lambda x: x["c"])
        verified = materialise(told.select("content", "n_words", "n_hit", kept.alias("c")), "verified")
        named = verified.select("content", F.explode(F.array_distinct("c.w")).alias("w")).join(counted(items, limit), "w")
        listed = named.groupBy("content").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        spans = F.array_sort(F.array_distinct(F.transform("c", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("length")))))
        found = verified.join(listed, "content").select("content", "n_words", spans.alias("spans"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
        return rows, materialise(found, "contaminations"), near.count()


@scoped
def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, limit: int = LIMIT, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of each row of ``docs`` with n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, contaminated (n_hit > 0 and ``share`` *
    n_hit >= n_words) and spans (start, length) of the windows, null where there are none.

    Null and empty texts have no words and are clean; so is everything if the benchmark
    is empty. Repeated rows are judged alike, repeated items count once by id (a null id
    is the empty string). Only ``text`` and ``carry`` are read. What ``limit`` decides is
    the way, never the rows.
    """
    rows, found, n = _matches(docs, benchmark, size, limit, carry)
    full = rows.select("of", "content", "n_words").join(broadcast_if(found.drop("n_words"), n, limit), "content", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return full.select(
        *[F.col("of")[c].alias(c) for c in carry],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


@scoped
def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, limit: int = LIMIT) -> DataFrame:
    """``docs`` with all its columns, without the contaminated rows. Cases as in
    :func:`find_contamination`."""
    _, found, _ = _matches(docs, benchmark, size, limit, ())
    (own,) = unused(docs, "content")
    bad = materialise(found.where((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select(F.col("content").alias(own)), "contaminated-texts")
    held = docs.withColumn(own, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return held.join(counted(bad, limit), own, "left_anti").select(docs.columns)
