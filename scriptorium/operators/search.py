"""Keyword search over a written inverted index: BM25 (k1 = 1.2, b = 0.75,
idf = ln(1 + (N - df + 0.5) / (df + 0.5))), top-k within a scope, and rank fusion.

N, df and the mean length are those of the whole corpus; a scope is applied to the
matches before anything is ranked. An index is a folder of Parquet tables:

- ``postings`` (w, row, doc_id, tf, dl and scope columns), a row per word and document,
  in ranges of (w, row), so that a query's words are found by the files' statistics and
  a word that all documents have is spread over many files;
- ``terms`` (w, df, cf), in ranges of w;
- ``stats`` (N, avgdl), one row.

Documents are told apart by ``row``, so null and repeated doc_ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators.text import gathered, letters
from scriptorium.plans.store import broadcast_if, drop_path, materialise, materialise_to, spread

K1, B = 1.2, 0.75
#: Distinct terms up to this number are broadcast (about 60 bytes each).
TERMS = 500_000
#: Words of queries that each task holds at most, hits of a task, and hits that are added up at once.
ASKED, HITS, PIECE = 500_000, 50_000_000, 1_000_000


@dataclass(frozen=True)
class Index:
    """An index that :func:`build_index` wrote."""

    spark: SparkSession
    path: str
    scope: tuple[str, ...] = ()

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        more = "".join(f", {c} string" for c in self.scope)
        return self._table("postings", f"w string, row long, doc_id long, tf long, dl long{more}")

    @property
    def terms(self) -> DataFrame:
        return self._table("terms", "w string, df long, cf long")

    @property
    def stats(self) -> DataFrame:
        return self._table("stats", "N long, avgdl double")


def build_index(documents: DataFrame, path: str, scope: tuple[str, ...] = ()) -> Index:
    """Write the index of ``documents`` (doc_id, text and ``scope`` columns, kept as
    strings). Texts are cut once; one exchange, of the postings, puts them in order. Null
    texts have no words and count in N."""
    spark = documents.sparkSession
    rows = spread(documents).select(F.monotonically_increasing_id().alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in scope]).alias("of"), F.coalesce(letters("text"), F.array().cast("array<string>")).alias("words"))
    cut = rows.select("row", "of.*", F.size("words").cast("long").alias("dl"), "words")
    flat, temporary = materialise_to(gathered(cut, "words").select("w", "row", "doc_id", F.size("places").cast("long").alias("tf"), "dl", *scope), "index-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat.repartitionByRange(parts, "w", "row").sortWithinPartitions("w", "row").write.parquet(f"{path}/postings")
    index = Index(spark, path, scope)
    terms = index.postings.groupBy("w").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms.repartitionByRange(parts, "w").sortWithinPartitions("w").write.parquet(f"{path}/terms")
    # A text's tf add up to its dl, so the texts with words are counted without telling rows apart.
    lengths = flat.agg(F.sum("tf").alias("words"), F.round(F.sum(F.col("tf") / F.col("dl"))).alias("said"))
    lengths.crossJoin(documents.agg(F.count("*").alias("N"))).select("N", (F.col("words") / F.col("said")).alias("avgdl")).write.parquet(f"{path}/stats")
    drop_path(spark, temporary)
    return index


def inverted_index(index: Index) -> DataFrame:
    """(w, doc_id, tf, df, dl): every posting with its word's document frequency and its
    document's length."""
    terms = index.terms.select("w", "df")
    return index.postings.join(broadcast_if(terms, terms.count(), TERMS), "w").select("w", "doc_id", "tf", "df", "dl")


def _weight(tf: Column, df: Column) -> Column:
    idf = F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25(index: Index, terms: list[str], scope: Column | None = None) -> DataFrame:
    """(doc_id, score) of documents with any of the query's ``terms``, added up in the
    query's order. Only the query's words are read: they are a filter on the scan."""
    wanted = sorted(set(terms))
    hits = index.postings.where(F.col("w").isin(wanted))
    hits = hits.where(scope) if scope is not None else hits
    df = index.terms.where(F.col("w").isin(wanted)).select("w", "df")  # a row a term of the query
    weighed = hits.join(F.broadcast(df), "w").crossJoin(F.broadcast(index.stats)).select("row", "doc_id", "w", _weight(F.col("tf").cast("double"), F.col("df").cast("double")).alias("x"))
    parts = [F.max(F.when(F.col("w") == t, F.col("x"))).alias(f"x{i}") for i, t in enumerate(wanted)]
    score = F.lit(0.0)
    for t in terms:
        score = score + F.coalesce(F.col(f"x{wanted.index(t)}"), F.lit(0.0))
    return weighed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *parts).select("doc_id", score.alias("score"))


def keywords(index: Index, queries: DataFrame, n: int, least: int = 2) -> DataFrame:
    """(q, w): for each query document (``queries``: q, its doc_id) its ``n`` rarest words that
    stand in at least ``least`` documents, ties by w."""
    terms = index.terms.where(F.col("df") >= least).select("w", "df")
    asked = queries.select(F.col("q").alias("doc_id"), "q")
    own = index.postings.join(broadcast_if(asked, asked.count(), TERMS), "doc_id").select("q", "w")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("df", "w"))
    return own.join(terms, "w").distinct().withColumn("k", rank).where(F.col("k") <= n).select("q", "w", "df")


def _best_of(starts: np.ndarray, asking: np.ndarray, names: np.ndarray, k: int):
    """Each query's ``k`` best of the texts of a task, from postings (t, row, doc_id, x) in order of
    row. Word t is asked for by the queries ``asking[starts[t] : starts[t + 1]]``, numbers of ``names``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.full(len(names), np.iinfo(np.int64).min)
        held, size = [], 0

        def cut():
            """What is held, with no more than the k best of a query."""
            nonlocal held, size
            q, score, told, doc = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((doc, told, -score, q))
            q = q[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            kept = rank < k
            bound[q[rank == k - 1]] = score[order][rank == k - 1]
            held = [(q[kept], *(c[order][kept] for c in (score, told, doc)))]
            size = int(kept.sum())

        def add(t, row, told, doc, x):
            nonlocal size
            n = starts[t + 1] - starts[t]
            new = np.append(True, row[1:] != row[:-1])
            firsts, number = np.flatnonzero(new), np.cumsum(new) - 1
            before, begin = np.append(0, np.cumsum(n))[np.append(firsts, len(row))], 0
            while begin < len(firsts):  # texts whose hits are PIECE together, or one text
                end = max(begin + 1, int(np.searchsorted(before, before[begin] + PIECE, "right")) - 1)
                one = slice(firsts[begin], firsts[end] if end < len(firsts) else len(row))
                m = n[one]
                place = np.arange(m.sum()) + np.repeat(starts[t[one]] - (np.cumsum(m) - m), m)
                key = asking[place] * (end - begin) + np.repeat(number[one] - begin, m)
                order = np.argsort(key)
                key, weight = key[order], np.repeat(x[one], m)[order]
                edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                score, (q, text) = np.add.reduceat(weight, edge), np.divmod(key[edge], end - begin)
                good = score >= bound[q]
                at = firsts[begin + text[good]]
                held.append((q[good], score[good], told[at], doc[at]))
                size += len(at)
                begin = end
                if size > 2 * len(names) * k + PIECE:
                    cut()

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id")
            columns = [batch.column("t").to_numpy(), batch.column("row").to_numpy(), pc.is_valid(doc).to_numpy(zero_copy_only=False), pc.fill_null(doc, 0).to_numpy(), batch.column("x").to_numpy()]
            if rest:
                columns = [np.concatenate(c) for c in zip(rest, columns)]
            last = int(np.searchsorted(columns[1], columns[1][-1]))
            if last:
                add(*[c[:last] for c in columns])
            rest = [c[last:] for c in columns]
        if rest:
            add(*rest)
            cut()
            (q, score, told, doc), = held
            for i in range(0, len(q), 100_000):
                one = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[q[one]]), pa.array(doc[one], mask=~told[one]), pa.array(score[one])], ["q", "doc_id", "score"])

    return scan


def bm25_many(index: Index, queries: DataFrame, k: int, scope: str | None = None, limit: int = ASKED) -> DataFrame:
    """(q, doc_id, rank): the ``k`` best documents of each query (``queries``: q, w, df), ties by
    doc_id. Weights are summed in whole millionths, so that ranks do not hang on the order
    of addition. Queries are joined to the postings on the word; with ``scope``, a scope
    column of the index that ``queries`` has too, on that as well.

    The postings of the queries' words are exchanged by text, once, and tasks add them up for each
    query that asks for them and tell its k best: a query's hits, which grow with the queries
    times the texts, are never exchanged, unless queries have more than ``limit`` words."""
    on = ["w", scope] if scope else ["w"]
    asked = materialise(queries.select(F.col("q").cast("long").alias("q"), *[F.col(c).cast("string").alias(c) for c in on], "df").where(" and ".join(f"{c} is not null" for c in ("q", *on))), "asked")
    n, in_all = asked.agg(F.count("*"), F.sum("df")).head()
    weight = F.floor(_weight(F.col("tf").cast("double"), F.col("df").cast("double")) * 1000000)
    if n > limit:
        hits = index.postings.join(asked.hint("merge"), on).crossJoin(F.broadcast(index.stats))
        best = hits.groupBy("q", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(weight).alias("score"))
    else:
        words = asked.toPandas()
        t = words.groupby([*on, "df"], sort=False).ngroup().to_numpy()
        names, q = np.unique(words["q"].to_numpy(np.int64), return_inverse=True)
        starts = np.append(0, np.cumsum(np.bincount(t, minlength=1)))
        first = np.unique(t, return_index=True)[1]
        table = words.iloc[first][[*on, "df"]].assign(t=t[first])
        asks = asked.sparkSession.createDataFrame(table, f"{', '.join(f'{c} string' for c in on)}, df long, t long")
        hits = index.postings.join(F.broadcast(asks), on).crossJoin(F.broadcast(index.stats)).select("t", "row", "doc_id", weight.alias("x"))
        tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-(in_all or 0) // HITS))
        best = hits.repartition(tasks, "row").sortWithinPartitions("row").mapInArrow(_best_of(starts, q[np.argsort(t, kind="stable")], names, k), "q long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("q", "doc_id", "rank")


def topk(scores: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows with their rank, ties by key."""
    best = scores.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def rank_fusion(lists: list[DataFrame], key: str = "doc_id", constant: int = 60, query: tuple[str, ...] = ()) -> DataFrame:
    """(query columns, key, score): sum over rankings of 1 / (constant + rank) (reciprocal
    rank fusion, SIGIR 2009). Only ranks count: rescaling a list's scores changes nothing."""
    parts = [ranked.select(*query, key, (1.0 / (constant + F.col("rank"))).alias("part")) for ranked in lists]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*query, key).agg(F.sum("part").alias("score"))
