"""Product-quantised vectors: a vector is PARTS bytes, the nearest code word of each of its parts.

Code words are fitted to a bounded sample; every vector is coded. A query is compared with
codes alone: its products with all code words are a small table, and a vector's similarity
is a sum of PARTS of its entries. The best by codes are ranked by their own vectors in the same
task: which they are is told by a bound that each query has from the coded sample, so no
candidate is ever exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.vectors import BLOCK, QUERIES, _best, _nearest, _plain, _ranked, packed
from scriptorium.plans.store import broadcast_if, hashed_sample

PARTS, WORDS = 8, 256
CODED = "ids binary, matrix binary, vectors binary"
#: Queries whose similarities to a block are held at once.
CHUNK = 64


@dataclass(frozen=True)
class Pq:
    """``books`` (PARTS, WORDS, dimensions of a part); ``share`` of all vectors that must be ranked
    by themselves for the recall that was fitted; ``n`` vectors in all; ``sample``, the coded sample."""

    spark: SparkSession
    path: str
    books: np.ndarray
    sample: np.ndarray
    share: float
    n: int

    @property
    def codes(self) -> DataFrame:
        """Blocks of ids, codes and the vectors themselves, each a column."""
        return self.spark.read.schema(CODED).parquet(self.path)


def _parts(vectors: np.ndarray) -> np.ndarray:
    """(vectors, PARTS, dimensions of a part), with zeros to fill the last."""
    more = -vectors.shape[1] % PARTS
    return np.pad(vectors, ((0, 0), (0, more))).reshape(len(vectors), PARTS, -1)


def _books(sample: np.ndarray, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means of each part; with fewer vectors than words some words repeat."""
    rng, out = np.random.default_rng(seed), []
    for part in _parts(sample).transpose(1, 0, 2):
        words = part[rng.choice(len(part), WORDS, replace=len(part) < WORDS)]
        for _ in range(rounds):
            near = ((words**2).sum(axis=1)[None, :] - 2 * part @ words.T).argmin(axis=1)
            sums, counts = np.zeros_like(words), np.bincount(near, minlength=WORDS)
            np.add.at(sums, near, part)
            words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        out.append(words)
    return np.stack(out)


def _coded(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts = _parts(vectors)
    return np.stack([((books[m] ** 2).sum(axis=1)[None, :] - 2 * parts[:, m] @ books[m].T).argmin(axis=1) for m in range(PARTS)], axis=1).astype(np.uint8)


def _looked_up(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Similarities of queries and coded vectors, from tables of PARTS * WORDS products."""
    parts, out = _parts(queries), np.zeros((len(queries), len(codes)))
    for m in range(PARTS):
        out += (parts[:, m] @ books[m].T)[:, codes[:, m]]
    return out


def _reach(sample: np.ndarray, books: np.ndarray, k: int, target: float, queries: int = 500) -> float:
    """The share of the sample, best first by codes, that holds ``target`` of the k nearest."""
    asked = sample[:queries]
    exact, own = asked @ sample.T, np.arange(len(asked))
    by_codes = _looked_up(asked, _coded(sample, books), books)
    exact[own, own] = by_codes[own, own] = -np.inf
    near = np.argsort(-exact, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    place = np.argsort(np.argsort(-by_codes, axis=1), axis=1)
    return (int(np.quantile(np.take_along_axis(place, near, axis=1), target, method="higher")) + 1) / len(sample)


def build_pq(vectors: DataFrame, path: str, sample: int = 20_000, block: int = 16 * BLOCK, k: int = 10, target: float = 0.97) -> Pq:
    """Code every vector of ``vectors`` (vec_id, embedding). Code words, and how far down the order
    by codes the ``k`` nearest lie, are fitted to at most ``sample`` vectors, drawn by a hash
    of vec_id. Rows without id or vector are left out; all vectors are of one length."""
    spark, rows = vectors.sparkSession, _plain(vectors)
    drawn = hashed_sample(rows, "vec_id", sample)
    held = np.array([r["embedding"] for r in drawn], np.float64)
    books = _books(held) if drawn else np.zeros((PARTS, WORDS, 1))
    share = _reach(held, books, k, target) if drawn else 1.0

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [_coded((own := np.stack(part["embedding"].to_numpy())).astype(np.float64), books).tobytes()], "vectors": [own.astype(np.float32).tobytes()]})

    rows.mapInPandas(code, CODED).write.parquet(path)
    return Pq(spark, path, books, _coded(held, books) if drawn else np.zeros((0, PARTS), np.uint8), share, rows.count())


def _bounds(queries: np.ndarray, sample: np.ndarray, books: np.ndarray, share: float) -> np.ndarray:
    """The similarity by codes that the best ``share`` of all vectors have, as the sample tells
    it: two standard errors to the safe side, and one for the query itself."""
    m = share * len(sample)
    at = min(len(sample), int(np.ceil(m + (2 * m**0.5 if share < 1 else 0) + 1)))
    cuts = [np.partition(_looked_up(queries[i : i + CHUNK], sample, books), -at, axis=1)[:, -at] for i in range(0, len(queries), CHUNK)]
    return np.nextafter(np.concatenate(cuts).astype(np.float32), np.float32(-np.inf))


def pq_topk(index: Pq, queries: DataFrame, k: int = 10, rerank: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, rank, sim): approximate nearest vectors of each query by inner product: about ``rerank``
    best by codes (the fitted share of all unless given, 4 k at least) and the k best of each
    block ranked exactly, where they are read; a task tells its k best of each query."""
    books, sample = index.books, index.sample
    share = min(1.0, (rerank or max(4 * k, int(np.ceil(index.share * index.n)))) / max(1, index.n))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Query blocks with the bound as one more dimension."""
        for batch in batches:
            for ids, matrix in zip(batch["ids"], batch["matrix"]):
                own = np.frombuffer(matrix, np.float32).reshape(len(ids) // 8, -1)
                cuts = _bounds(own.astype(np.float64), sample, books, share) if len(sample) else np.zeros(len(own), np.float32)
                yield pd.DataFrame({"q_ids": [ids], "q_matrix": [np.column_stack([own, cuts]).astype(np.float32).tobytes()]})

    def compare(q_ids: bytes, q_matrix: bytes, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, own = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
        told = np.frombuffer(q_matrix, np.float32).reshape(len(asked), -1)
        left, cuts, codes = told[:, :-1].astype(np.float64), told[:, -1], np.frombuffer(matrix, np.uint8, len(own) * PARTS).reshape(len(own), PARTS)
        right = np.frombuffer(matrix, np.float32, offset=len(own) * PARTS).reshape(len(own), -1).astype(np.float64)
        sims, others = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64)
        for at in range(0, len(asked), CHUNK):
            some = left[at : at + CHUNK]
            by_codes = _looked_up(some, codes, books)
            least = np.partition(by_codes, -k - 1, axis=1)[:, -k - 1] if len(own) > k else np.full(len(some), -np.inf)
            q, c = np.nonzero(by_codes >= np.minimum(cuts[at : at + CHUNK], least)[:, None])
            exact = np.full(by_codes.shape, -np.inf)
            exact[q, c] = np.einsum("ij,ij->i", some[q], right[c])
            exact[asked[at : at + CHUNK, None] == own] = -np.inf
            best, named = _best(exact, np.broadcast_to(own, exact.shape), k)
            sims[at : at + CHUNK, : best.shape[1]], others[at : at + CHUNK, : best.shape[1]] = best, named
        return asked, others, sims

    asked = packed(queries, block).select("ids", "matrix").mapInPandas(bound, "q_ids binary, q_matrix binary")
    pairs = index.codes.select("ids", F.concat("matrix", "vectors").alias("matrix")).crossJoin(broadcast_if(asked, queries.count(), QUERIES))  # the stated query set against all rows, in blocks
    return _ranked(pairs.mapInPandas(_nearest(k, None, compare), "a long, b long, sim double"), k)
