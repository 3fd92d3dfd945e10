"""Vector search by blocked matrix products: exact nearest neighbours of a stated query
set, and an inverted-file index for approximate ones.

Vectors are packed into blocks of bounded size, a row each. Blocks of queries meet blocks
of the corpus, so plans and tasks stay as they are whatever the number of either, and
nothing passes through the driver. Each task keeps its own best k per query; the tasks'
lists are merged by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.plans.store import broadcast_if, counted, hashed_sample, materialise

#: Vectors of a block (256 KB at 64 dimensions), and queries that are broadcast at most.
BLOCK, QUERIES = 1024, 50_000
PACKED = "list int, ids binary, matrix binary"
#: Query blocks whose best a task holds before it lets them go.
HELD = 64


def _unpacked(ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(matrix, np.float32).reshape(len(own), -1).astype(np.float64)


def _packer(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one list after the other, as blocks of at most ``size``."""
        held, at = [], None

        def block():
            return pd.DataFrame({"list": [at], "ids": [np.array([i for i, _ in held], np.int64).tobytes()], "matrix": [np.stack([v for _, v in held]).astype(np.float32).tobytes()]})

        for batch in batches:
            for where, vec_id, vector in zip(batch["list"], batch["vec_id"], batch["embedding"]):
                if held and (where != at or len(held) == size):
                    yield block()
                    held = []
                at = where
                held.append((vec_id, vector))
        if held:
            yield block()

    return pack


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def packed(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of the vectors, where they are read. Rows without id or vector are left out;
    all vectors must be of one length."""
    return _plain(vectors).select(F.lit(0).alias("list"), "vec_id", "embedding").mapInPandas(_packer(size), PACKED)


def _products(q_ids: bytes, q_matrix: bytes, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    asked, left = _unpacked(q_ids, q_matrix)
    own, right = _unpacked(ids, matrix)
    return asked, own, left @ right.T


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row and what equals the last of them, ordered, ties by id: only these are
    sorted. Rows of fewer end in similarities of -inf."""
    if sims.shape[1] > k:
        kept = sims >= np.partition(sims, -k, axis=1)[:, -k][:, None]
        q, c = np.nonzero(kept)
        counts = kept.sum(axis=1)
        at = np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
        few, own = np.full((len(sims), counts.max(initial=0)), -np.inf), np.zeros((len(sims), counts.max(initial=0)), np.int64)
        few[q, at], own[q, at] = sims[q, c], ids[q, c]
        sims, ids = few, own
    order = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


def _nearest(k: int | None, least: float | None, compare=_products):
    """Best k (or all of at least ``least``) per query over pairs of blocks, of which ``compare``
    gives both sides' ids (the other side's for all queries or for each) and their similarities."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def let_go():
            for key, (sim, other) in best.items():
                q, c = np.nonzero(np.isfinite(sim))
                yield pd.DataFrame({"a": np.frombuffer(key, np.int64)[q], "b": other[q, c], "sim": sim[q, c]})
            best.clear()

        for batch in batches:
            for q_ids, q_matrix, c_ids, c_matrix in zip(batch["q_ids"], batch["q_matrix"], batch["ids"], batch["matrix"]):
                asked, own, sims = compare(q_ids, q_matrix, c_ids, c_matrix)
                ids = np.broadcast_to(own, sims.shape)
                sims[asked[:, None] == ids] = -np.inf
                if k is None:
                    q, c = np.nonzero(sims >= least)
                    yield pd.DataFrame({"a": asked[q], "b": ids[q, c], "sim": sims[q, c]})
                    continue
                sims, ids = _best(sims, ids, k)
                if q_ids in best:
                    sims, ids = np.hstack([best[q_ids][0], sims]), np.hstack([best[q_ids][1], ids])
                elif len(best) == HELD:
                    yield from let_go()
                best[q_ids] = _best(sims, ids, k)
        yield from let_go()

    return scan


def _against(corpus: DataFrame, queries: DataFrame, k: int | None, least: float | None, block: int) -> DataFrame:
    asked = packed(queries, block).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    # The stated query set against all rows, in blocks.
    pairs = corpus.select("ids", "matrix").crossJoin(broadcast_if(asked, queries.count(), QUERIES))
    return pairs.mapInPandas(_nearest(k, least), "a long, b long, sim double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("a", "b", "rank", "sim")


def knn_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(a, b, rank, sim): the k nearest other vectors of each query by inner product in
    double precision, ties by vec_id. Exact: every vector is compared."""
    return _ranked(_against(packed(vectors, block), queries, k, None, block), k)


def cosine_pairs(vectors: DataFrame, queries: DataFrame, least: float = 0.3, block: int = BLOCK) -> DataFrame:
    """(a, b, sim): pairs of a query and another vector with similarity of at least ``least``."""
    return _against(packed(vectors, block), queries, None, least, block)


@dataclass(frozen=True)
class Ivf:
    """An inverted-file index: ``centres`` are unit vectors, a list of the corpus each;
    ``probes`` is how many lists a query looks through unless told."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(self.path)


def _centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means of the sample."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = unit[np.random.default_rng(seed).choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float, queries: int = 500) -> int:
    """The least number of lists in which a share ``target`` of the ``k`` nearest of the
    sample's first vectors lie, compared with the whole sample."""
    asked = sample[:queries]
    sims = asked @ sample.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-sims, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    lists = (sample @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(place, lists[near], axis=1), target, method="higher")) + 1


def _lists_of(centres: np.ndarray, probes: int):
    @F.pandas_udf("array<int>")
    def lists(vectors: pd.Series) -> pd.Series:
        if not len(vectors) or not len(centres):
            return pd.Series([[]] * len(vectors), dtype=object)
        order = np.argsort(-(np.stack(vectors.to_numpy()).astype(np.float64) @ centres.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype(np.int32)))

    return lists


def build_ivf(vectors: DataFrame, path: str, lists: int | None = None, sample: int = 20_000, block: int = BLOCK, k: int = 10, target: float = 0.97) -> Ivf:
    """Write every vector to the list of its nearest centre. Centres are fitted to at most
    ``sample`` vectors, drawn by a hash of vec_id; ``lists`` is the root of the number of
    vectors unless given, at most 4,096, so that the centres stay a few megabytes. How many
    lists queries look through is fitted to the sample too, for a recall of ``target`` of
    the ``k`` nearest there: few where vectors cluster, many where they don't. Lists lie in ranges of (list, id): a list with a third of all rows fills many blocks."""
    spark, rows = vectors.sparkSession, _plain(vectors)
    drawn = hashed_sample(rows, "vec_id", sample)
    lists = min(lists or int(np.sqrt(rows.count())) or 1, 4096, max(1, len(drawn)))
    held = np.array([r["embedding"] for r in drawn], np.float64)
    centres = _centres(held, lists) if drawn else np.zeros((0, 0))
    probes = _probes(held, centres, k, target) if drawn else 1
    dealt = rows.select(_lists_of(centres, 1)("embedding")[0].alias("list"), "vec_id", "embedding")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartitionByRange(parts, "list", "vec_id").sortWithinPartitions("list", "vec_id").mapInPandas(_packer(block), PACKED).write.parquet(path)
    return Ivf(spark, path, centres, probes)


def ivf_topk(index: Ivf, queries: DataFrame, k: int = 10, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, rank, sim): approximate :func:`knn_topk`: each query looks through the ``probes``
    lists whose centres are nearest to it, and what it finds is ranked exactly."""
    spark, probes = index.spark, probes or index.probes
    asked = _plain(queries).select(F.explode(_lists_of(index.centres, probes)("embedding")).alias("list"), "vec_id", "embedding")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartitionByRange(parts, "list", "vec_id").sortWithinPartitions("list", "vec_id").mapInPandas(_packer(block), PACKED)
    asked = asked.select("list", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    pairs = index.blocks.join(broadcast_if(asked, queries.count() * probes, QUERIES), "list")
    return _ranked(pairs.select("ids", "matrix", "q_ids", "q_matrix").mapInPandas(_nearest(k, None), "a long, b long, sim double"), k)


def _scoped_rows(vectors: DataFrame, scope: str) -> DataFrame:
    return vectors.where(f"vec_id is not null and embedding is not null and {scope} is not null").select(F.col(scope).cast("string").alias("scope"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")


KEYED = PACKED.replace("list int", "list string")


def _keyed_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of rows (list, vec_id, embedding) that lie in ranges of (list, id): a list with a
    third of all rows fills many blocks, of as many tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "list", "vec_id").sortWithinPartitions("list", "vec_id").mapInPandas(_packer(block), KEYED)


def knn_scoped(vectors: DataFrame, queries: DataFrame, scope: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(a, b, rank, sim): :func:`knn_topk` among the vectors of the query's own ``scope``, a
    column of both. Exact; a vector or query without a scope is in none."""
    own = materialise(_keyed_blocks(_scoped_rows(vectors, scope).withColumnRenamed("scope", "list"), block), "scope-blocks")
    asked = materialise(_keyed_blocks(_scoped_rows(queries, scope).withColumnRenamed("scope", "list"), block), "scope-queries")
    asked = counted(asked.select("list", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), QUERIES // block + 1)
    pairs = own.join(asked, "list").select("ids", "matrix", "q_ids", "q_matrix")
    return _ranked(pairs.mapInPandas(_nearest(k, None), "a long, b long, sim double"), k)


@dataclass(frozen=True)
class ScopedIvf:
    """An inverted-file index of which each (scope, list) is a cell of its own. ``cells`` has
    what each holds, ``widths`` the lists that a search must look through, by how many
    of the sample's nearest vectors it must reach: (reach, lists), ascending."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    widths: list[tuple[int, int]]
    sample: int

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(KEYED).parquet(f"{self.path}/blocks")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema("scope string, list int, n long").parquet(f"{self.path}/cells")


def _cell(scope: str, number: str):
    """Cells of a scope are neighbours in the order of names, so its files are told by statistics."""
    return F.concat(F.col(scope), F.lit("|"), F.lpad(F.col(number).cast("string"), 5, "0"))


def build_scoped_ivf(vectors: DataFrame, path: str, scope: str, lists: int | None = None, sample: int = 20_000, block: int = BLOCK, k: int = 10, target: float = 0.97) -> ScopedIvf:
    """Write every vector that has a ``scope`` to the cell of its scope and nearest centre.

    Centres are fitted as in :func:`build_ivf`. A scope that holds a hundredth of all vectors
    has its k-th neighbour where the whole has its hundred times k-th: so the sample is also
    asked how many lists hold its nearest 2k, 4k, ... vectors."""
    spark, rows = vectors.sparkSession, _scoped_rows(vectors, scope)
    drawn = hashed_sample(rows.select("vec_id", "embedding"), "vec_id", sample)
    lists = min(lists or int(np.sqrt(rows.count())) or 1, 4096, max(1, len(drawn)))
    held = np.array([r["embedding"] for r in drawn], np.float64)
    centres = _centres(held, lists) if drawn else np.zeros((0, 0))
    reaches = [k * 2**n for n in range(32) if n == 0 or k * 2 ** (n - 1) < len(drawn)]
    widths = [(r, _probes(held, centres, r, target)) for r in reaches] if drawn else [(k, 1)]
    listed = materialise(rows.select("scope", _lists_of(centres, 1)("embedding")[0].alias("number"), "vec_id", "embedding"), "ivf-lists") if drawn else rows.select("scope", F.lit(0).alias("number"), "vec_id", "embedding")
    listed.groupBy("scope", F.col("number").alias("list")).agg(F.count("*").alias("n")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "scope", "list").write.parquet(f"{path}/cells")
    _keyed_blocks(listed.select(_cell("scope", "number").alias("list"), "vec_id", "embedding"), block).write.parquet(f"{path}/blocks")
    return ScopedIvf(spark, path, centres, widths, len(drawn))


def _probed(centres: np.ndarray, widths: list[tuple[int, int]], sample: int, k: int):
    """Which lists of its scope a query looks through, nearest first: all those among the lists
    that the scope's size asks for, and on until they hold k vectors besides the query."""
    reach = np.array([r for r, _ in widths])

    @F.pandas_udf("array<int>")
    def probed(vectors: pd.Series, numbers: pd.Series, counts: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        sims = np.stack(vectors.to_numpy()).astype(np.float64) @ centres.T
        out = []
        for row, own, n in zip(sims, numbers, counts):
            own, n = np.asarray(own), np.asarray(n)
            place = np.argsort(np.argsort(-row, kind="stable"), kind="stable")[own]
            order = np.argsort(place, kind="stable")
            wanted = widths[min(np.searchsorted(reach, k * sample / n.sum()), len(widths) - 1)][1]
            enough = np.cumsum(n[order]) - n[order] >= k + 1  # the lists before hold k and the query
            out.append(own[order][(place[order] < wanted) | ~enough].astype(np.int32))
        return pd.Series(out)

    return probed


def ivf_topk_scoped(index: ScopedIvf, queries: DataFrame, scope: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(a, b, rank, sim): approximate :func:`knn_scoped`. A query with k neighbours in its scope
    gets k: probing widens until they are certain. Only cells of the queries' scopes are
    read and compared."""
    if not len(index.centres):
        return index.spark.createDataFrame([], "a long, b long, rank long, sim double")
    asked = _scoped_rows(queries, scope)
    cells = index.cells.groupBy("scope").agg(F.collect_list("list").alias("numbers"), F.collect_list("n").alias("counts"))  # 4,096 at most
    n_scopes = index.cells.select("scope").distinct().count()
    told = asked.join(broadcast_if(cells, n_scopes, 2_000), "scope").select("scope", "vec_id", "embedding", F.explode(_probed(index.centres, index.widths, index.sample, k)("embedding", "numbers", "counts")).alias("number"))
    blocks = materialise(_keyed_blocks(told.select(_cell("scope", "number").alias("list"), "vec_id", "embedding"), block), "scoped-queries")
    blocks = counted(blocks.select("list", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), QUERIES // block + 1)
    pairs = index.blocks.join(blocks, "list").select("ids", "matrix", "q_ids", "q_matrix")
    return _ranked(pairs.mapInPandas(_nearest(k, None), "a long, b long, sim double"), k)
