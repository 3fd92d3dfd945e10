"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.store import drop_path, materialise_to, scoped


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges that a task reads, by union-find."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["node", "component"])


def _starred(edges: DataFrame, large: bool) -> tuple[DataFrame, list[str]]:
    """One star operation on edges (u, v). Minima are written before they are joined:
    the join then has two scans below its exchanges, and a hub's rows can be split."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = materialise_to(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        linked = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low, low_path = materialise_to(down.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out, out_path = materialise_to(linked.where("u <> v").distinct(), "cc-edges")
    drop_path(out.sparkSession, low_path)
    return out, [out_path]


@scoped
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, component) for every node of ``edges``; ``component`` is the least node of
    its component. Self-loops name a node without linking it; null ends are dropped;
    repeated edges count once. Nothing is collected: rounds exchange only edge rows,
    and their number grows with the logarithm of the longest path. Up to ``small`` distinct
    edges, which are counted, are united in one task instead: 200 bytes an edge, where rounds
    would be all overhead."""
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    base, _ = materialise_to(plain.distinct(), "cc-edges")
    if small and base.count() <= small:
        kind = base.schema["u"].dataType.simpleString()
        united, _ = materialise_to(base.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}"), "cc-united")
        return united
    now = base.where("u <> v")
    paths: list[str] = []
    seen = None
    for _ in range(max_rounds):
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if not count or (count, total) == seen:
            break
        seen = (count, total)
        old = paths
        now, between = _starred(now, large=True)
        now, paths = _starred(now, large=False)
        for path in old + between:
            drop_path(now.sparkSession, path)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = base.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
