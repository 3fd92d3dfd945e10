"""Merkle manifest of a dataset: digests of rows under a root for each group and for all.

Nodes are runs of FAN: a parent is the SHA-256 of its run's hex digests, one after the
other. Nodes of a group are dealt, by their rank, to blocks of FAN ** LEVELS, so that a
block is a whole subtree however large its group is; a block is one row, an Arrow array
of digests. Executors run the levels inside blocks as ordered string_agg and sha256
queries of DuckDB, over some blocks at a time; Spark makes the blocks' roots the nodes
of the next round until a group has one, and the groups' roots a group of their own.
Going down again, siblings above a block are joined to it, a row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.text import bounded_batches
from scriptorium.operators.blocks import numbered
from scriptorium.plans.store import counted, materialise, scoped

FAN, LEVELS = 16, 2
SIZE = FAN**LEVELS
#: Blocks of an Arrow batch (some 40 KB each), and of one query.
BATCH, SLICE = 64, 16
#: Blocks' own siblings up to this number (6 KB each) are broadcast.
SMALL = 5_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def record(values: list[Column]) -> Column:
    """One text for a row's values: ``-`` for null, else the UTF-8 byte count, ``:`` and the
    value, so no two rows have the same."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values])


def leaf(values: list[Column]) -> Column:
    return F.sha2(record(values).cast("binary"), 256)


def _levels() -> str:
    """CTEs node0.. and run1.. of the blocks' levels; ``i`` is a node's place in its level."""
    out = ["node0 AS MATERIALIZED (SELECT b, depth, unnest(hashes) AS h, generate_subscripts(hashes, 1) - 1 AS i FROM blocks)"]
    for k in range(1, LEVELS + 1):
        out.append(f"run{k} AS MATERIALIZED (SELECT b, depth, i // {FAN} AS run, string_agg(h, '' ORDER BY i) AS hexes FROM node{k - 1} WHERE depth >= {k} GROUP BY ALL)")
        out.append(f"node{k} AS (SELECT b, depth, run AS i, sha256(hexes) AS h FROM run{k})")
    return "WITH " + ",\n".join(out)


def _siblings(k: int, node: str = "x.i") -> tuple[str, str]:
    """A leaf's siblings of level ``k`` to the left and to the right; none above the block's root."""
    at = f"({node} // {FAN ** (k - 1)} % {FAN})"
    return f"coalesce(substr(r{k}.hexes, 1, 64 * {at}), '')", f"coalesce(substr(r{k}.hexes, 64 * {at} + 65), '')"


_RUNS = " ".join(f"LEFT JOIN run{k} r{k} ON r{k}.b = x.b AND r{k}.run = x.i // {FAN**k}" for k in range(1, LEVELS + 1))
ROOTS_SQL = _levels() + "\nSELECT g.grp, g.block AS place, h FROM (" + " UNION ALL ".join(f"SELECT b, h FROM node{k} WHERE depth = {k}" for k in range(LEVELS + 1)) + ") t JOIN blocks g USING (b)"
_OWN = ", ".join(f"{{'left': {a}, 'right': {b}}}" for a, b in map(_siblings, range(1, LEVELS + 1)))
STEPS_SQL = _levels() + f"\nSELECT g.grp, g.block * {SIZE} + x.i AS place, coalesce(g.subroot, x.h) AS subroot, list_concat(list_slice([{_OWN}], 1, x.depth), g.steps) AS steps FROM node0 x JOIN blocks g USING (b) {_RUNS}"


def _leaves_sql(above: int) -> str:
    """Each leaf with its proof and the root folded from what was found: ``above`` is the
    most steps above a block."""
    own = [_siblings(k) for k in range(1, LEVELS + 1)]
    out = _levels() + f",\nrow0 AS (SELECT b, unnest(ids) AS doc_id, unnest(found) AS found, generate_subscripts(ids, 1) - 1 AS i FROM blocks)"
    out += f",\nfold0 AS (SELECT x.b, y.doc_id, x.h AS leaf, x.depth, coalesce(y.found, x.h) AS f, {', '.join(f'{a} AS left{k}, {b} AS right{k}' for k, (a, b) in enumerate(own, 1))} FROM node0 x JOIN row0 y ON y.b = x.b AND y.i = x.i {_RUNS})"
    for k in range(1, LEVELS + 1):
        out += f",\nfold{k} AS (SELECT * REPLACE (CASE WHEN depth >= {k} THEN sha256(left{k} || f || right{k}) ELSE f END AS f) FROM fold{k - 1})"
    out += f",\nup0 AS (SELECT z.*, g.subroot, g.steps FROM fold{LEVELS} z JOIN blocks g USING (b))"
    for k in range(1, above + 1):
        out += f",\nup{k} AS (SELECT * REPLACE (CASE WHEN len(steps) >= {k} THEN sha256(steps[{k}].left || f || steps[{k}].right) ELSE f END AS f) FROM up{k - 1})"
    proof = " || ".join([f"left{k} || right{k}" for k in range(1, LEVELS + 1)] + [f"coalesce(steps[{k}].left || steps[{k}].right, '')" for k in range(1, above + 1)])
    listed = f"list_concat(list_slice([{', '.join(f"{{'left': left{k}, 'right': right{k}}}" for k in range(1, LEVELS + 1))}], 1, depth), steps)"
    return out + f"\nSELECT doc_id, leaf, subroot, sha256({proof}) AS proof_sha256, f AS folded_root, CASE WHEN proofs THEN {listed} END AS proof FROM up{above}, (SELECT any_value(proofs) AS proofs FROM blocks)"


def _engine(schema: pa.Schema, sql):
    """Run DuckDB over SLICE blocks at a time, each numbered ``b``; ``sql`` is the query, or
    makes it for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "700MB"}) as con:
            con.execute("SET temp_directory = ''")
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    con.register("blocks", pa.Table.from_batches([part]).append_column("b", pa.array(range(part.num_rows), pa.int32())))
                    made = con.execute(sql(part) if callable(sql) else sql).to_arrow_table().cast(schema)
                    con.unregister("blocks")
                    yield from made.combine_chunks().to_batches()

    return run


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_ROOT = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("h", pa.string())])
_NODE = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("subroot", pa.string()), ("steps", _STEPS)])
_LEAF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("proof", _STEPS)])


def _of_slice(part: pa.RecordBatch) -> str:
    return _leaves_sql(max((len(s) for s in part.column("steps").to_pylist()), default=0))


def _climbed(nodes: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(the blocks of each round, the groups' roots) from nodes (grp, place, n, h and more):
    ``n`` is the number of nodes of a group, ``largest`` the greatest."""
    rounds: list[DataFrame] = []
    while True:
        depth = F.lit(LEVELS)
        for k in reversed(range(LEVELS)):
            depth = F.when(F.col("n") <= FAN**k, F.lit(k)).otherwise(depth)
        more = [c for c in nodes.columns if c not in ("grp", "place", "n", "h")]
        held = F.array_sort(F.collect_list(F.struct("place", "h", *more)))  # SIZE nodes at most
        dealt = nodes.groupBy("grp", "n", F.expr(f"place div {SIZE}").alias("block")).agg(held.alias("x"))
        blocks = materialise(dealt.select("grp", "n", "block", depth.cast("int").alias("depth"), F.col("x.h").alias("hashes"), *[F.col(f"x.{c}").alias(c) for c in more]), f"{name}-blocks")
        roots = materialise(blocks.select("grp", "block", "depth", "hashes").mapInArrow(_engine(_ROOT, ROOTS_SQL), "grp string, place long, h string"), f"{name}-roots")
        rounds.append(blocks)
        if largest <= SIZE:
            return rounds, roots
        largest = -(-largest // SIZE)
        nodes = roots.join(counted(blocks.select("grp", "n", F.col("block").alias("place")), SMALL * 10), ["grp", "place"]).select("grp", "place", F.ceil(F.col("n") / SIZE).alias("n"), "h")


def _with_steps(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``blocks`` with subroot and steps of the node that each of them is one level up."""
    if above is None:
        return blocks.withColumns({"subroot": F.lit(None).cast("string"), "steps": F.array().cast(STEPS)})
    return blocks.join(counted(above.select("grp", F.col("place").alias("block"), "subroot", "steps"), SMALL), ["grp", "block"])


def _descended(rounds: list[DataFrame], above: DataFrame | None, name: str) -> DataFrame | None:
    """(grp, place, subroot, steps) of the nodes of the last of ``rounds`` (the first round
    excepted, which the caller reads): siblings on the way up, nearest first."""
    for blocks in reversed(rounds):
        of = _with_steps(blocks, above).select("grp", "block", "depth", "hashes", "subroot", "steps")
        above = materialise(of.mapInArrow(_engine(_NODE, STEPS_SQL), f"grp string, place long, subroot string, steps {STEPS}"), f"{name}-steps")
    return above


@dataclass(frozen=True)
class Manifest:
    """``rows`` (doc_id, leaf, subroot, proof_sha256, folded_root, proof) and the ``root`` of
    all, null for an empty table."""

    rows: DataFrame
    root: str | None


def prove(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", found: dict[str, Column] | None = None, proofs: bool = False) -> Manifest:
    """A proof for every row of ``docs`` against the root of all of them.

    A row's leaf is the digest of :func:`record` over ``columns``. Leaves of a group ascend
    by doc_id (nulls first, then by leaf); equal rows have equal leaves and proofs alike.
    Groups are ordered by the bytes of their name, the null group first. ``found`` gives
    the values to be verified where they are not those of the table, by column:
    folded_root is the root that follows from them and the untampered siblings.
    ``proof`` lists the siblings to the left and right, level by level, if ``proofs`` asks
    for them (3 KB a row), else it is null; proof_sha256 is the digest of all of them.

    Nulls are values of their own, empty texts are not null, texts of any length are
    digested where they are read; other columns are ignored. An empty table gives no rows.
    """
    with bounded_batches(docs.sparkSession, BATCH):
        return _prove(docs, columns, group, found or {}, proofs)


def _prove(docs: DataFrame, columns: tuple[str, ...], group: str, found: dict[str, Column], proofs: bool) -> Manifest:
    spark = docs.sparkSession
    own, seen = leaf([F.col(c) for c in columns]), leaf([found.get(c, F.col(c)) for c in columns])
    changed = F.lit(False)
    for c, value in found.items():
        changed = changed | ~F.col(c).eqNullSafe(value)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("-")).alias("grp"),  # "-" is before "s"
        F.col("doc_id").cast("long").alias("doc_id"),
        own.alias("h"),
        F.when(changed, seen).alias("found"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialise(leaves, "merkle-leaves")
    nodes = numbered(leaves, ("grp",), ("doc_id", "h", "row"), "merkle-ranked").select("grp", "place", "n", "h", F.col("doc_id").alias("ids"), "found")
    largest = leaves.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
    if not largest:
        empty = f"doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, proof {STEPS}"
        return Manifest(spark.createDataFrame([], empty), None)
    rounds, subroots = _climbed(nodes, largest, "merkle")
    # The groups' roots are the nodes of one more tree.
    tops = materialise(numbered(subroots.select(F.lit("").alias("top"), "grp", "h"), ("top",), ("grp",), "merkle-groups").select("top", "grp", "place", "n", "h"), "merkle-tops")
    top_rounds, root = _climbed(tops.select(F.col("top").alias("grp"), "place", "n", "h"), tops.count(), "merkle-top")
    named = _descended(top_rounds, None, "merkle-top").select("place", "steps").join(tops.select("place", "grp", "h"), "place")
    above = materialise(named.select("grp", F.lit(0).cast("long").alias("place"), F.col("h").alias("subroot"), "steps"), "merkle-top-nodes")
    above = _descended(rounds[1:], above, "merkle")
    asked = _with_steps(rounds[0], above).select("grp", "block", "depth", "hashes", "ids", "found", "subroot", "steps", F.lit(proofs).alias("proofs"))
    rows = asked.mapInArrow(_engine(_LEAF, _of_slice), f"doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, proof {STEPS}")
    return Manifest(materialise(rows, "merkle-proofs"), root.head()["h"])


@scoped
def verify(docs: DataFrame, found: dict[str, Column] | None = None, **options) -> DataFrame:
    """The rows of :func:`prove` with ``root`` and ``verified``: whether what was found leads to it."""
    told = prove(docs, found=found, **options)
    return told.rows.withColumn("root", F.lit(told.root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
