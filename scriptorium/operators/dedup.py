"""Duplicate notes: exact copies, near copies by word shingles, and their clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.components import connected_components
from scriptorium.operators.text import PIECE, letters
from scriptorium.plans.store import broadcast_if, counted, materialise, scoped, spread

#: Bands of minima, and minima of a band: a pair at similarity 0.7 meets in some band with
#: chance 1 - (1 - 0.7^4)^32 = 0.9998, one at 0.3 with 0.23.
BANDS, MINIMA = 32, 4
#: Bands where what they miss is found exactly: 0.89 at similarity 0.7, 0.985 at 0.8.
LINK_BANDS = 8
#: One set in so many, 2,000 at least, tells which shingles are frequent: an estimate that orders
#: shingles, and so has a part in the work but none in the results.
EVERY = 16
#: Sets with a shingle in common that are paired as they are, whatever their classes.
FEW = 64
#: Rows (a long or two each) that are broadcast to pick sets by.
PICKED = 1_000_000


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """(h, keep_id, n): texts that stand more than once."""
    return documents.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


def _pieces(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, values, lengths) of an Arrow batch: rows whose arrays of longs ``name`` have PIECE
    values at most, or one row."""
    total, start = np.cumsum(pc.list_value_length(batch.column(name)).to_numpy()), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PIECE, side="right")))
        piece = batch.slice(start, end - start)
        column = piece.column(name)
        yield piece, pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)
        start = end


def _shingled(size: int):
    """(doc_id, w) -> (doc_id, s): sorted distinct hashes of the runs of ``size`` words, from the
    hashes ``w`` of the words; no row has fewer."""
    power = np.array([pow(0x9E3779B97F4A7C15, size - i, 1 << 64) for i in range(size)], np.uint64)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, w, n in _pieces(batch, "w"):
                w, runs = w.view(np.uint64), len(w) - size + 1
                with np.errstate(over="ignore"):
                    g = sum((w[i : i + runs] * power[i] for i in range(1, size)), w[:runs] * power[0])
                    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64's finaliser
                        g = (g ^ g >> np.uint64(shift)) * np.uint64(by)
                g = (g ^ g >> np.uint64(31)).view(np.int64)
                first = np.cumsum(n) - n
                own = n - size + 1
                g = np.concatenate([np.sort(g[a : a + k]) for a, k in zip(first, own)])  # no run leaves its text
                at = np.cumsum(own) - own
                new = np.concatenate([[True], g[1:] != g[:-1]])
                new[at] = True
                offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(new, at, dtype=np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(g[new]))], ["doc_id", "s"])

    return sets


def shingle_sets(documents: DataFrame, size: int = 5, limit: int = PICKED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x) of the documents with a set, x the least id among those of equal sets, and
    (x, s, n), a row an x: the distinct shingles of ``size`` letter runs as sorted 64-bit
    hashes, and their number. Texts of fewer words have no set. Sets are written once, and
    not exchanged to tell copies: up to ``limit`` rows that stand for nothing are left out
    by a broadcast of their row numbers."""
    words = spread(documents).select("doc_id", letters("text").alias("w")).where(F.size("w") >= size)
    hashed = words.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))
    sets = hashed.mapInArrow(_shingled(size), "doc_id long, s array<long>").withColumn("n", F.size("s"))
    rows = materialise(sets.withColumn("h", F.struct(F.xxhash64("s"), F.hash("s"), "n")).withColumn("r", F.monotonically_increasing_id()), "document-shingles")
    told = rows.select("doc_id", "h", "r")
    named = materialise(told.join(told.groupBy("h").agg(F.min("doc_id").alias("x")), "h").select("doc_id", "x", "r"), "set-copies")
    chosen = named.where("doc_id = x").groupBy("x").agg(F.min("r").alias("r")).select("r")
    rest = materialise(named.select("r").join(chosen, "r", "left_anti"), "set-copies")
    many = rest.count()
    heads = rows.join(broadcast_if(rest, many, limit), "r", "left_anti").select(F.col("doc_id").alias("x"), "s", "n")
    return named, heads if many <= limit else materialise(heads, "shingle-sets")


def _members(named: DataFrame) -> DataFrame:
    """(x, y, j): each copy (equal sets) beside the one that stands for it."""
    return named.where("doc_id <> x").select("x", F.col("doc_id").alias("y"), F.lit(1.0).alias("j"))


def _frequent(sets: DataFrame, limit: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(g, rank): up to ``limit`` frequent shingles, ascending, and their places from 1 on by the
    number of sets that have them, counted in one set of EVERY (x, s)."""
    every = min(EVERY, max(1, sets.count() // 2000))
    some = sets.where(F.pmod(F.xxhash64("x"), F.lit(every)) == 0).select(F.explode("s").alias("g"))
    often = materialise(some.groupBy("g").agg(F.count("*").alias("df")).where("df > 2"), "frequent-shingles")
    room, least = limit, 2**63 - 1
    for df, n in often.groupBy("df").count().orderBy(F.desc("df")).collect():  # a row a number
        if n > room:
            break
        room, least = room - n, df
    rows = often.where(F.col("df") >= least).toPandas()
    g, df = rows["g"].to_numpy(np.int64), rows["df"].to_numpy(np.int64)
    rank = np.empty(len(g), np.int64)
    rank[np.lexsort((g, df))] = np.arange(1, len(g) + 1)
    order = np.argsort(g)
    return g[order], rank[order]


def _firsts(threshold: float, often: np.ndarray, rank: np.ndarray):
    """(x, s) -> (g, x, n): the first n - ceil(threshold * n) + 1 shingles of each set in an
    order that all sets share: by hash, then the frequent ones by rank."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, g, n in _pieces(batch, "s"):
                row = np.repeat(np.arange(len(n)), n)
                if len(often):
                    found = np.minimum(np.searchsorted(often, g), len(often) - 1)
                    last = np.where(often[found] == g, rank[found], 0)
                    g = g[np.argsort(row * (len(often) + 1) + last, kind="stable")]
                at = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
                kept = at < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
                of = pa.array(row[kept])
                yield pa.RecordBatch.from_arrays([pa.array(g[kept]), piece.column("x").take(of), pa.array(n.astype(np.int32)).take(of)], ["g", "x", "n"])

    return firsts


def _prefixes(sets: DataFrame, threshold: float, classes: DataFrame | None = None) -> DataFrame:
    """(g, x, n, c, m) as a written table: the shingles of each set (x, s, n) that any set as
    similar as ``threshold`` shares one of, but for those that no set of another class has among
    its own, and the number of sets that have them, m. The class c is that of ``classes``
    (x, component), a written table, or else x.

    Any order that all sets share is right. This one is known where a set is read, so that
    a set's prefix is all that is exchanged of it, once; frequent shingles come last, as
    each pair of their sets would be a candidate."""
    prefix = sets.select("x", "s").mapInArrow(_firsts(threshold, *_frequent(sets)), "g long, x long, n int")
    if classes is not None:
        prefix = prefix.join(broadcast_if(classes, classes.count(), PICKED), "x", "left").select("g", "x", "n", "component")
    # Of two equal ids only one is exchanged: this is most of what the whole query exchanges.
    met = prefix.repartition("g").withColumn("c", F.coalesce("component", "x") if classes is not None else F.col("x")).select("g", "x", "n", "c")
    same = Window.partitionBy("g")
    shared = met.select("*", F.count("*").over(same).alias("m"), F.min("c").over(same).alias("least"), F.max("c").over(same).alias("most"))
    return materialise(shared.where("least < most").drop("least", "most"), "prefixes")


def _other(prefix: DataFrame) -> DataFrame:
    return prefix.select("g", F.col("x").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"))


def _may_reach(threshold: float) -> Column:
    """Whether two sets have lengths for the threshold."""
    return (F.col("n") >= threshold * F.col("ny") - 1e-9) & (F.col("ny") >= threshold * F.col("n") - 1e-9)


def _candidates(met: DataFrame, threshold: float) -> DataFrame:
    """(x, y), x < y: the pairs of ``met``, a row (x, y, n, ny) a shingle that both prefixes have,
    that may reach the threshold: what is shared is in both prefixes, or behind the one that ends first
    in the common order."""
    behind = F.greatest(F.ceil(threshold * F.col("n") - 1e-9), F.ceil(threshold * F.col("ny") - 1e-9)) - 1
    pairs = met.groupBy("x", "y").agg(F.count("*").alias("shared"), F.min("n").alias("n"), F.min("ny").alias("ny"))
    enough = F.col("shared") + behind >= threshold / (1 + threshold) * (F.col("n") + F.col("ny")) - 1e-9
    return pairs.where(enough).select("x", "y")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float, limit: int = PICKED) -> DataFrame:
    """(x, y, j) of the pairs, a written table, whose sets are as similar as ``threshold``. Only sets that
    stand in a pair are exchanged: up to ``limit`` pairs, or else ids, pick them by a broadcast."""
    own = {end: sets.select(F.col("x").alias(end), F.col("s").alias(f"s{end}")) for end in ("x", "y")}
    if (many := pairs.count()) > limit:
        own["x"] = own["x"].join(counted(pairs.select("x").distinct(), limit), "x", "left_semi")
    first = own["x"].join(broadcast_if(pairs, many, limit), "x")
    second = own["y"].join(counted(pairs.select("y").distinct(), limit), "y", "left_semi")
    full = first.join(second.hint("merge"), "y").withColumn("i", F.size(F.array_intersect("sx", "sy")))
    return full.select("x", "y", (F.col("i") / (F.size("sx") + F.size("sy") - F.col("i"))).alias("j")).where(F.col("j") >= threshold)


@scoped
def near_duplicates(documents: DataFrame, threshold: float = 0.7, size: int = 5) -> DataFrame:
    """(x, y, j): pairs of documents of Jaccard similarity of at least ``threshold``, exact:
    all pairs x < y of different sets, each set by its least doc_id, and every other
    document of a set beside that one (j = 1), so that copies cost a row and not a pair
    each. Null doc_ids take no part; repeated ones are one document.

    Only prefixes in a common order are joined; bounds of length and of the number of
    shingles in both prefixes cut pairs before the sets are compared."""
    named, sets = shingle_sets(documents.where("doc_id is not null"), size)
    prefix = _prefixes(sets, threshold)
    pairs = materialise(_candidates(prefix.join(_other(prefix), "g").where((F.col("x") < F.col("y")) & _may_reach(threshold)), threshold), "near-candidates")
    return _similar(pairs, sets, threshold).unionByName(_members(named))


@scoped
def near_links(documents: DataFrame, threshold: float = 0.7, size: int = 5, small: int = 200_000) -> DataFrame:
    """(x, y): verified pairs of :func:`near_duplicates`, not all of them but enough for its
    components: m sets that are all alike give links in proportion to m and not m * m / 2.

    Links by bands of minima that hold on the whole sets give classes first. What bands may
    miss is found exactly: two sets of different classes still meet on a shared prefix
    shingle, while sets of one class, which no further link can change, are never paired.
    Sets of two classes that share a rare shingle without any link between them are compared
    pair by pair. Classes of up to ``small`` links are formed in one task."""
    named, sets = shingle_sets(documents.where("doc_id is not null"), size)
    banded = materialise(_band_links(sets.select("x", "s")), "band-links")
    sure = materialise(_similar(banded, sets, threshold).select("x", "y"), "sure-links")
    classes = materialise(connected_components(sure, "x", "y", small=small).withColumnRenamed("node", "x"), "classes")
    prefix = _prefixes(sets, threshold, classes)
    few, many = prefix.where(F.col("m") <= FEW), prefix.where(F.col("m") > FEW)
    # Where many sets meet, classes come first, so that a large class is never joined with itself.
    spans = materialise(many.groupBy("g", "c").agg(F.min("n").alias("least"), F.max("n").alias("most")), "class-spans")
    others = spans.withColumnsRenamed({"c": "cy", "least": "least_y", "most": "most_y"})
    may = (F.col("c") < F.col("cy")) & (F.col("most") >= threshold * F.col("least_y") - 1e-9) & (F.col("most_y") >= threshold * F.col("least") - 1e-9)
    met = materialise(spans.join(others, "g").where(may).select("g", "c", "cy"), "classes-met")
    apart = met.join(many, ["g", "c"]).join(_other(many), ["g", "cy"])
    pairs = few.join(_other(few), "g").where("c < cy").unionByName(apart).where(_may_reach(threshold))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.least("n", "ny").alias("n"), F.greatest("n", "ny").alias("ny"))
    pairs = materialise(_candidates(pairs, threshold), "link-candidates")
    return sure.union(_similar(pairs, sets, threshold).select("x", "y")).union(_members(named).select("x", "y"))


def _bands(bands: int):
    """(x, s) -> (x, band, key): a key is a digest of MINIMA minima of the set."""
    seeds = np.random.default_rng(11).integers(1, 2**63, (2, BANDS * MINIMA), dtype=np.uint64) | np.uint64(1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, g, n in _pieces(batch, "s"):
                g, first, out = g.view(np.uint64), np.cumsum(n) - n, []
                with np.errstate(over="ignore"):
                    for band in range(bands):
                        key = np.zeros(len(n), np.uint64)
                        for i in range(band * MINIMA, (band + 1) * MINIMA):
                            key = (key ^ key >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((g ^ seeds[0, i]) * seeds[1, i] >> np.uint64(16), first)
                        out.append(key.view(np.int64))
                x = piece.column("x").take(pa.array(np.tile(np.arange(len(n)), bands)))
                yield pa.RecordBatch.from_arrays([x, pa.array(np.repeat(np.arange(bands, dtype=np.int32), len(n))), pa.array(np.concatenate(out))], ["x", "band", "key"])

    return keys


def _band_links(sets: DataFrame, bands: int = LINK_BANDS) -> DataFrame:
    """(x, y), x < y: in each band every set (x, s) is linked to the next one of its key, so a
    key that m sets share gives m - 1 links."""
    keys = materialise(sets.mapInArrow(_bands(bands), "x long, band int, key long"), "bands")
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    # Within a key sets are dealt over slots, each a window of its own, and slots are joined
    # up through their first members. Every band has an order of its own.
    held = keys.join(shared, ["band", "key"]).select("band", "key", F.struct(F.xxhash64("x", "band").alias("r"), "x").alias("at")).withColumn("slot", F.pmod("at.r", F.lit(64)))
    link = lambda w: [F.lag("at").over(w)["x"].alias("x"), F.col("at.x").alias("y")]
    inside = held.select(*link(Window.partitionBy("band", "key", "slot").orderBy("at")))
    firsts = held.groupBy("band", "key", "slot").agg(F.min("at").alias("at"))
    across = firsts.select(*link(Window.partitionBy("band", "key").orderBy("at")))
    links = inside.union(across).where("x is not null")
    return links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


@scoped
def near_duplicates_lsh(documents: DataFrame, size: int = 5) -> DataFrame:
    """(x, y): links x < y between likely near copies, an approximation of
    :func:`near_duplicates` at 0.7 and above by MinHash bands. Links span what is similar, as
    :func:`_band_links` has it; copies are linked to the document that stands for them. Two
    near copies are connected, not always directly."""
    named, sets = shingle_sets(documents.where("doc_id is not null"), size)
    return _band_links(sets.select("x", "s"), BANDS).union(_members(named).select("x", "y")).distinct()


@scoped
def duplicate_clusters(documents: DataFrame, pairs: DataFrame, fold_case: bool = False) -> DataFrame:
    """(doc_id, cluster) for every document with an exact copy or a near copy: the least id of
    its cluster, which are the components of equal texts (lower-cased with ``fold_case``)
    and of ``pairs`` (x, y), for which :func:`near_links` are enough. Null texts and ids are left out."""
    body = F.lower("text") if fold_case else F.col("text")
    rows = materialise(documents.where("text is not null and doc_id is not null").select("doc_id", F.md5(body.cast("binary")).alias("h")), "text-digests")
    keep = materialise(rows.groupBy("h").agg(F.min("doc_id").alias("x"), F.count("*").alias("n")).where("n > 1").select("h", "x"), "text-copies")
    copies = rows.join(keep, "h").select("x", F.col("doc_id").alias("y"))
    edges = pairs.select("x", "y").union(copies)
    return connected_components(edges, "x", "y").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
