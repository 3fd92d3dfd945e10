"""N-gram Jaccard self-join by chosen paths (Christiani, Pagh and Sivertsen, 2018).

Texts are sets of word shingles; texts of equal sets are one record. A record's set is
sampled as the minima of 64 hash functions. A run starts with all records in one node
and splits each node on sampled tokens: two of the 64 places, chosen by a hash of the
node's path, send every record on under the token it has there, so two records of
similarity s go on together with chance 1 - (1 - s)^2 a level. Nodes of few records are
compared by brute force on the samples; in larger ones every record is compared with
the node's centre, what is almost equal to the centre leaves, and the rest is split
again. Runs are repeated until a pair at the threshold is met with the target recall.

What this yields are candidates, as spanning links. All pairs within a component of
candidates are then verified on whole shingle sets, recomputed from the texts of those
records alone, in blocks of bounded size. In a large component sets are held as their
differences from one of its sets, as near copies differ in little: for any R,
|A xor B| = |A xor R| + |B xor R| - 2 |(A xor R) and (B xor R)|.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from scriptorium.functions.columns import unused
from scriptorium.llm.text import bounded_batches, mix, shingles, trimmed
from scriptorium.operators.components import connected_components
from scriptorium.plans.store import broadcast_if, counted, drop_path, materialise, materialise_to, scoped, spread

PLACES = 64
#: Records of a node that are compared all with all.
BUCKET = 48
LEVELS = 4
#: Records of a verification block, and shingles of one (8 MB, of which a comparison of two
#: takes some times as much): few records if they differ in much.
BLOCK, SHINGLES = 1024, 1_000_000
#: Candidate records up to this number are broadcast to fetch their texts (40 bytes each).
SMALL = 100_000
#: Links up to this number are united in one task (100 MB), more of them by rounds.
LINKS = 500_000

_SEEDS = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(found: np.ndarray) -> np.ndarray:
    """The sample of a set: for each place the low bits of the token that is least under
    that place's hash."""
    out = np.empty(PLACES, np.int32)
    with np.errstate(over="ignore"):
        for i in range(PLACES):
            x = (found ^ _SEEDS[i]) * np.uint64(0xD6E8FEB86659FD93)
            out[i] = np.int64(found[np.argmin(x ^ (x >> np.uint64(32)))] & np.uint64(0x7FFFFFFF))
    return out


def least_agreement(threshold: float) -> float:
    """The share of places in which two samples must agree to be linked: five standard
    deviations below what is expected of a pair at the threshold."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / PLACES)


def runs_for(threshold: float, target: float) -> int:
    """Runs until a pair at the threshold meets with chance ``target``. All runs split on the
    same sample, of whose places the pair agrees in a binomial number; given a share s, a
    run keeps it together, at any depth, with chance p = 1 - (1 - s * p)^2, and below
    :func:`least_agreement` it is not linked."""

    def missed(runs: int) -> float:
        total = 0.0
        for n in range(PLACES + 1):
            s = n / PLACES
            p = (2 * s - 1) / s**2 if s >= least_agreement(threshold) and s > 0.5 else 0.0
            total += math.comb(PLACES, n) * threshold**n * (1 - threshold) ** (PLACES - n) * (1 - p) ** runs
        return total

    for runs in range(1, 65):
        if missed(runs) <= 1 - target:
            return runs
    raise ValueError(f"64 runs miss more than {1 - target:.2g} of the pairs at {threshold}: lower the target or raise the threshold")


def _sketcher(size: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, content, body in zip(batch["doc_id"], batch["content"], batch["body"]):
                found = shingles(body, size)
                n = len(found)
                rows.append((doc_id, content, hashlib.md5(found.tobytes()).digest() if n else None, n, minima(found) if n else None))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "copy", "n", "sample"])

    return trimmed(sketch)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """A written row per row of ``docs``: row_id, doc_id, content (MD5 of the text), copy
    (digest of the shingle set, null without words), n shingles, sample. Ids pass Python as
    text: pandas holds a long column with nulls in doubles, which end at 2**53."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.md5(body).alias("content"), body.alias("body"))
    made = spread(rows).mapInPandas(_sketcher(size), "doc_id string, content string, copy binary, n int, sample array<int>")
    return materialise(made.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row_id", F.monotonically_increasing_id()), "sketches")


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by ``keys``, across batches. A group is bounded by
    whoever made it."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        edges = np.flatnonzero(np.any([batch[k].to_numpy()[1:] != batch[k].to_numpy()[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, len(batch)]):
            part = batch.iloc[a:b]
            key = tuple(part[k].iloc[0] for k in keys)
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def spanning(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each id the least id that links lead to; ``linked`` is a symmetric matrix."""
    root = ids.copy()
    while True:
        least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, least)
        if (new == root).all():
            return root
        root = new


def _bucket_links(least: float):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["path"]):
            if len(group) < 2:
                continue
            ids, samples = group["rec"].to_numpy(), np.stack(group["sample"].to_numpy())
            root = spanning((samples[:, None, :] == samples[None, :, :]).mean(axis=2) >= least, ids)
            yield pd.DataFrame({"src": ids[ids != root], "dst": root[ids != root]})

    return trimmed(link)


def _children(rows: DataFrame) -> DataFrame:
    """(path, rec) of the two nodes each row goes on to; rows have path, rec, sample."""
    i = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(PLACES)).cast("int")
    j = F.pmod(i + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(PLACES - 1)).cast("int"), F.lit(PLACES))
    child = lambda at: F.xxhash64("path", at, F.get("sample", at))
    return rows.select("rec", F.explode(F.array(child(i), child(j))).alias("path"))


def candidate_links(records: DataFrame, threshold: float, target: float) -> DataFrame:
    """(src, dst) links between records that are likely similar; ``records`` is a written
    table (rec, sample). Links span what is similar: not every pair has one of its own."""
    least, leave = least_agreement(threshold), 1 - (1 - threshold) / 2
    roots = F.explode(F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in range(runs_for(threshold, target))]))
    nodes = materialise(_children(records.select("rec", "sample", roots.alias("path"))), "nodes-1")
    links: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        sizes = materialise(nodes.groupBy("path").agg(F.count("*").alias("n"), F.min("rec").alias("centre")).where("n > 1"), f"sizes-{level}")
        live = nodes.join(sizes, "path")
        few = live.where(F.col("n") <= BUCKET).join(records, "rec").select("path", "rec", "sample")
        few = few.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "rec")
        links.append(materialise(few.mapInPandas(_bucket_links(least), "src long, dst long").distinct(), f"links-{level}"))
        if sizes.where(F.col("n") > BUCKET).isEmpty():
            break
        centres = records.select(F.col("rec").alias("centre"), F.col("sample").alias("centre_sample"))
        many = live.where((F.col("n") > BUCKET) & (F.col("rec") != F.col("centre"))).join(records, "rec").join(centres, "centre")
        same = F.size(F.filter(F.zip_with("sample", "centre_sample", lambda a, b: a == b), lambda x: x)) / PLACES
        many = materialise(many.select("path", "rec", "sample", "centre", same.alias("same")), f"large-{level}")
        # In a node that is large at the last level all are linked: verification is exact.
        links.append(many.where(F.col("same") >= (least if level < LEVELS else 0.0)).select(F.col("rec").alias("src"), F.col("centre").alias("dst")).distinct())
        if level < LEVELS:
            nodes = materialise(_children(many.where(F.col("same") < leave)), f"nodes-{level + 1}")
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def crossed(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As :func:`spanning`, over links between two sets of ids: for the ids of left, then
    right, the least id that links lead to."""
    top = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        to_a = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1))
        to_b = np.minimum(b, np.where(linked, to_a[:, None], top).min(axis=0))
        if (to_a == a).all() and (to_b == b).all():
            return np.concatenate([a, b])
        a, b = to_a, to_b


def similar(a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray, threshold: float, step: int = 2048) -> np.ndarray:
    """Matrix of whether the Jaccard similarity of sets is at least ``threshold``. ``a`` and
    ``b`` are the sets' differences from any one set, or the sets themselves, as sorted
    distinct hashes; ``sizes`` are those of the sets. Tokens of one part alone add to no
    intersection; the others are columns of 0/1 matrices, multiplied ``step`` at a time."""
    of_a, of_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    tokens = np.concatenate(a + b)
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([of_a, of_b]))
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    new = np.cumsum(count > 1) - 1
    row, column = row[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(a) + len(b), step), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        common += m[: len(a)] @ m[len(a) :].T
    apart = (of_a[:, None] + of_b[None, :]) - 2 * common
    total = sizes_a[:, None] + sizes_b[None, :]
    return total - apart >= threshold * (total + apart) - 1e-4


def _verifier(threshold: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["component", "i", "j"]):
            ids, sizes, own = group["rec"].to_numpy(), group["n"].to_numpy(), group["block"].to_numpy()
            parts = [np.frombuffer(s, np.uint64) for s in group["delta"]]
            i, j = group["i"].iloc[0], group["j"].iloc[0]
            left = np.flatnonzero(own == i)
            right = left if i == j else np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            close = similar([parts[k] for k in left], [parts[k] for k in right], sizes[left], sizes[right], threshold)
            if i == j:
                np.fill_diagonal(close, False)
                links, near, of = close.sum(axis=1), spanning(close, ids[left]), ids[left]
            else:
                links = np.concatenate([close.sum(axis=1), close.sum(axis=0)])
                near, of = crossed(close, ids[left], ids[right]), np.concatenate([ids[left], ids[right]])
            yield pd.DataFrame({"rec": of, "n": links.astype(np.int64), "root": near})

    return trimmed(verify)


@F.pandas_udf(BinaryType())
def _difference(tokens: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([np.setxor1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True).tobytes() for a, b in zip(tokens, reference)], dtype=object)


def verified_links(docs: DataFrame, records: DataFrame, candidates: DataFrame, threshold: float, size: int) -> DataFrame:
    """(rec, n, root) rows: numbers of verified partners to be summed by rec, and the least
    record each was joined to. A component of more than BLOCK records or SHINGLES shingles
    is held as differences from the set of its least record, and compared block by block,
    each pair of blocks a group of its own."""
    components = materialise(connected_components(candidates, small=LINKS), "candidates")
    held = components.join(records.select(F.col("rec").alias("node"), "content", "n"), "node")
    sizes = held.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    large = (F.col("m") > BLOCK) | (F.col("shingles") > SHINGLES)
    wanted = materialise(held.join(sizes.select("component", large.alias("large")), "component").select(F.col("node").alias("rec"), "component", "content", "n", "large"), "wanted")
    contents = wanted.select("content").distinct()
    body = F.coalesce("text", F.lit("")).cast("binary")
    texts = docs.select(F.md5(body).alias("content"), body.alias("body")).join(broadcast_if(contents, wanted.count(), SMALL), "content", "left_semi")
    texts = texts.groupBy("content").agg(F.first("body").alias("body"))

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"content": batch["content"], "tokens": [shingles(b, size).tobytes() for b in batch["body"]]})

    sets, path = materialise_to(texts.mapInPandas(trimmed(to_sets), "content string, tokens binary"), "sets")
    of_large = wanted.where("large")
    heads = of_large.where("rec = component")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    if total:  # beside the sets of small components, which stay as they are
        references = materialise(heads.join(sets, "content").select("component", F.col("tokens").alias("reference")), "references")
        apart = of_large.join(sets, "content").join(broadcast_if(references, total, SHINGLES), "component")
        apart = materialise(apart.select("rec", "component", "n", _difference("tokens", "reference").alias("delta")), "differences")
        amounts = apart.groupBy("component").agg(F.count("*").alias("m"), F.sum(F.length("delta")).alias("bytes"))
        blocks = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.col("bytes") / F.lit(8 * SHINGLES))).cast("int")
        dealt = apart.join(counted(materialise(amounts.select("component", blocks.alias("blocks")), "blocks"), SMALL), "component")
        # Blocks by hash; their number follows the component's size.
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
        dealt = dealt.select("rec", "component", "n", "block", "delta", F.explode(pairs).alias("p")).select("rec", "component", "n", "block", "delta", "p.*")
    alone = wanted.where("not large").join(sets, "content").select("rec", "component", "n", F.lit(0).alias("block"), F.col("tokens").alias("delta"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    groups = alone.unionByName(dealt) if total else alone
    groups = groups.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "i", "j").sortWithinPartitions("component", "i", "j", "rec")
    verified = materialise(groups.mapInPandas(_verifier(threshold), "rec long, n long, root long"), "verified")
    drop_path(docs.sparkSession, path)  # the largest table of all, and no later plan reads it
    return verified


@scoped
def join_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, target: float = 0.9999) -> DataFrame:
    """A row per row of ``docs``: doc_id, class_id, n_links, content, first.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least
    ``threshold``. n_links is the number of different sets that the row's own is linked to;
    copies (equal sets) are one set and not counted. class_id is the least doc_id of the
    connected class, copies included. first marks the one row that stands for its class.

    Texts without words (null, empty, marks alone) have no set: each is a class of its own.
    Texts of fewer than ``size`` words are one shingle. Repeated rows are copies; null
    doc_ids take part, and a class of nothing else has a null class_id. An empty table
    gives no rows. Other columns are ignored.
    """
    with bounded_batches(docs.sparkSession):
        return _join_classes(docs, threshold, size, target)


def _join_classes(docs: DataFrame, threshold: float, size: int, target: float) -> DataFrame:
    rows = sketches(docs, size)
    records = rows.where("copy is not null").groupBy("copy").agg(F.min("row_id").alias("rec"), F.min("content").alias("content"), F.first("n").alias("n"), F.first("sample").alias("sample"))
    records = materialise(records, "records")
    found = verified_links(docs, records, candidate_links(records.select("rec", "sample"), threshold, target), threshold, size)
    roots = materialise(connected_components(found.select(F.col("rec").alias("src"), F.col("root").alias("dst")), small=LINKS), "link-classes")
    linked = materialise(found.groupBy("rec").agg(F.sum("n").alias("n_links")).join(roots, F.col("rec") == F.col("node"), "left").select("rec", "n_links", F.coalesce("component", "rec").alias("root")), "linked")
    told = records.select("copy", "rec").join(linked, "rec", "left").select("copy", F.coalesce("root", "rec").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    told = materialise(told, "record-classes")
    full = rows.select("row_id", "doc_id", "content", "copy").join(told, "copy", "left")
    full = materialise(full.select("row_id", "doc_id", "content", F.coalesce("root", "row_id").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "row-classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    heads = materialise(full.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(order).alias("head")).select("root", "class_id", F.col("head.row_id").alias("head")), "class-heads")
    return full.join(heads, "root").select("doc_id", "class_id", "n_links", "content", (F.col("row_id") == F.col("head")).alias("first"))


@scoped
def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5, target: float = 0.9999) -> DataFrame:
    """``docs`` with all its columns, one row of each class: that of the least doc_id. Null and
    empty texts are classes of their own, as in :func:`join_classes`."""
    (own_key,) = unused(docs, "key")
    key = lambda i, c: F.md5(F.concat_ws(":", F.coalesce(i.cast("long").cast("string"), F.lit("null")), c).cast("binary"))
    first = join_classes(docs, threshold, size, target).where("first")
    chosen = materialise(first.select(key(F.col("doc_id"), F.col("content")).alias(own_key)), "kept")
    own = docs.withColumn(own_key, key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    held = own.join(chosen.hint("merge"), own_key, "left_semi")
    # Rows that repeat a doc_id and its text are one document: one of them stays.
    repeated = not own.select(own_key).groupBy(own_key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (held.dropDuplicates([own_key]) if repeated else held).select(docs.columns)
