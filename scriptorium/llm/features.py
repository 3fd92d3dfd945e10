"""Hashed word n-gram features of whole texts.

For quality, tokens are runs of letters and digits, lower-cased in ASCII, and runs of other
non-space characters, so marks glued to a word are seen apart from it. Features are
hashed single tokens and pairs, and pairs of token shapes, in 2**BITS slots; a text's vector holds
1 + log counts and has length one, so long texts weigh as much as short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zlib import crc32

from scriptorium.llm.text import bounded_batches
from scriptorium.plans.store import hashed_sample

BITS = 18
_tokens = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+").findall
#: Shape classes: other, lower, capitalised, upper, digits; by a token's first two bytes.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[0x80:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; both empty for null, empty or blank texts."""
    found = _tokens(text) if text else []
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.float64)
    mask = (1 << BITS) - 1
    n = len(found)
    h = np.fromiter(map(crc32, map(bytes.lower, found)), dtype=np.int64, count=n)
    slots = [((h * 0x9E3779B1) >> 13) & mask]
    if n > 1:
        first = _CLASS[np.fromiter((t[0] for t in found), dtype=np.int64, count=n)]
        last = _CLASS[np.fromiter((t[-1] for t in found), dtype=np.int64, count=n)]
        shape = first * 4 + last
        both = ((h[:-1] * 0x85EBCA6B) ^ (h[1:] * 0xC2B2AE35)) & 0x7FFFFFFFFFFF
        same = h[:-1] == h[1:]
        slots.append((both >> 9) & mask)
        slots.append(((shape[:-1] * 16 + shape[1:]) * 2 + same) * 0x2545F491 >> 7 & mask)
    slot, count = np.unique(np.concatenate(slots), return_counts=True)
    value = 1.0 + np.log(count)
    return slot, value / np.sqrt(np.dot(value, value))


def presence(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, ones) of the distinct tokens of a text and of their first four to six
    bytes, which inflected forms of a word share."""
    found = set(_tokens(text.lower())) if text else ()
    hashes = {crc32(t) for t in found}
    for n in (4, 5, 6):
        hashes.update(crc32(t, n) for t in {t[:n] for t in found if len(t) >= n})
    slot = np.unique(np.fromiter(hashes, dtype=np.int64, count=len(hashes)) * 0x9E3779B1 >> 13 & (1 << BITS) - 1)
    return slot, np.ones(len(slot))


def vectors(docs: DataFrame, carry: str, make_one=features) -> DataFrame:
    """(carry long, slots, values) of each row as packed integers and floats."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [make_one(b) for b in batch["body"]]
            yield pd.DataFrame({"carry": batch["carry"], "slots": [s.astype("<i4").tobytes() for s, _ in made], "vals": [v.astype("<f4").tobytes() for _, v in made]})

    return docs.select(F.col(carry).cast("long").alias("carry"), F.col("text").cast("binary").alias("body")).mapInPandas(make, "carry long, slots binary, vals binary")


def scorer(weights: np.ndarray, bias: float, make_one=features, blank: float = 0.0):
    """A column function: text -> score in 0..1, the sigmoid of a sparse dot product, and
    ``blank`` for a text without tokens. The weights (2**BITS single floats, a megabyte)
    are a fixed size."""
    held = weights.astype(np.float32)

    @F.pandas_udf("double")
    def score(bodies: pd.Series) -> pd.Series:
        out = np.empty(len(bodies))
        for i, body in enumerate(bodies):
            slot, value = make_one(body)
            out[i] = 1.0 / (1.0 + np.exp(-np.clip(np.dot(held[slot], value) + bias, -30, 30))) if len(slot) else blank
        return pd.Series(out)

    return lambda text: score(text.cast("binary"))


def outside_fold(folds: int, held_out: int):
    """Rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out


def labelled(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) outside the held-out fold. Repeated doc_ids count once; ids whose labels
    differ, null ids and null labels are left out."""
    rows = labels.where(f"doc_id is not null and {label} is not null").select("doc_id", F.col(label).cast("int").alias("y")).where(outside_fold(folds, held_out))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")


def sampled(ids: DataFrame, limit: int) -> list:
    """Up to ``limit`` rows by the order of a hash of doc_id: a bounded sample."""
    return hashed_sample(ids, "doc_id", limit)


def training_vectors(docs: DataFrame, ids: list[int], make_one=features) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """doc_id -> (slots, values) of a bounded sample, ordered by a hash of doc_id. The ids
    are broadcast, as bounded as the sample; of rows that repeat a doc_id one is taken."""
    chosen = docs.sparkSession.createDataFrame([(i,) for i in set(ids)], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat a doc_id the one of the least text hash counts, whatever arrives first.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    with bounded_batches(docs.sparkSession):
        got = {r["carry"]: (np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["vals"], "<f4").astype(np.float64)) for r in vectors(rows, "doc_id", make_one).collect()}  # as bounded as the sample
    return dict(sorted(got.items(), key=lambda x: (crc32(str(x[0]).encode()) * 0x9E3779B1 & 0xFFFFFFFF, x[0])))
