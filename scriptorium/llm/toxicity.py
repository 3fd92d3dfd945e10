"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic examples and unlabelled text train a linear classifier on hashed word
features, its steps taken in numpy. The risk of the negative class is estimated from unlabelled text less
what the class prior says of it is toxic; where that estimate falls below zero, the
step goes the other way instead of fitting it further.

Every text outside the held-out fold is unlabelled text. Texts are read once: what they have
of the features that several toxic examples share is written, counted, and grouped, as most
texts have little or none of it. A step sums over groups on the executors; the driver
gets sums by feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.features import BITS, labelled, outside_fold, presence, sampled, training_vectors
from scriptorium.llm.text import bounded_batches
from scriptorium.plans.store import materialise, scoped, spread

#: Steps of Adam and their size.
STEPS, RATE = 60, 0.15
#: Groups of unlabelled texts that a task takes, and margins to a bucket of calibration.
GROUPS, FINE = 20_000, 200


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse rows one after the other, for batched dot products and gradients."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], size: int = 1 << BITS):
        self.slot = np.concatenate([s for s, _ in rows] or [np.empty(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([v for _, v in rows] or [np.empty(0)])
        self.row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
        self.n, self.size = len(rows), size

    def dot(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot] * self.value, minlength=self.n) + b

    def gradient(self, each: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, weights=each[self.row] * self.value, minlength=self.size)


@dataclass
class Sums:
    """Over unlabelled rows: their number, the loss as negatives, the sum of scores, and of
    scores by feature."""

    n: float
    loss: float
    score: float
    by_slot: np.ndarray

    @classmethod
    def over(cls, rows: _Rows, counts: np.ndarray, w: np.ndarray, b: float) -> Sums:
        s = _sigmoid(rows.dot(w, b))
        return cls(float(counts.sum()), float(-(counts * np.log1p(-np.clip(s, 0, 1 - 1e-12))).sum()), float((counts * s).sum()), rows.gradient(counts * s))


def telling(p: np.ndarray, u: np.ndarray, n: int, m: int, error: float = 0.05) -> np.ndarray:
    """Which features occur in more of the ``n`` positives than chance allows, given how many
    of the ``m`` unlabelled texts have them: the rest would only be memorised. Standard scores
    are held against the normal quantile at which all 2**BITS features together err with
    chance ``error``."""
    n, m = max(1, n), max(1, m)
    share = (u + 0.5) / (m + 1)
    least = NormalDist().inv_cdf(1 - error / (1 << BITS))
    return (p >= min(3, n)) & ((p / n - u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m)) >= least)


def step_of(positive: _Rows, of_unlabelled: Sums, prior: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """The gradient of a step for weights and bias: of the whole risk, or, where the risk of
    the negative class is estimated below zero, of its opposite. Losses are log(1 + e^-g)
    for a positive and log(1 + e^g) for a negative."""
    sp, u = _sigmoid(positive.dot(w, b)), of_unlabelled
    negative = u.loss / u.n + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-12)).mean()
    of_p, sign = -prior * sp / len(sp), 1.0
    if negative < 0:
        of_p, sign = -of_p, -1.0
    else:
        of_p = of_p + prior * (sp - 1) / len(sp)
    return positive.gradient(of_p) + sign * u.by_slot / u.n, float(of_p.sum() + sign * u.score / u.n)


def risk_gradient(positive: list, unlabelled: list, prior: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """:func:`step_of` for lists of rows."""
    rows = _Rows(unlabelled)
    return step_of(_Rows(positive), Sums.over(rows, np.ones(rows.n), w, b), prior, w, b)


def fit_nnpu(positive: _Rows, sums: Callable[[np.ndarray, float], Sums], prior: float, steps: int = STEPS, rate: float = RATE, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, bias) minimising prior * R+(positive) + max(0, R-(unlabelled) - prior *
    R-(positive)) with the logistic loss, by Adam on all rows; it starts at the prior."""
    w, b = np.zeros(positive.size), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        grad, gb = step_of(positive, sums(w, b), prior, w, b)
        grad = grad + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up = rate * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - up * m / (np.sqrt(v) + 1e-8), b - up * mb / (math.sqrt(vb) + 1e-8)
    return w, float(b)


def calibrated(margins: np.ndarray, counts: np.ndarray, prior: float) -> float:
    """The bias at which the mean score of unlabelled texts is the class prior: steps against
    a negative risk raise all scores together, which this takes back."""
    low, high = -30.0, 30.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if np.average(_sigmoid(margins + b), weights=counts) < prior else (low, b)
    return b


def packed(places: np.ndarray, n: int) -> bytes:
    """Ascending places below ``n`` as their differences, in two bytes each where that will do:
    most are small, so that what is written compresses."""
    return np.diff(places, prepend=0).astype("<u2" if n <= 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes | None, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data or b"", "<u2" if n <= 1 << 16 else "<u4"), dtype=np.int64)


def _held(candidates: np.ndarray):
    """Of a text the places, among the candidates, of the features it has; null of no token."""
    place = np.full(1 << BITS, -1, np.int32)
    place[candidates] = np.arange(len(candidates))

    @F.pandas_udf("binary")
    def held(bodies: pd.Series) -> pd.Series:
        out = []
        for body in bodies:
            slots, _ = presence(body)
            own = place[slots]  # slots ascend, and so do places
            out.append(packed(own[own >= 0], len(candidates)) if len(slots) else None)
        return pd.Series(out, dtype=object)

    return held


def _counted(n_candidates: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_candidates, np.int64)
        for batch in batches:
            for x in batch["slots"]:
                total[unpacked(x, n_candidates)] += 1  # a text has each once
        some = np.flatnonzero(total)
        yield pd.DataFrame({"slot": some, "n": total[some]})

    return count


def _kept(keep: np.ndarray):
    """Places among the telling features, from those among the candidates."""
    place = np.cumsum(keep) - 1

    @F.pandas_udf("binary")
    def kept(slots: pd.Series) -> pd.Series:
        out = []
        for x in slots:
            own = unpacked(x, len(keep))
            out.append(place[own[keep[own]]].astype("<i4").tobytes())
        return pd.Series(out, dtype=object)

    return kept


def _rows_of(batch: pd.DataFrame, size: int) -> _Rows:
    own = [np.frombuffer(x, "<i4") for x in batch["slots"]]
    return _Rows([(s, np.ones(len(s))) for s in own], size)


#: Keys beside features in what a step sums up.
_N, _LOSS, _SCORE = -1, -2, -3


def distributed(groups: DataFrame, size: int) -> Callable[[np.ndarray, float], Sums]:
    """Sums over ``groups`` (slots, n), a Spark job a call; the driver gets a number a feature."""

    def sums(w: np.ndarray, b: float) -> Sums:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                s = Sums.over(_rows_of(batch, size), batch["n"].to_numpy(np.float64), w, b)
                some = np.flatnonzero(s.by_slot)
                yield pd.DataFrame({"slot": np.concatenate([some, [_N, _LOSS, _SCORE]]), "x": np.concatenate([s.by_slot[some], [s.n, s.loss, s.score]])})

        told = {r["slot"]: r["x"] for r in groups.mapInPandas(part, "slot long, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect()}
        by_slot = np.zeros(size)
        for slot, x in told.items():
            if slot >= 0:
                by_slot[slot] = x
        return Sums(told.get(_N, 0.0), told.get(_LOSS, 0.0), told.get(_SCORE, 0.0), by_slot)

    return sums


def margins_of(groups: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(margins to a 1/FINE, how many texts have them): some thousands, whatever the corpus."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = np.clip(_rows_of(batch, len(w)).dot(w, 0.0), -30, 30)
            yield pd.DataFrame({"at": np.round(g * FINE).astype(np.int64), "n": batch["n"]})

    rows = groups.mapInPandas(part, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r["at"] for r in rows]) / FINE, np.array([float(r["n"]) for r in rows])


def train(texts: DataFrame, positive: list[np.ndarray], n_candidates: int, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(which candidates are telling, their weights, bias) from ``texts`` (unlabelled boolean,
    slots) and the candidates that each positive has."""
    known = texts.where("unlabelled").select(F.coalesce("slots", F.lit(b"")).alias("slots"))
    u = np.zeros(n_candidates)
    for r in known.mapInPandas(_counted(n_candidates), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row a candidate
        u[r["slot"]] = r["n"]
    p = np.bincount(np.concatenate(positive or [np.empty(0, np.int64)]), minlength=n_candidates)
    m = known.count()
    keep = telling(p, u, len(positive), m)
    size = int(keep.sum())
    if not positive or not m or not 0 < prior < 1:
        return keep, np.zeros(size), -2.0
    groups = known.select(_kept(keep)("slots").alias("slots")).groupBy("slots").agg(F.count("*").alias("n"))
    groups = materialise(groups, "unlabelled-groups")
    few = -(-groups.count() // GROUPS)
    groups = materialise(groups.repartition(few), "unlabelled-groups") if few > 1 else groups.coalesce(1)
    place = np.cumsum(keep) - 1
    rows = _Rows([(place[x[keep[x]]], np.ones(int(keep[x].sum()))) for x in positive], size)
    w, _ = fit_nnpu(rows, distributed(groups, size), prior)
    return keep, w, calibrated(*margins_of(groups, w), prior)


@scoped
def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: tuple[str, ...] = ("doc_id",), label: str = "toxic", folds: int = 4, held_out: int = 2, positives: int = 4000) -> DataFrame:
    """``carry`` columns of each row with score (0 to 1, higher is likelier toxic) and
    predicted (1 if score >= ``threshold``).

    Trained on at most ``positives`` rows confirmed toxic and on all texts outside the
    held-out fold; the class prior is the share of toxic rows among labelled ones there.
    Null, empty and blank texts have no features and score 0.0; very long ones are read
    whole. Repeated rows score alike; an empty table scores nothing; without toxic examples
    every text gets one low score. Only text, and doc_id to find labelled rows, are read."""
    known = labelled(labels, label, folds, held_out)
    prior = known.agg(F.avg("y")).head()[0] or 0.0
    toxic = [r["doc_id"] for r in sampled(known.where("y = 1"), positives)]
    found = [s for s, _ in training_vectors(docs, toxic, presence).values()]
    slots, n = np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
    candidates = slots[n >= min(3, max(1, len(found)))]
    positive = [np.flatnonzero(np.isin(candidates, s, assume_unique=True)) for s in found]
    free = F.coalesce(outside_fold(folds, held_out), F.lit(False))
    with bounded_batches(docs.sparkSession):
        texts = spread(docs).select(F.struct(*[F.col(c) for c in carry]).alias("of"), free.alias("unlabelled"), _held(candidates)(F.col("text").cast("binary")).alias("slots"))
        texts = materialise(texts, "toxicity-features", compression="zstd")
    keep, w, b = train(texts, positive, len(candidates), prior)
    full = np.zeros(len(candidates))
    full[keep] = w

    @F.pandas_udf("double")
    def score(held: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None else float(_sigmoid(full[unpacked(x, len(full))].sum() + b)) for x in held], dtype="float64")

    return texts.select("of.*", score("slots").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
