"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates (McMahan et al., 2013) and scored as sparse dot
products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.features import BITS, labelled, sampled, scorer, training_vectors


@dataclass
class Ftrl:
    """FTRL-proximal: per-slot learning rates, lazily sparse weights."""

    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-4

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, slot: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        at, x = np.append(slot, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(np.dot(w, x), -30, 30)))
        g = weight * (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, limit: int = 8000, epochs: int = 4) -> tuple[np.ndarray, float]:
    """(weights, bias) from at most ``limit`` labelled rows outside the held-out fold,
    both classes weighing the same. Without labelled rows all weights are zero."""
    target = {r["doc_id"]: r["y"] for r in sampled(labelled(labels, label, folds, held_out), limit)}
    rows = [(*x, target[d]) for d, x in training_vectors(docs, list(target)).items()]
    model = Ftrl()
    good = sum(y for *_, y in rows)
    share = good / len(rows) if rows else 0.5
    for _ in range(epochs if 0 < share < 1 else 1):
        for slot, value, y in rows:
            model.update(slot, value, y, 0.5 / (share if y else 1 - share) if 0 < share < 1 else 1.0)
    w = model.weights()
    return w[:-1], float(w[-1])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: tuple[str, ...] = ("doc_id",), **training) -> DataFrame:
    """``carry`` columns of each row with score (0 to 1, higher is better) and predicted
    (1 if score >= ``threshold``).

    Null, empty and blank texts have no features and score 0.0. Repeated rows score alike. An empty table scores nothing. Only text, and doc_id to find labelled
    rows, are read; rows are scored where they are read, without an exchange."""
    weights, bias = train(docs, labels, **training)
    score = scorer(weights, bias)
    return docs.select(*carry, score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """``docs`` with all its columns, without the rows scored below ``threshold``. Null, empty
    and blank texts score 0.0 and go; repeated rows go or stay together; an empty table
    stays empty."""
    weights, bias = train(docs, labels, **training)
    return docs.where(scorer(weights, bias)(F.col("text")) >= threshold)
