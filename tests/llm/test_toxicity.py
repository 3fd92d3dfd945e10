"""The whole of op3 against a version without Spark, and held-out rates at sf0.1."""

import random
import zlib
from statistics import NormalDist

import numpy as np
import pytest

from scriptorium.llm import features, toxicity
from scriptorium.llm import queries as llm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def brute(docs, labels):
    """Scores by text: all unlabelled rows in one dense matrix."""
    free = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 != 2
    of = lambda t: set(features.presence((t or "").encode())[0].tolist())
    by = {i: of(t) for i, t in docs if i is not None}
    known = {i: y for i, y in labels.items() if free(i)}
    positive = [by[i] for i, y in known.items() if y and i in by]
    unlabelled = [of(t) for i, t in docs if free(i)]
    n, m, prior = len(positive), len(unlabelled), sum(known.values()) / len(known)
    least = NormalDist().inv_cdf(1 - 0.05 / 2**features.BITS)
    kept = []
    for s in sorted(set().union(*positive)):
        p, u = sum(s in x for x in positive), sum(s in x for x in unlabelled)
        share = (u + 0.5) / (m + 1)
        if p >= min(3, n) and (p / n - u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m)) >= least:
            kept.append(s)
    matrix = lambda rows: np.array([[float(s in x) for s in kept] for x in rows]).reshape(len(rows), len(kept))
    a, c = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(kept)), np.log(prior / (1 - prior))
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, toxicity.STEPS + 1):
        sa, sc = sigmoid(a @ w + b), sigmoid(c @ w + b)
        below = -np.log1p(-sc).mean() + prior * np.log1p(-np.clip(sa, 0, 1 - 1e-12)).mean()
        of_a, of_c = (prior * sa / n, -sc / m) if below < 0 else (prior * (sa - 1) / n - prior * sa / n, sc / m)
        g, gb = a.T @ of_a + c.T @ of_c + 1e-6 * w, of_a.sum() + of_c.sum()
        m1, m2, b1, b2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g, 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        up = toxicity.RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - up * m1 / (np.sqrt(m2) + 1e-8), b - up * b1 / (np.sqrt(b2) + 1e-8)
    low, high = -30.0, 30.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if sigmoid(np.round((c @ w) * toxicity.FINE) / toxicity.FINE + b).mean() < prior else (low, b)
    return lambda t: float(sigmoid(matrix([of(t)]) @ w + b)[0]) if of(t) else 0.0


def test_against_a_dense_version(spark):
    rng = random.Random(13)
    docs, labels = [], {}
    for i in range(600):
        toxic = i % 7 == 0
        words = rng.choices(["stone", "river", "walked", "blue", "hill", "morning", "letter", "house"], k=30)
        words += rng.sample(["idiot", "scum", "moron", "vermin"], 2) if toxic and i % 21 else []
        docs.append((i, " ".join(words)))
        if i % 2:
            labels[i] = int(toxic)
    docs += [(600, None), (601, ""), (602, " \n"), (None, "idiot scum"), (603, "moron " * 30_000), docs[5], (2**60 + 1, "stone vermin")]
    told = brute(docs, labels)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS).repartition(4)
    known = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(df, known, carry=("doc_id", "text")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(told(r.text), abs=1e-6) and r.predicted == (r.score >= 0.3)
    assert any(r.predicted for r in got) and not all(r.predicted for r in got)


@pytest.mark.parametrize("n", [1, 300, 1 << 16, 1 << 18])
def test_places_are_packed(n):
    places = np.sort(np.random.default_rng(1).choice(n, min(n, 200), replace=False))
    assert toxicity.unpacked(toxicity.packed(places, n), n).tolist() == places.tolist()
    assert toxicity.unpacked(toxicity.packed(places[-1:], n), n).tolist() == places[-1:].tolist()
    assert toxicity.unpacked(None, n).tolist() == toxicity.unpacked(toxicity.packed(places[:0], n), n).tolist() == []


def test_sums_over_tasks_are_sums_over_all(spark):
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(50, rng.integers(0, 9), replace=False)).astype("<i4"), int(rng.integers(1, 9))) for _ in range(500)]
    groups = spark.createDataFrame([(bytearray(s.tobytes()), n) for s, n in rows], "slots binary, n long").repartition(7)
    w, b = rng.normal(size=50), 0.3
    told = toxicity.distributed(groups, 50)(w, b)
    one = toxicity.Sums.over(toxicity._Rows([(s, np.ones(len(s))) for s, _ in rows], 50), np.array([float(n) for _, n in rows]), w, b)
    assert (told.n, told.loss, told.score) == pytest.approx((one.n, one.loss, one.score)) and told.by_slot == pytest.approx(one.by_slot)


def test_held_out_rates(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in llm.queries()["op3_toxicity_nnpu"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    said, rare = {r.doc_id for r in rows if r.predicted}, {r.doc_id for r in rows if truth[r.doc_id]}
    assert len(said & rare) >= 0.83 * len(rare) and len(said & rare) >= 0.85 * len(said)
