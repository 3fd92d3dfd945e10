"""The pipeline against a brute-force version of every stage, on rows of all kinds."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, WORDS, brute_classes, brute_rules, crc, made_prose
from tokenizers import Tokenizer

from scriptorium.llm import features, quality_classifier
from scriptorium.llm import queries as llm
from scriptorium.plans.store import fresh_path
from scriptorium.sources.tables import SCHEMAS

NAMES = ("_key", "_kept", "_gone", "_h", "key", "kept", "content")
HAS = {x[0]: x[1] for x in corpus_pipeline.STAGES}


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows): good prose, junk, boilerplate, copies and near copies, benchmark
    passages, nulls, empty and very long texts, and repeated rows."""
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("corpus"))
    items = [(i, made_prose(rng, 30)) for i in range(6)] + [(6, None), (7, "")]
    nav, footer = made_prose(rng, 12), made_prose(rng, 140)
    texts = [made_prose(rng, rng.randrange(60, 120)) for _ in range(60)]
    texts += [" | ".join("#$%*" for _ in range(rng.randrange(60, 90))) + " " + made_prose(rng, 5) for _ in range(40)]
    texts += [f"{nav}\n{made_prose(rng, 80)}" for _ in range(30)]
    texts += [f"{made_prose(rng, 60)}\n{footer}" for _ in range(25)]
    texts += [t + " end" for t in texts[:8]] + texts[8:12] * 3
    texts += [f"{made_prose(rng, 60)} {items[i % 6][1].upper()} {made_prose(rng, 20)}" for i in range(12)]
    texts += [made_prose(rng, 9000), "", None, "   ", "one two"]
    rows = [(i, t, "en", "host", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, made_prose(rng, 70), None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, SCHEMAS["benchmark"]).write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(not (texts[i] or "").startswith("#")), 0) for i in range(100)]
    spark.createDataFrame(labels, SCHEMAS["labels"]).write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def scores(folder, spark, texts):
    """Scores by the trained weights, a dot product a text in plain Python."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    w, b = quality_classifier.train(docs, labels, folds=5, held_out=0)
    w = w.astype(np.float32)
    out = []
    for t in texts:
        slots, values = features.features((t or "").encode())
        g = sum(float(w[s]) * v for s, v in zip(slots, values)) + b
        out.append(1 / (1 + np.exp(-g)) if len(slots) else 0.0)
    return out


def brute_stage(name, folder, spark, rows, items):
    """(doc_id, text) of what a stage keeps, sorted."""
    if name == "quality_classifier":
        kept = [(r[0], r[1]) for r, s in zip(rows, scores(folder, spark, [r[1] for r in rows])) if s >= 0.3]
    elif name == "quality_rules":
        numbered = [(n, *r[1:]) for n, r in enumerate(rows)]
        told, plain = brute_rules(numbered), lambda x: " ".join(lower(x).split())
        held = {}
        for _, t, _, host, _ in rows:
            for x in (t or "").split("\n"):
                held.setdefault((host or "", plain(x)), set()).add(t)
        cut = lambda t, host: "\n".join(x for x in t.split("\n") if not plain(x) or len(held[host or "", plain(x)]) <= 20)
        kept = [(r[0], cut(r[1], r[3])) for n, r in enumerate(rows) if told[n][1]]
    elif name == "ngram_jaccard_join":
        one = dict(enumerate(sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))))
        classes = brute_classes([(n, t) for n, (_, t) in one.items()])
        kept = [one[n] for n, (c, _) in classes.items() if c == n]
    else:
        windows = set()
        for _, t in items:
            w = WORDS.findall(lower(t))
            windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
        kept = []
        for r in rows:
            w, hit = WORDS.findall(lower(r[1])), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
            if not (hit and 20 * len(hit) >= len(w)):
                kept.append((r[0], r[1]))
    return sorted(kept, key=repr)


def check_packing(got, texts):
    model = Tokenizer.from_buffer(llm.vocabulary().data)
    encoded = {}
    for doc_id, t in texts:
        encoded.setdefault(doc_id, []).append(model.encode(t or "", add_special_tokens=False).ids + [2])
    total = sum(len(x) for own in encoded.values() for x in own)
    assert sum(r.length for r in got) == total
    places = {}
    for r in got:
        assert any(crc(own[r.start : r.start + r.length]) == r.ids_crc32 for own in encoded[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for bins in places.values():
        end = 0
        for offset, length in sorted(bins):
            assert offset == end
            end += length
        assert end <= 1024


def test_every_stage_against_brute_force(spark, corpus):
    """Each stage on all that the one before kept, with columns called as helpers are."""
    folder, _, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r)[:5] for r in docs.collect()]
        path = fresh_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        assert docs.columns == columns
        got = docs.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_stage(name, folder, spark, rows, items), name
        assert all(r[c] == f"{c}{'null' if r.doc_id is None else r.doc_id}" for r in got for c in NAMES)
        sizes.append(len(got))
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes  # every stage has something to do
    check_packing(HAS["best_fit_packing"](spark, docs, folder).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_run_is_its_stages(spark, corpus):
    folder, rows, items = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    left = rows
    for name, _ in corpus_pipeline.STAGES[:-1]:
        kept = brute_stage(name, folder, spark, left, items)
        hosts = {r[0]: r[3] for r in rows}
        left = [(i, t, None, hosts[i], None) for i, t in kept]
    check_packing(got, [(r[0], r[1]) for r in left])


def test_stages_on_nothing(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
