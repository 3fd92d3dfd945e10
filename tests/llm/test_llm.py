"""The ten operators on small fixtures: brute force, round trips, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import decontaminate, ngram_join, packing, quality_classifier, quality_rules, token_counts, token_files, tokens, toxicity, url_filter, warc
from scriptorium.llm import queries as llm
from scriptorium.plans.store import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPECIAL = ["", None, "   ", "word", "a  b", " lead", "trail ", "x <|endoftext|> y.", "l'été n'est pas　là.\n\n\tthe end", "\U0001f600 " * 30, "long " * 3000]


def documents(spark, texts, extra=False):
    """The texts with ids, a repeated row, and null ids, hosts and languages."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        for c in ("row_id", "n_words", "kept", "score", "length", "content", "digest", "class_id", "path", "words", "key", "rec"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def bpe():
    return llm.vocabulary()


@pytest.fixture(scope="module")
def ids(bpe):
    model = Tokenizer.from_buffer(bpe.data)
    return lambda t: model.encode(t or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_pieces_equal_whole_texts(bpe, ids):
    rng = random.Random(5)
    own = tokens.Encoder(bpe)
    alphabet = ["a", "The", "é", "ß", "7", ".", ",", "'s", "\n", " ", "  ", " ", " ", "<|endoftext|>", "!", "\x1c", "中"]
    texts = SPECIAL + ["".join(rng.choices(alphabet, k=rng.randrange(1, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.packed(t), own.dtype).tolist() == ids(t), repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_get_whole_texts(name):
    file = llm.vocabulary(name)
    own = tokens.Encoder(file)
    if name.endswith(".model"):
        import sentencepiece

        expected = sentencepiece.SentencePieceProcessor(model_proto=file.data).encode("Hello  world.")
    else:
        expected = Tokenizer.from_buffer(file.data).encode("Hello  world.", add_special_tokens=False).ids
    assert np.frombuffer(own.packed("Hello  world."), own.dtype).tolist() == expected


def test_token_files_round_trip(spark, bpe, ids):
    docs = documents(spark, SPECIAL, extra=True)
    folder = fresh_path(spark, "t")
    manifest = token_files.write_token_files(docs, bpe, folder, shards=4)
    got = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 0, *range(1, len(SPECIAL))]
    start, stream = 0, []
    for r in got:
        own = ids(SPECIAL[r.doc_id or 0]) + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), crc(own))
        start, stream = start + len(own), stream + own
    assert token_files.token_ids(spark, manifest, folder, 1, 500).tolist() == stream[1:501]
    # A file system without memory maps gives the same, by ranges of bytes.
    files, place = token_files.filesystem(folder)
    shard = next(r for r in manifest.collect() if r.n_tokens)

    class Remote:
        type_name, get_file_info, open_input_file = "other", files.get_file_info, files.open_input_file

    path = f"{place}/{shard.shard:06d}.ids"
    local, remote = token_files.reader_of(files, path, shard["dtype"]), token_files.reader_of(Remote, path, shard["dtype"])
    assert local[1] == remote[1] == shard.n_tokens and local[0](1, shard.n_tokens).tolist() == remote[0](1, shard.n_tokens).tolist()
    empty = token_files.write_token_files(docs.where("false"), bpe, fresh_path(spark, "t"), shards=2)
    assert token_files.read_token_files(empty, folder).count() == 0


def test_token_counts_come_from_the_cache(spark, bpe, ids):
    docs, cache = documents(spark, SPECIAL, extra=True), fresh_path(spark, "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, bpe, cache, 1024).collect()
        assert len(got) == len(SPECIAL) + 2
        for r in got:
            t = SPECIAL[r.doc_id or 0] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(ids(t)), len(ids(t)) > 1024)
    assert spark.read.parquet(cache).count() == len({t or "" for t in SPECIAL})
    assert token_counts.count_tokens(docs.where("false"), bpe, fresh_path(spark, "cache")).count() == 0


def test_packing(spark, bpe, ids):
    got = packing.pack_documents(documents(spark, SPECIAL, extra=True), bpe, capacity=64).collect()
    bins, texts = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append(r)
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    for doc_id, pieces in texts.items():
        own = ids(SPECIAL[doc_id or 0]) + [2]
        for r in pieces:
            assert crc(own[r.start : r.start + r.length]) == r.ids_crc32
            assert r.length == 64 or len(own) < 64 or r.piece == 0
        assert sum(r.length for r in pieces) == len(own) * (2 if doc_id == 0 else 1)
    assert packing.pack_documents(documents(spark, SPECIAL).where("false"), bpe).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([7, 30, 100])
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 200)))
        room = []
        for length in sorted(counts.elements(), reverse=True):
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                room.append(capacity - length)
            else:
                room[room.index(fit)] -= length
        runs, used, placed = packing.plan_runs(dict(counts), capacity), defaultdict(list), Counter()
        for length, _, n, each, first, offset in runs:
            placed[length] += n
            for k in range(n):
                used[first + k // each].append((offset + k % each * length, length))
        assert placed == counts and len(used) == len(room)
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity


def base_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(covered)


def brute_rules(rows, max_docs=20):
    """doc -> (words removed, kept), by the rule: lines normalised, distinct texts counted per
    host, lines of more than ``max_docs`` removed, depleted texts and base failures rejected."""
    plain = lambda x: " ".join(w for w in re.split(r"[\x20\x09-\x0D]+", x.translate({c: c + 32 for c in range(65, 91)})) if w)
    held = defaultdict(set)
    for _, t, _, host, _ in rows:
        for x in (t or "").split("\n"):
            held[host or "", plain(x)].add(t)
    out = {}
    for i, t, _, host, _ in rows:
        lines = [plain(x) for x in (t or "").split("\n")]
        gone = sum(len(x.split()) for x in lines if x and len(held[host or "", x]) > max_docs)
        n, *_, repeated = base_measures(t)
        out[i] = (gone, n >= 50 and 100 * repeated <= 50 * n and gone <= 0.5 * n)
    return out


def made_prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_quality_rules_measures_and_boilerplate(spark):
    rng = random.Random(4)
    prose = lambda n: made_prose(rng, n)
    texts = SPECIAL + ["a b c a b c\nx\nx\n#*$ |\n\n  "] + ["Read  MORE here\n" + prose(70) for _ in range(30)]
    texts += [f"read more HERE \n{prose(60)}\nread more here" for _ in range(10)]
    rows = [(i, t, "en", "host", 0) for i, t in enumerate(texts)]
    mirror = [prose(12) for _ in range(9)]
    rows += [(1000 + i, "\n".join(x + " " + prose(1) if k == i % 9 else x for k, x in enumerate(mirror)), "en", "host", 0) for i in range(60)]
    footer, copied = prose(130), prose(80)
    rows += [(2000 + i, f"{prose(20)}\n{footer}", "en", "host", 0) for i in range(40)]
    rows += [(3000 + i, copied, "en", "host", 0) for i in range(100)]  # copies are one document
    rows += [(4000 + i, f"{prose(60)}\n{copied}", "en", f"other{i}", 0) for i in range(100)]  # and hosts are apart
    docs = spark.createDataFrame(rows, DOCS)
    got, expected = {r.doc_id: r for r in quality_rules.judge(docs).collect()}, brute_rules(rows)
    for i, t, *_ in rows:
        r, e = got[i], base_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, repr(t)
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert (r.n_removed_words, r.kept) == expected[i]
    footers = [got[2000 + i] for i in range(40)]
    assert not any(r.kept for r in footers) and not any(r.base_failed for r in footers)
    assert all(got[3000 + i].kept and got[4000 + i].n_removed_words == 0 for i in range(100))
    first = len(SPECIAL) + 1
    assert got[first].n_removed_words == 3 and got[first].kept
    kept = {r.doc_id: r.text for r in quality_rules.clean(docs.withColumn("kept", F.lit(1))).collect()}
    assert set(kept) == {i for i, r in got.items() if r.kept}
    assert kept[first] == texts[first].split("\n")[1]


@pytest.mark.parametrize("boilerplate, own", [(1, 1), (2, 1), (2, 4), (6, 3), (8, 2), (6, 1), (3, 9)])
def test_boilerplate_of_several_lines_goes(spark, boilerplate, own):
    """Lines of 12 words that all 200 documents of a host share, beside 10-word lines of
    their own; and 21 copies on another host, which are one document."""
    rng = random.Random(7)
    nav = [made_prose(rng, 12) for _ in range(boilerplate)]
    rows = [(i, "\n".join(nav + [made_prose(rng, 10) for _ in range(own)]), "en", "host", 0) for i in range(200)]
    rows += [(1000 + i, "\n".join(nav), "en", "copies", 0) for i in range(21)]
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_rules(rows)
    assert all(got[i][0] == 12 * boilerplate for i in range(200)) and all(got[1000 + i][0] == 0 for i in range(21))
    n = 12 * boilerplate + 10 * own
    assert all(got[i][1] == (n >= 50 and 12 * boilerplate <= 0.5 * n) for i in range(200))


@pytest.mark.parametrize("small", [50_000, 0])
def test_rules_without_broadcasts_are_the_same(spark, monkeypatch, small):
    monkeypatch.setattr(quality_rules, "SMALL", small)
    rng = random.Random(3)
    nav = [made_prose(rng, 8) for _ in range(3)]
    rows = [(i, "\n".join(nav + [made_prose(rng, 70)]), "en", f"h{i % 2}", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.judge(docs).collect()} == brute_rules(rows)
    assert all(r.text.count("\n") == 0 for r in quality_rules.clean(docs).collect())


def test_rows_that_clash_with_helper_names(spark):
    """Columns called as the operators' own helpers keep their values."""
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)] + ["", None]
    docs = documents(spark, texts)
    names = ("key", "_key", "kept", "_kept", "gone", "_gone", "h", "_h", "content", "rec", "row_id", "host")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    benchmark = spark.createDataFrame([("a", "nothing of this stands there")], "item_id string, text string")
    for out in (quality_rules.clean(docs), ngram_join.keep_one(docs), decontaminate.keep_clean(docs, benchmark), quality_classifier.keep_good(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), threshold=0.0)):
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) >= 6
        for r in got:
            assert all(r[c] == f"{c}{'null' if r.doc_id is None else r.doc_id}" for c in names)


def test_quality_rules_edges(spark):
    docs = documents(spark, SPECIAL, extra=True)
    assert quality_rules.judge(docs).count() == len(SPECIAL) + 2
    assert quality_rules.clean(docs).columns == docs.columns
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_boilerplate_does_not_depend_on_the_size_of_the_host(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    footer = prose(130)
    rows = [(i, f"{prose(60)}\n{footer}", "en", "host", 0) for i in range(21)]
    few = spark.range(22_000).selectExpr("id + 1000 as doc_id", "concat('page ', id) as text", "'en' as lang", "'host' as source", "0L as n_chars")
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS).union(few)).where("doc_id < 1000").collect()
    assert len(got) == 21 and all(r.n_removed_words == 130 and not r.kept and not r.base_failed for r in got)


def labelled(spark, n=400):
    rng = random.Random(9)
    prose = lambda k: " ".join("".join(rng.choices("aeioulnrst", k=5)) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 5 == 0
        t = prose(60) if good else " | ".join(prose(60).split())
        t += " you idiot scum" if toxic else ""
        docs.append((i, t, "en", "s", len(t)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "x", "en", "s", 1), docs[1]]
    labels += [(None, 1, 1), (n, None, None), labels[0], (99999, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, truth", [(quality_classifier.score_quality, lambda i: i % 3 != 0), (toxicity.score_toxicity, lambda i: i % 5 == 0)])
def test_classifiers(spark, score, truth):
    docs, labels = labelled(spark)
    got = score(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2 == 0]
    assert sum(r.predicted == truth(r.doc_id) for r in unseen) >= 0.95 * len(unseen)
    assert {r.score for r in got if r.doc_id in (400, 401)} == {0.0}
    assert score(docs.where("false"), labels).count() == 0
    assert score(docs, labels.where("false")).count() == docs.count()


def rates(rows, truth):
    """(share of the rare kind that is caught, share of what is called so that is)."""
    said, rare = [r.doc_id for r in rows if truth(r)[0]], [r.doc_id for r in rows if truth(r)[1]]
    both = len(set(said) & set(rare))
    return both / max(1, len(rare)), both / max(1, len(said))


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return truth, [r for r in llm.op4_quality_ftrl(spark, sf).collect() if r.held_out and r.doc_id in truth], [r for r in llm.op3_toxicity_nnpu(spark, sf).collect() if r.held_out and r.doc_id in truth]


def test_held_out_rows_beat_a_constant(scored):
    """A classifier that always says the same catches nothing of the rare kind, or is right of
    it no more often than the kind is frequent: here a tenth to a sixth."""
    truth, quality, toxic = scored
    caught, right = rates(quality, lambda r: (not r.predicted, not truth[r.doc_id].quality))
    assert caught >= 0.6 and right >= 0.6
    caught, right = rates(toxic, lambda r: (r.predicted, truth[r.doc_id].toxic))
    assert caught >= 0.5 and right >= 0.8
    for rows, kind in ((quality, "quality"), (toxic, "toxic")):
        constant = max(sum(truth[r.doc_id][kind] == x for r in rows) for x in (0, 1))
        assert sum(r.predicted == truth[r.doc_id][kind] for r in rows) > constant


def test_ftrl_equals_a_scalar_version():
    rng = random.Random(3)
    model, z, n = quality_classifier.Ftrl(), defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2, bias = model.alpha, model.beta, model.l1, model.l2, 1 << quality_classifier.BITS

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(200):
        slots = sorted(rng.sample(range(40), 6))
        values, label, importance = [rng.random() for _ in slots], rng.randrange(2), rng.choice([0.5, 1.0, 2.0])
        model.update(np.array(slots), np.array(values), label, importance)
        x = dict(zip(slots, values)) | {bias: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = importance * (p - label) * v
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    got = model.weights()
    assert any(weight(i) for i in range(40)) and all(got[i] == pytest.approx(weight(i), abs=1e-9) for i in [*range(40), bias])


@pytest.mark.parametrize("negative", [False, True])
def test_nnpu_gradient_against_finite_differences(negative):
    """Where the estimate of the negative risk is below zero the step is that of its
    opposite; else that of the whole risk."""
    rng = np.random.default_rng(5)
    rows = lambda n: [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(n)]
    positive, unlabelled, w, b, prior = rows(7), rows(9), np.zeros(1 << 18), 0.3, 0.9 if negative else 0.1
    w[:12] = rng.normal(size=12) * (3 if negative else 0.5)
    if negative:
        positive = [(s, np.abs(v)) for s, v in positive]
        w[:12], b = np.abs(w[:12]), 1.0
        unlabelled = [(s, v * 0.01) for s, v in unlabelled]
        b = -1.0

    def risks(w, b):
        score = lambda r: sum(w[s] * v for s, v in zip(*r)) + b
        up, down = lambda g: math.log1p(math.exp(-g)), lambda g: math.log1p(math.exp(g))
        below = sum(down(score(r)) for r in unlabelled) / len(unlabelled) - prior * sum(down(score(r)) for r in positive) / len(positive)
        return prior * sum(up(score(r)) for r in positive) / len(positive), below

    below = risks(w, b)[1]
    assert (below < 0) == negative
    risk = lambda w, b: -risks(w, b)[1] if negative else sum(risks(w, b))
    grad, gb = toxicity.risk_gradient(positive, unlabelled, prior, w, b)
    for i in range(12):
        step = np.zeros_like(w)
        step[i] = 1e-5
        assert grad[i] == pytest.approx((risk(w + step, b) - risk(w - step, b)) / 2e-5, abs=1e-5)
    assert gb == pytest.approx((risk(w, b + 1e-5) - risk(w, b - 1e-5)) / 2e-5, abs=1e-5)


def test_null_ids_are_in_no_fold(spark):
    df = spark.createDataFrame([(None, 0.5, 1), (3, 0.5, 1)], "doc_id long, score double, predicted int")
    assert {r.doc_id: r.held_out for r in llm._held_out(df, 4, 2).collect()}[None] is False


def test_warc_round_trip(spark):
    big = "<p>" + "payload é " * 200
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (None, "http://a/n", big), (7, "http://a/7", big), (4, "http://b\r\n/", "tiny"), (5, "http://b/5", "tiny"), (6, "http://c/", None), (8, "http://c/8", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    archives = warc.write_archives(pages, fresh_path(spark, "w"))
    headers, payloads = warc.store_archives(archives)
    assert payloads.count() == 3 and headers.count() == len(rows)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.describe(headers, payloads).collect() if r.verified)
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and page_id != 7
        expected.append((page_id or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(expected, key=repr) or sorted(got, key=repr) == sorted(expected, key=repr)
    made = Counter(bytes(r.record) for r in warc.reconstruct(headers, payloads).collect())
    raw = Counter()
    import gzip

    for r in archives.collect():
        with gzip.open(r.path.removeprefix("file://")) as f:
            raw.update(h + b + b"\r\n\r\n" for h, b in warc.records(f))
    assert made == raw
    assert warc.describe(*warc.store_archives(warc.write_archives(pages.where("false"), fresh_path(spark, "w")))).count() == 0


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    parent, links = {i: i for i in sets}, defaultdict(set)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
                if x != y:
                    links[a].add(y)
                    links[b].add(x)
    return {i: (find(i), len(links[i])) for i in keys}


def near_copies(seed=6):
    rng = random.Random(seed)
    prose = lambda n: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    passage, rows = prose(40), []
    for _ in range(40):
        base = prose(rng.randrange(8, 160))
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = prose(1)[0]
            rows.append(" ".join(w))
    group = prose(200)
    for _ in range(120):  # a node too large for one bucket
        w = list(group)
        w[rng.randrange(200)] = prose(1)[0]
        rows.append(" ".join(w))
    rows += [" ".join(prose(60) + passage) for _ in range(80)]
    rows += ["", "...", None, "one two", "One  TWO!", rows[0], rows[0].upper()]
    return list(enumerate(rows))


@pytest.mark.parametrize("limit, value", [("BLOCK", 50), ("SHINGLES", 1500)])
def test_chosen_path_join_against_brute_force(spark, monkeypatch, limit, value):
    monkeypatch.setattr(ngram_join, limit, value)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_classes(docs).collect()}
    assert got == brute_classes(rows)
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs.union(docs.limit(3))).collect())
    assert kept == sorted(i for i, (c, _) in brute_classes(rows).items() if c == i)


def test_chosen_path_join_edges(spark):
    docs = documents(spark, SPECIAL, extra=True)
    got = ngram_join.join_classes(docs).collect()
    assert len(got) == len(SPECIAL) + 2 and all(r.n_links == 0 for r in got)
    assert ngram_join.join_classes(docs.where("false")).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.runs_for(0.8, 0.9999) > ngram_join.runs_for(0.8, 0.9) >= 1


def test_decontamination_whatever_is_shipped(spark, monkeypatch):
    rng = random.Random(8)
    prose = lambda n: [rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(n)]
    items = [(str(i), " ".join(prose(rng.choice([0, 3, 12, 13, 30])))) for i in range(40)] + [("x", None), ("1", "dup dup dup")]
    texts = [" ".join(prose(60) + (items[i % 40][1] or "").upper().split() + prose(rng.randrange(0, 200))) for i in range(60)] + SPECIAL
    held = defaultdict(set)
    for i, t in items:
        w = WORDS.findall((t or "").lower())
        for k in range(max(1, len(w) - 12) if w else 0):
            held[tuple(w[k : k + 13])].add(i)
    docs, benchmark = documents(spark, texts, extra=True), spark.createDataFrame(items, "item_id string, text string")
    shipped, scanner = [], decontaminate._scanner
    monkeypatch.setattr(decontaminate, "_scanner", lambda vocabulary, lengths: shipped.append(vocabulary) or scanner(vocabulary, lengths))
    for limit in (100_000, 60, 0):
        got = decontaminate.find_contamination(docs, benchmark, limit=limit).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            w = WORDS.findall((texts[r.doc_id or 0] or "").translate({c: c + 32 for c in range(65, 91)}))
            hit, found = set(), set()
            for window, ids_ in held.items():
                for k in range(len(w) - len(window) + 1):
                    if tuple(w[k : k + len(window)]) == window:
                        hit |= set(range(k, k + len(window)))
                        found |= ids_
            assert sorted({x for start, n in r.spans or () for x in range(start, start + n)}) == sorted(hit)
            digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
        # Nothing goes to the tasks beyond the limit: the tokens are then joined.
        assert (len(shipped[-1]) <= limit) if shipped[-1] is not None else limit < 100_000
    plan = decontaminate.find_contamination(docs, benchmark, limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontaminate.find_contamination(docs, benchmark.where("false")).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs.where("false"), benchmark).count() == 0


def test_url_aliases(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    rows = [
        (1, "http://Shop.com/en/x", ""),  # blocked by its rule
        (2, "http://alias.io/a", link.format("http://shop.com/en/x#frag")),  # block by alias
        (3, "http://far.io/b?q=1", '<META http-equiv="refresh" content="0; url=http://alias.io/a">'),  # two steps
        (4, "http://ok.io/", link.format("/other")),
        (5, "http://mirror.io/m", link.format("http://example.com/en/7")),  # an allowed name
        (6, "http://mirror.io/n", link.format("http://mirror.io/m")),
        (7, "http://shop.com/en/y", link.format("http://mirror.io/m")),  # blocked itself, class allowed
        (8, None, None), (9, "no scheme", "x"), (10, "HTTP://far.io/b?q=1#top", ""), (1, "http://Shop.com/en/x", ""), (None, "http://x.de?y", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("x")).withColumn("node", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, llm.RULES).collect()}
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "block", None: "allow"}
    assert by_sql(rows) == got
    assert got[1][:3] == ("shop.com", "/en/x", "com/en/") and got[8][:3] == ("", "", None) and got[9][:2] == ("", "") and got[None][:2] == ("x.de", "")
    redirects = spark.createDataFrame([("http://ok.io/", "http://shop.com/en/x")], "src_url string, dst_url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, llm.RULES, redirects).collect()}[4] == "block"
    assert url_filter.filter_urls(pages.where("false"), llm.RULES).count() == 0


def test_every_tag_of_a_page_names_it(spark):
    bad, link = "http://shop.com/en/q", '<link rel="{}" href="{}">'
    rows = [
        (1, "http://a.io/1", link.format("canonical", "/fine") + link.format("canonical", bad)),  # the second tag
        (2, "http://a.io/2", f"<LINK href={bad} rel=canonical>"),
        (3, "http://a.io/3", link.format("alternate Canonical", bad)),  # a word of rel
        (4, "http://a.io/4", link.format("canonical-not", bad) + f'<link data-rel="canonical" href="{bad}">'),
        (5, "http://a.io/5", f"""<meta http-equiv=refresh content="0;url=/fine"><meta http-equiv="refresh" content="0; URL='{bad}'">"""),
        (6, "http://b.io/d/p", link.format("canonical", bad)),
        (7, "http://b.io/d/e/f", link.format("canonical", "../p")),
        (8, "http://b.io/d/./e/../p", ""),  # what page 6 is, written otherwise
        (9, "http://c.io", link.format("canonical", bad)),
        (10, "http://c.io/", ""),
        (11, "http://shop.com/x/../en/z", link.format("canonical", "/own")),  # its name is blocked, and so its class
        (12, "http://shop.com/own", ""),
        (13, "http://shop.com/x/../en/alone", ""),  # no class, and no rule fits it as written
        (14, "http://a.io/14", f"<link rel=canonical {'x' * 100_000}"),  # no end of tag
        (15, "http://a.io/fine", ""),  # what pages 1 and 5 also call themselves
    ]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), llm.RULES).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 15}
    assert set(got) == set(range(1, 16))
    assert {k: v[3] for k, v in by_sql(rows).items()} == got


def test_rules_are_the_contracts(spark):
    rows = [(1, "http://example.com/en/8", ""), (2, "http://example.com/en/71", ""), (3, "http://a.net/de/1", ""), (4, "http://www.example.net/de/80", ""), (5, "http://x.org/es/", ""), (6, "http://b.io/1", '<link rel="canonical" href="http://a.net/de/1"><link rel="canonical" href="http://x.org/es/2">')]
    expected = {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 6: (None, "allow")}
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), llm.RULES).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == expected
    assert {k: v[2:] for k, v in by_sql(rows).items()} == expected


def by_sql(rows):
    """page_id -> (host, path, rule, verdict) by the registered SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    result = con.execute(llm.oracle_sql()["op9_url_filter"])
    at = [[c[0] for c in result.description].index(x) for x in ("page_id", "host", "path", "rule", "verdict")]
    return {r[at[0]]: tuple(r[i] for i in at[1:]) for r in result.fetchall()}


def web(seed=3, n=240):
    """Pages of which many redirect to, or name as canonical, one another."""
    rng = random.Random(seed)
    urls = [f"http://{rng.choice(['www.', ''])}{rng.choice(['example', 'other', 'third'])}.{rng.choice(['com', 'net', 'org', 'io'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{i}" for i in range(n)]
    rows = []
    for i, url in enumerate(urls):
        target = rng.choice([rng.choice(urls), f"/{rng.choice(['en', 'de'])}/{rng.randrange(n)}", f"sub{i}", "//mirror.io/x"])
        html = rng.choice(["<p>plain</p>", "<p>plain</p>", f'<link rel="canonical" href="{target}">', f'<meta http-equiv="refresh" content="0; url={target}">'])
        rows.append((i, url, html))
    return rows


def brute_verdicts(rows):
    fit = lambda host, path: max(((len(h + p), -k, a) for k, (a, h, p) in enumerate(llm.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, None))[2]
    cut = lambda u: re.match(r"(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)", u).groups()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, url, html in rows:
        if m := re.search(r'(?:href="|url=)([^"]*)"', html):
            scheme, host, path, _ = cut(url)
            t = m[1]
            t = t if "://" in t else f"{scheme}:{t}" if t.startswith("//") else f"{scheme}://{host}{t}" if t.startswith("/") else f"{scheme}://{host}{path.rpartition('/')[0]}/{t}"
            parent[find(url)] = find(t)
    acts = defaultdict(set)
    for name in list(parent):
        acts[find(name)].add(fit(*cut(name)[1:3]))
    return {i: fit(*cut(u)[1:3]) or ("block" if "block" in acts[find(u)] and "allow" not in acts[find(u)] else "allow") for i, u, _ in rows}


def test_url_classes_against_brute_force_and_sql(spark, tmp_path):
    rows = web()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, llm.RULES).collect()}
    expected = brute_verdicts(rows)
    assert got == expected
    plain = brute_verdicts([(i, u, "") for i, u, _ in rows])
    assert sum(plain[i] != v for i, v in expected.items()) > 10  # aliases matter here
    path = str(tmp_path / "pages.parquet")
    pages.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(llm.oracle_sql()["op9_url_filter"])
    at = [c[0] for c in result.description]
    assert {r[at.index("page_id")]: r[at.index("verdict")] for r in result.fetchall()} == expected


def test_recall_by_similarity_band(spark):
    """Pairs of one base text with 1 to 9 words of 100 replaced, which spreads similarities
    from 0.4 to 0.9: every pair of at least 0.8 is found, and none below."""
    rng = random.Random(12)
    rows, pairs = [], []
    for k in range(300):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(100)]
        other = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 10)):
            other[at] = "".join(rng.choices("klmnop", k=5))
        a, b = ({tuple(w[i : i + 5]) for i in range(96)} for w in (base, other))
        pairs.append(len(a & b) / len(a | b))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.n_links for r in ngram_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = Counter()
    for k, s in enumerate(pairs):
        assert (got[2 * k], got[2 * k + 1]) == ((1, 1) if s >= 0.8 else (0, 0))
        bands[min(int(s * 20), 19)] += 1
    assert bands[16] >= 20 and sum(n for band, n in bands.items() if band < 16) >= 20  # 0.80 to 0.85, and below


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    assert parity.same(spark, llm.queries()[name], llm.oracle_sql()[name]) > 0


#: Ids that doubles can't hold, each beside nulls in one Arrow batch.
LARGE = [2**60 + 2 * i + 1 for i in range(30)]


def large_ids(spark):
    rows = [(i, f"text number {k} of its own, with words {k * 7} {k * 11} and nothing else in common") for k, i in enumerate([*LARGE, *[None] * 10])]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).coalesce(1)


def test_large_ids_beside_nulls_stay_as_they_are(spark, bpe):
    docs, all_ids = large_ids(spark), sorted([*LARGE, *[None] * 10], key=str)
    of = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)
    folder = fresh_path(spark, "t")
    assert of(token_files.read_token_files(token_files.write_token_files(docs, bpe, folder, shards=1), folder)) == all_ids
    assert of(packing.pack_documents(docs, bpe, capacity=1024)) == all_ids
    assert of(ngram_join.join_classes(docs)) == all_ids
    assert of(ngram_join.keep_one(docs)) == all_ids
    assert of(token_counts.count_tokens(docs, bpe, fresh_path(spark, "cache"))) == all_ids
    assert of(quality_rules.judge(docs)) == all_ids
    none = spark.createDataFrame([], "item_id long, text string")
    assert of(decontaminate.find_contamination(docs, none)) == all_ids and of(decontaminate.keep_clean(docs, none)) == all_ids
    labels = spark.createDataFrame([(i, k % 2, k % 3 == 0) for k, i in enumerate(LARGE)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    assert of(toxicity.score_toxicity(docs, labels, folds=4, held_out=2)) == all_ids
    assert of(quality_classifier.score_quality(docs, labels, folds=5, held_out=0)) == all_ids


def test_revisits_name_large_pages_beside_nulls(spark):
    body = "x" * 2000
    rows = [(2**60 + 3, "http://a.b/1", body), (2**60 + 1, "http://a.b/2", body), (None, "http://a.b/3", body), (2**60 + 7, None, "short"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    headers, payloads = warc.store_archives(warc.write_archives(pages, fresh_path(spark, "warc"), 1000))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.describe(headers, payloads).collect()), key=str)
    top = 2**60 + 3
    assert got == sorted([(top, "response", None), (2**60 + 1, "revisit", top), (None, "revisit", top), (2**60 + 7, "response", None), (None, "response", None)], key=str)
    named = [r.header.decode() for r in headers.collect()]
    ids = {h.split("WARC-Record-ID: ")[1].split("\r")[0] for h in named}
    assert {h.split("WARC-Refers-To: ")[1].split("\r")[0] for h in named if "WARC-Refers-To: " in h} <= ids
