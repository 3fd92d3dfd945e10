import datetime
import functools
import os
import random
import time
from collections import Counter

import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.columns import cosine, jaccard, ngrams, unused
from scriptorium.operators import context, dedup, gazetteer, intervals, links, phrases, pq, search, text, transcripts, usage, vectors
from scriptorium.operators.components import connected_components
from scriptorium.plans import registry, store
from scriptorium.sources import files


def index_of(spark, docs, scope=("lang",)):
    return search.build_index(docs, store.fresh_path(spark, "index"), scope)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(7, 7), (5000, 5000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert got == {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), small=1000).collect()}
    names = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges if a is not None and b is not None], "src string, dst string")
    assert sorted(connected_components(names).collect()) == sorted(connected_components(names, small=1000).collect())


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert connected_components(spark.createDataFrame([], "src string, dst string"), small=9).count() == 0


def test_bm25_scores_are_positive_and_scope_comes_first(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "red red dog", "b"), (3, "", "a"), (4, None, "a")], "doc_id long, text string, lang string")
    index = index_of(spark, docs)
    everywhere = {r.doc_id: r.score for r in search.bm25(index, ["red"]).collect()}
    assert set(everywhere) == {1, 2} and min(everywhere.values()) > 0
    scoped = search.topk(search.bm25(index, ["red"], F.col("lang") == "a"), 1).collect()
    assert [(r.doc_id, r["rank"]) for r in scoped] == [(1, 1)] and scoped[0].score == everywhere[1]


def test_fusion_depends_on_ranks_alone(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, rank long")
    got = {r.doc_id: r.score for r in search.rank_fusion([a, b]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


def test_knn_in_blocks_equals_one_block(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)], "vec_id long, embedding array<float>").repartition(5)
    q = v.where("vec_id % 20 = 0")
    one, many = vectors.knn_topk(v, q, 4), vectors.knn_topk(v, q, 4, block=2)
    assert sorted(one.select("a", "b", "rank").collect()) == sorted(many.select("a", "b", "rank").collect())
    assert vectors.knn_topk(v, v.where("false"), 4).count() == 0


def test_session_gap_that_equals_the_limit_is_one_session(spark):
    rows = spark.sql("select * from values (1, 1L, timestamp_ntz'2024-01-01 00:00:00', 1.0D), (2, 1L, timestamp_ntz'2024-01-01 00:30:00', 1.0D), (3, 1L, timestamp_ntz'2024-01-01 01:00:01', 1.0D) as t(event_id, user_id, ts, value)")
    assert sorted(r.n for r in transcripts.segment_sessions(rows).collect()) == [1, 2]


def test_texts_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "...")], "doc_id long, text string")
    assert text.tokens(docs).count() == 0 and text.extractive_summary(docs, index_of(spark, docs, ())).count() == 0


def test_column_functions(spark):
    r = spark.sql("select array(1f, 0f) as a, array(0f, 2f) as b, array('x','y','z') as w, array('y') as u, array() as e").select(cosine("a", "b").alias("c"), jaccard("w", "u").alias("j"), ngrams(F.col("w"), 2).alias("g"), ngrams(F.col("w"), 4).alias("none")).head()
    assert r.c == 0.0 and r.j == pytest.approx(1 / 3) and r.g == ["x y", "y z"] and r.none == []


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv", "text"])
def test_files_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    df = df.select(F.col("v").alias("value")) if fmt == "text" else df
    files.write(df, str(tmp_path / "t"), fmt)
    assert sorted(files.read(spark, str(tmp_path / "t"), fmt, None if fmt == "text" else "k long, v string").collect()) == sorted(df.collect())


def test_formats_need_schemas(spark):
    with pytest.raises(ValueError):
        files.read(spark, "/nowhere", "csv")
    with pytest.raises(ValueError):
        files.read(spark, "/nowhere", "xlsx")


def test_every_copy_gets_its_cluster(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    base, other, alone = " ".join(words), " ".join(reversed(words)), " ".join(w + "x" for w in words)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base + " end"), (5, base + " end"), (6, other), (7, other), (8, "hi"), (9, "Hi"), (10, alone), (11, "ho"), (12, None), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.duplicate_clusters(docs, dedup.near_duplicates(docs, 0.8), fold_case=True).collect()
    assert sorted((r.doc_id, r.cluster) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6), (8, 8), (9, 8)]
    got = dedup.duplicate_clusters(docs, dedup.near_duplicates(docs)).collect()
    assert sorted((r.doc_id, r.cluster) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6)]


def _likeness(texts: dict[int, str], size: int = 5) -> dict[tuple[int, int], float]:
    sets = {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for i, t in texts.items() if len(w := t.split()) >= size}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}


@pytest.mark.parametrize("bands", [True, False])
def test_near_links_have_the_components_of_all_pairs(spark, monkeypatch, bands):
    """Also where the bands find nothing, and all links come by shared prefixes; copies are
    then too many for a broadcast."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts: dict[int, str] = {}
    for _ in range(12):
        base = [word() for _ in range(60)]
        for _ in range(8):
            own = list(base)
            for at in rng.sample(range(60), rng.randint(0, 3)):
                own[at] = word()
            texts[len(texts)] = " ".join(own)
    texts |= {200: "", 201: "too short", 202: texts[0], 203: texts[0]}
    docs = spark.createDataFrame([*texts.items(), (None, texts[1]), (204, None), (203, texts[0])], "doc_id long, text string")
    if not bands:
        monkeypatch.setattr(dedup, "_band_links", lambda sets: sets.select(F.col("x"), F.col("x").alias("y")).limit(0))
        monkeypatch.setattr(dedup, "shingle_sets", functools.partial(dedup.shingle_sets, limit=0))
    alike = _likeness(texts)
    links = {(r.x, r.y) for r in dedup.near_links(docs).collect()}
    assert links and all(alike[x, y] >= 0.7 for x, y in links)
    root = {i: i for i in texts}
    for (a, b), j in sorted(alike.items()):
        if j >= 0.7:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    sizes = Counter(root.values())
    want = {i: r for i, r in root.items() if sizes[r] > 1}
    assert {r.doc_id: r.cluster for r in dedup.duplicate_clusters(docs, dedup.near_links(docs)).collect()} == want
    assert dedup.near_links(docs.limit(0)).isEmpty()


def test_near_links_of_a_large_class_grow_with_its_members(spark, monkeypatch):
    base = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    own = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    docs = spark.createDataFrame([(i, " ".join([*base, own(i)])) for i in range(5000)], "doc_id long, text string")
    written = {}
    whole = dedup.materialise

    def watched(df, name, **options):
        out = whole(df, name, **options)
        written[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "materialise", watched)
    got = dedup.duplicate_clusters(docs, dedup.near_links(docs)).collect()
    assert len(got) == 5000 and {r.cluster for r in got} == {0}
    assert written["sure-links"] <= 32 * 5000 and not written["classes-met"] and not written["link-candidates"]


@pytest.mark.parametrize("find", [dedup.near_duplicates, dedup.near_links])
def test_near_pairs_exchange_less_than_their_sets(spark, find):
    """Texts without common words, of 196 shingles: 8 bytes each would be one exchange of the sets."""
    words = "transform(sequence(1, 200), i -> translate(md5(concat(id, '-', i)), '0123456789', 'ghijklmnop'))"
    docs = store.materialise(spark.range(16_000).selectExpr("id AS doc_id", f"concat_ws(' ', {words}) AS text"), "apart")

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    assert find(docs).isEmpty()
    assert 0 < written() - before < 12 * 196 * 16_000


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_near_pairs_in_any_common_order_are_all_pairs(spark, monkeypatch, limit):
    """Whatever shingles are told to be frequent, and whatever is too much for a broadcast."""
    rng = random.Random(8)
    line = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(12))
    texts = {}
    for _ in range(15):
        base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(30, 60))]
        for _ in range(4):
            own = base[: rng.randint(len(base) - 6, len(base))]
            own[rng.randrange(len(own))] = "other"
            texts[len(texts)] = " ".join(own) + " " + line
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    monkeypatch.setattr(dedup, "_frequent", functools.partial(dedup._frequent, limit=limit))
    monkeypatch.setattr(dedup, "_similar", functools.partial(dedup._similar, limit=limit))
    monkeypatch.setattr(dedup, "FEW", limit)
    monkeypatch.setattr(dedup, "PICKED", limit)
    for threshold in (0.7, 0.8):
        want = {pair: j for pair, j in _likeness(texts).items() if j >= threshold}
        assert {(r.x, r.y): r.j for r in dedup.near_duplicates(docs, threshold).collect()} == pytest.approx(want)
        links = dedup.near_links(docs, threshold)
        assert {(r.x, r.y) for r in links.collect()} <= set(want)
        edges = spark.createDataFrame([*want], "x long, y long")
        assert sorted(connected_components(links, "x", "y").collect()) == sorted(connected_components(edges, "x", "y").collect())


def test_lsh_connects_what_the_exact_join_finds(spark):
    sf = "/root/testdata/sf0.1"
    exact = registry.queries()["near_duplicates"](spark, sf).collect()
    root = {r.node: r.component for r in connected_components(registry.queries()["near_duplicates_lsh"](spark, sf), "x", "y").collect()}
    near = [r for r in exact if r.j < 1]
    assert len(exact) > 1000 and len(near) > 100
    assert all(root.get(r.x) is not None and root.get(r.x) == root.get(r.y) for r in exact if r.j == 1)
    assert sum(root.get(r.x, -1) == root.get(r.y, -2) for r in near) >= 0.98 * len(near)


def test_index_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (1, "red fox", "a"), (None, "red", None), (2, None, "a")], "doc_id long, text string, lang string")
    index = index_of(spark, docs)
    assert sorted((r.w, r.doc_id or 0, r.tf, r.df, r.dl) for r in search.inverted_index(index).collect()) == [("fox", 1, 1, 2, 2), ("fox", 1, 1, 2, 2), ("red", 0, 1, 3, 1), ("red", 1, 1, 3, 2), ("red", 1, 1, 3, 2)]
    assert len(search.bm25(index, ["red", "red", "cat"]).collect()) == 3
    assert index.stats.head().N == 4
    scan = search.bm25(index, ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "In(w" in scan or "EqualTo(w" in scan


def test_index_is_written_again_when_documents_change(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = lambda t: spark.createDataFrame([(1, t, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    rows("one").write.parquet(path)
    first = registry.index_of(spark, str(tmp_path))
    assert registry.index_of(spark, str(tmp_path)) is first
    rows("two").write.mode("overwrite").parquet(path)
    assert [r.w for r in registry.index_of(spark, str(tmp_path)).terms.collect()] == ["two"]


@pytest.mark.parametrize("limit", [100, 0])
def test_overlap_of_repeated_and_null_ids(spark, limit):
    passage = "known passage of some words"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (1, f"x {passage} y"), (None, passage), (2, "\U0001f600ab"), (3, None), (4, "a known passage")], "doc_id long, text string")
    known = spark.createDataFrame([(9, passage), (8, "\U0001f600a"), (7, None), (6, ""), (5, "ab"), (4, "n p"), (3, "n p")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in context.continuity_overlap(docs, known, limit).collect())
    assert got == [(0, 3), (0, 4), (0, 9), (1, 3), (1, 3), (1, 4), (1, 4), (1, 9), (1, 9), (2, 5), (2, 8), (4, 3), (4, 4)]
    assert context.continuity_overlap(docs, known.where("false"), limit).count() == 0
    plan = context.continuity_overlap(docs, known, limit)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def hot(spark):
    """Events of which one user, and one type, has nine tenths; with null times and ties."""
    rng, rows = random.Random(4), []
    for i in range(3000):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(10 * 86400))
        rows.append((i, None if i % 500 == 499 else at.replace(second=0), 7 if rng.random() < 0.9 else rng.randrange(5), "click" if rng.random() < 0.9 else "purchase", None if i % 97 == 0 else float(rng.randrange(-20, 100)), None))
    return spark.createDataFrame(rows, EVENTS).repartition(4)


@pytest.mark.parametrize("name", ["usage_rolling", "usage_percentiles", "budget_breach", "asof_context"])
def test_hot_keys_are_cut_into_blocks(spark, hot, name):
    made = {"usage_rolling": usage.usage_rolling, "usage_percentiles": usage.usage_percentiles, "budget_breach": usage.budget_breach, "asof_context": transcripts.asof_context}[name](hot)
    con = parity.duck(parity.SF)
    con.register("hot_rows", hot.toPandas())
    con.execute("CREATE OR REPLACE TEMP VIEW events AS SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM hot_rows")
    # DuckDB sorts nulls last unless told.
    con.execute("SET default_null_order = 'nulls_first'")
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert parity.rows(made.columns, made.collect()) == parity.rows(names, result.fetchall())
    plan = made._jdf.queryExecution().analyzed().toString()
    for line in plan.split("\n"):
        if "Window [" in line and "Relation" not in line:
            assert "block" in line


def test_sessions_of_a_hot_user(spark, hot):
    """Sessions cross ranges, and one may span some: a user's events lie close together here."""
    rows = hot.union(spark.sql("select id as event_id, timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, 0, 0, id * 600) as ts, 7L as user_id, 'e' as event_type, 1.5D as value, cast(null as string) as props from range(900)"))
    rows = rows.where("ts is not null")
    made = transcripts.segment_sessions(rows.union(hot.where("ts is null")))
    con = parity.duck(parity.SF)
    con.register("hot_rows", rows.toPandas())
    con.execute("CREATE OR REPLACE TEMP VIEW events AS SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM hot_rows")
    result = con.execute(registry.oracle_sql()["segment_sessions"])
    names = [c[0] for c in result.description]
    assert parity.rows(made.columns, made.collect()) == parity.rows(names, result.fetchall())
    assert max(r.n for r in made.collect()) >= 900


def test_rolling_sums_grow_with_the_rows_alone(spark):
    """A user's day of some tens of thousands of events: no frame is summed again."""
    day = lambda n: spark.sql(f"select id as event_id, timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, 0, 0, id * 86000.0 / {n}) as ts, 1L as user_id, 'e' as event_type, 1.0D as value, '' as props from range({n})")
    took = {}
    for n in (100, 10_000, 40_000):
        start = time.time()
        top = usage.usage_rolling(day(n)).agg(F.max("s")).head()[0]
        took[n] = time.time() - start
        assert top == n
    assert took[40_000] < 3 * took[10_000] + 1


def overlapping(a, b, key=False):
    ok = lambda r: None not in r[1 : 4 if key else 3] and r[1] <= r[2]
    return sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] <= y[2] and y[1] <= x[2] and (not key or x[3] == y[3]))


@pytest.mark.parametrize("block", [30, intervals.BLOCK])
def test_intervals_against_brute_force(spark, block):
    """Points, short and very long intervals, negative times, nulls, ends before starts, and a
    bin with nine tenths of the points."""
    rng = random.Random(11)

    def some(n):
        out = []
        for i in range(n):
            lo = rng.randrange(500, 520) if i % 10 else rng.randrange(-3000, 9000)
            out.append((i, lo, lo + rng.choice([0, 0, 3, 10, 15, 200, 9000, -1]), rng.choice([1, 1, 1, 2, None])))
        return out + [(n, None, 5, 1), (n + 1, 5, None, 1), (n + 2, 7, 7, 2), (n + 2, 7, 7, 2)]

    a, b = some(300), some(260)
    x, y = (spark.createDataFrame(rows, "id long, lo long, hi long, k int").repartition(3) for rows in (a, b))
    pairs = lambda df: sorted((r[0], r[1]) for r in df.select("left.id", "right.id").collect())
    made = intervals.interval_join(x, y, ("lo", "hi"), ("lo", "hi"), block=block)
    assert pairs(made) == overlapping(a, b)
    assert pairs(intervals.interval_join(x, y, ("lo", "hi"), ("lo", "hi"), ("k",), block=block)) == overlapping(a, b, True)
    assert pairs(intervals.interval_join(x, y, ("lo", "lo"), ("hi", "hi"), block=block)) == overlapping([(i, lo, lo, k) for i, lo, _, k in a], [(i, hi, hi, k) for i, _, hi, k in b])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    assert intervals.interval_join(x.where("false"), y, ("lo", "hi"), ("lo", "hi")).count() == 0


def test_intervals_of_times_and_dates(spark):
    rows = spark.sql("select 1 as id, timestamp'2024-01-01 00:00:00' as t, timestamp_ntz'2024-01-01 00:00:00' as n, date'2024-01-01' as d union all select 2, timestamp'2024-01-01 00:00:00.000001', timestamp_ntz'1950-01-01 00:00:00.000001', date'1950-01-02'")
    for c in "tnd":
        assert sorted((r[0], r[1]) for r in intervals.interval_join(rows, rows, (c, c), (c, c)).select("left.id", "right.id").collect()) == [(1, 1), (2, 2)]


def test_phrases_against_brute_force(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choices(["red", "Fox", "a", "the", "é"], k=rng.randrange(0, 30))) for _ in range(200)] + [None, "", "fox fox fox fox", "red, fox! the", "a " * 20_000 + "red fox the"]
    docs = spark.createDataFrame([(None if i == 5 else i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    index = phrases.build_positions(docs, store.fresh_path(spark, "positions"), ("lang",))
    words = [(t or "").lower().replace(",", "").replace("!", "").split() for t in texts]
    of = lambda i: None if i == 5 else i
    for asked in (["red", "fox"], ["fox", "fox"], ["red", "fox", "the"], ["é"], ["gone", "red"]):
        at = {i: [p for p in range(len(w)) if w[p : p + len(asked)] == asked] for i, w in enumerate(words)}
        assert sorted(((r.doc_id, r.n, r.first) for r in phrases.phrase(index, asked).collect()), key=repr) == sorted(((of(i), len(p), p[0]) for i, p in at.items() if p), key=repr)
        expected = {}
        for i, w in enumerate(words):
            spans = [n for n in range(1, 6) if any(set(asked) <= set(w[p : p + n]) for p in range(min(len(w), 60)))] if len(w) < 100 else []
            if spans:
                expected[of(i)] = min(spans)
        assert {r.doc_id: r.span for r in phrases.near(index, asked, 5).collect() if r.doc_id != 204} == {k: v for k, v in expected.items() if k != 204}
    assert {r.doc_id for r in phrases.phrase(index, ["red"], F.col("lang") == "s0").collect()} == {of(i) for i, w in enumerate(words) if "red" in w and i % 2 == 0}
    assert phrases.phrase(index, []).count() == 0 and phrases.near(index, [], 3).count() == 0
    plan = phrases.phrase(index, ["red", "fox"])._jdf.queryExecution().executedPlan().toString()
    assert "In(w, [fox,red])" in plan or "PushedFilters: [In(w" in plan


@pytest.mark.parametrize("limit", [gazetteer.NAMES, 0])
def test_dictionary_against_brute_force(spark, limit):
    rng = random.Random(17)
    words = ["lord", "of", "ash", "vale", "the", "Iron", "é"]
    names = [(rng.randrange(20), " ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3, 5])))) for _ in range(25)] + [(3, None), (4, " .. "), (None, "lord of"), (50, "the"), (51, "Lord, of ash")]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(150)] + [None, "", "lord of ash", "lord of ash vale " * 5000]
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    known = {}
    for entity, alias in names:
        name = tuple((alias or "").lower().replace(",", "").replace("..", "").split())
        if entity is not None and name:
            known[name] = min(entity, known.get(name, 99))
    expected = []
    for i, t in enumerate(texts):
        at, own = 0, (t or "").lower().split()
        while at < len(own):
            best = max((n for n in range(1, 6) if tuple(own[at : at + n]) in known and at + n <= len(own)), default=0)
            if best:
                expected.append((None if i == 3 else i, at, best, known[tuple(own[at : at + best])]))
            at += best or 1
    made = gazetteer.dictionary_mentions(docs, spark.createDataFrame(names, "entity long, alias string"), limit=limit)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr) and len(expected) > 1000
    assert gazetteer.dictionary_mentions(docs, spark.createDataFrame([], "entity long, alias string")).count() == 0


def test_places_are_stored_as_differences(spark):
    import pyarrow.parquet as pq

    path = store.fresh_path(spark, "positions")
    phrases.build_positions(spark.createDataFrame([(1, "a b " * 5000)], "doc_id long, text string"), path)
    folder = path.removeprefix("file://")
    columns = [pq.ParquetFile(f"{folder}/{f}").metadata.row_group(0).column(3) for f in os.listdir(folder) if f.endswith(".parquet") and pq.ParquetFile(f"{folder}/{f}").metadata.num_rows]
    assert columns and all(c.path_in_schema.startswith("places") and "DELTA_BINARY_PACKED" in c.encodings for c in columns)
    assert sum(c.total_compressed_size for c in columns) < 10_000 * 2


def test_quantised_vectors_have_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 18)) * 2
    rows = [(2**60 + i, [float(x) for x in centres[0 if i % 3 == 0 else i % 12] + rng.normal(size=18)]) for i in range(1500)] + [(None, [0.0] * 18), (5, None)]
    for v in (spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")):
        q = v.where("vec_id % 20 = 0")
        index = pq.build_pq(v, store.fresh_path(spark, "pq"), block=256)
        held = index.codes.select(F.sum(F.length("ids")), F.sum(F.length("matrix"))).head()
        n = v.where("vec_id is not null and embedding is not null").count()
        assert tuple(held) == (8 * n, 8 * n)  # 8 bytes a vector, beside its id
        exact = {(r.a, r.b) for r in vectors.knn_topk(v, q, 10).collect()}
        got = pq.pq_topk(index, q, 10, block=16).collect()
        assert len(exact & {(r.a, r.b) for r in got}) >= 0.9 * len(exact) and len(got) == len(exact)
        assert pq.pq_topk(index, q, 3, rerank=10).count() == 3 * q.count() and index.share < 0.5
    empty = pq.build_pq(v.where("false"), store.fresh_path(spark, "pq"))
    assert pq.pq_topk(empty, q, 10).count() == 0


def test_scoped_vector_index_has_recall(spark):
    """Scopes of one and of fifty hundredths, one of fewer vectors than asked for, and none."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16)) * 2
    rows = []
    for i in range(3000):
        scope = None if i % 300 == 7 else "one" if i % 100 == 0 else "few" if i in (20, 1041, 2082) else "half" if i % 2 else "rest"
        rows.append((i, [float(x) for x in centres[i % 20] + rng.normal(size=16)], scope))
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, scope string").repartition(4)
    q = v.where("vec_id % 20 in (0, 1)")
    index = vectors.build_scoped_ivf(v, store.fresh_path(spark, "ivf"), "scope", block=64)
    exact = [(r.a, r.b) for r in vectors.knn_scoped(v, q, "scope", 10, block=32).collect()]
    found = [(r.a, r.b) for r in vectors.ivf_topk_scoped(index, q, "scope", 10, block=16).collect()]
    scope = {i: s for i, _, s in rows}
    assert all(scope[a] == scope[b] is not None for a, b in found)
    asked = {r.vec_id for r in q.where("scope is not null").collect()}
    for name, size in (("one", 30), ("half", 1500), ("few", 3), ("rest", 1400)):
        own = {a for a in asked if scope[a] == name}
        hits, all_of = {x for x in found if x[0] in own}, {x for x in exact if x[0] in own}
        assert len(hits & all_of) >= 0.9 * len(all_of) > 0, name
        assert len(hits) == len(all_of) == len(own) * min(10, sum(s == name for s in scope.values()) - 1)
    one = spark.createDataFrame([(0, rows[0][1], "one")], v.schema)
    plan = vectors.ivf_topk_scoped(index, one, "scope", 5)
    assert plan.count() == 5
    empty = vectors.build_scoped_ivf(v.where("false"), store.fresh_path(spark, "ivf"), "scope")
    assert vectors.ivf_topk_scoped(empty, q, "scope", 10).count() == 0


def test_samples_send_little_to_the_driver(spark):
    """400 tasks, of which each would send its own 2,000 rows under an ordered limit."""
    df = spark.range(0, 400_000, 1, 400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("pad"))
    got = store.hashed_sample(df, "doc_id", 2000)
    assert len(got) == 2000
    expected = [r.doc_id for r in df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2000).collect()]
    assert [r.doc_id for r in got] == expected
    hot = df.select((F.col("doc_id") % 7 * F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1)).alias("doc_id"))
    assert sorted(r.doc_id for r in store.hashed_sample(hot, "doc_id", 100)) == list(range(7))


def test_hot_group_is_packed_in_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 9 + ["b", None]), None if i % 100 == 7 else rng.randrange(0, 50)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long").repartition(3)
    got = {(r.doc_id, r.used) for r in context.context_pack(docs, 400).collect()}
    expected = set()
    for group in {s for _, s, _ in rows}:
        used = None
        for n, i in sorted(((n if n is not None else -1, i) for i, s, n in rows if s == group)):
            used = used if n == -1 else (used or 0) + n
            if used is not None and used <= 400:
                expected.add((i, used))
    assert got == expected


def test_links_resolve_to_pages(spark):
    rows = [(1, "http://A.com/x/y", '<a href="../z?q=1#f"><a href="HTTP://b.com"><a href="//a.com/x/./y"><a href="gone"><a href="#top"><a href="">'), (2, "http://a.com/z?q=1", None), (5, "http://b.com/", ""), (4, "http://b.com/", ""), (3, None, '<a href="http://b.com/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.target, r.dst) for r in links.resolved_links(pages).collect()), key=repr)
    assert got == sorted([(1, "../z?q=1#f", 2), (1, "HTTP://b.com", 4), (1, "//a.com/x/./y", 1), (1, "gone", None), (1, "#top", 1), (1, "", 1), (3, "http://b.com/", 4)], key=repr)


def test_vector_index_has_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    rows = [(i, [float(x) for x in centres[0 if i % 3 == 0 else i % 12] + rng.normal(size=16)]) for i in range(1500)]
    for v in (spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")):
        q = v.where("vec_id % 20 = 0")
        index = vectors.build_ivf(v, store.fresh_path(spark, "ivf"), block=64)
        assert sum(len(r.ids) // 8 for r in index.blocks.collect()) == v.count()
        exact = {(r.a, r.b) for r in vectors.knn_topk(v, q, 10).collect()}
        found = {(r.a, r.b) for r in vectors.ivf_topk(index, q, 10, block=16).collect()}
        assert len(exact & found) >= 0.9 * len(exact)
    assert vectors.ivf_topk(vectors.build_ivf(v.where("false"), store.fresh_path(spark, "ivf")), q, 10).count() == 0


def test_approximate_distinct_counts(spark):
    near = {r.l_returnflag: r.parts for r in registry.queries()["agg_approx_distinct"](spark, parity.SF).collect()}
    exact = {r.l_returnflag: r.parts for r in registry.queries()["agg_distinct"](spark, parity.SF).collect()}
    assert all(abs(near[k] - n) <= 0.08 * n for k, n in exact.items())


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k long, v string").repartition(3)
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    files.write_jdbc(df, url, "notes", partitions=2, **driver)
    got = files.read_jdbc(spark, url, "notes", "K", 0, 50, 4, **driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_scopes_leave_only_what_is_read(spark):
    folder = store.shared_dir(spark).removeprefix("file://") + "/scriptorium"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g")], "doc_id long, text string")
    got = store.scoped(lambda: dedup.duplicate_clusters(docs, dedup.near_duplicates(docs)))()
    assert set(os.listdir(folder)) - before == store.folders_read(got)
    assert got.count() == 2

    @store.scoped
    def fails():
        store.materialise(docs, "lost")
        raise ValueError

    now = set(os.listdir(folder))
    with pytest.raises(ValueError):
        fails()
    assert set(os.listdir(folder)) == now


def test_unused_names(spark):
    assert unused(spark.range(1).selectExpr("1 as KEY", "2 as key_", "3 as x"), "key", "y", "y") == ["key__", "y", "y_"]


def test_small_tables_are_dealt_to_all_cores(spark):
    few = spark.range(100).coalesce(1)
    assert store.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(20)
    assert store.spread(many) is many


def test_words_are_gathered_where_texts_are_read(spark):
    """Pieces of texts, words and places, with no exchange and no task that holds a whole batch."""
    rng = random.Random(4)
    said = [[[rng.choice("abcdef") for _ in range(rng.randrange(4))] for _ in range(rng.randrange(5))] for _ in range(60)] + [[["a"] * text.PIECE, ["a"]], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id long, said array<array<string>>").coalesce(1)
    deep = text.gathered(df, "said")
    flat = text.gathered(df.select("id", F.flatten("said").alias("ws")), "ws")
    for made in (deep, flat):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    expected = {}, {}
    for i, s in enumerate(said):
        for k, (at, w) in enumerate((at, w) for at, ws in enumerate(s) for w in ws):
            expected[0].setdefault((i, w), []).append(at)
            expected[1].setdefault((i, w), []).append(k)
    for made, wanted in zip((deep, flat), expected):
        assert {(r.id, r.w): list(r.places) for r in made.collect()} == wanted


def test_words_are_weighed_without_windows_over_places_or_python_objects(spark):
    docs = spark.createDataFrame([(1, "a b c. a d", "en"), (2, "b a", "en")], "doc_id long, text string, lang string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = phrases.near(phrases.build_positions(docs, store.fresh_path(spark, "positions")), ["a", "b"], 3)
    assert "Window" not in plan(found) and {tuple(r) for r in found.collect()} == {(1, 2), (2, 2)}
    summary = text.extractive_summary(docs, index_of(spark, docs))
    assert "ArrowEvalPython" not in plan(summary) and "MapInArrow" in plan(summary)
    assert {(r.doc_id, r.pos, r["rank"]) for r in summary.collect()} == {(1, 0, 1), (1, 1, 2), (2, 0, 1)}


def test_interval_join_has_tasks_by_its_pairs(spark):
    rows = spark.range(3000).select("id", F.lit(5).alias("lo"))
    made = intervals.interval_join(rows, rows, ("lo", "lo"), ("lo", "lo"), block=100, pairs=100_000)
    sizes = made.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 9_000_000 and len(sizes) == 90 and max(sizes) <= 600_000


def test_interval_join_exchanges_by_its_pairs(spark, monkeypatch):
    """Rows are copied once for a block of pairs told, and not for the candidates of a coarse bin."""
    points = spark.range(4000).select("id", (F.col("id") * 25).alias("lo"))
    spans = spark.range(1000).select("id", (F.col("id") * 100).alias("lo"), (F.col("id") * 100 + F.when(F.col("id") % 8 == 0, 10).otherwise(1500)).alias("hi"))
    exchanged, dealt = [], type(points).repartition

    def repartition(df, *args):
        exchanged.append(df.count())
        return dealt(df, *args)

    monkeypatch.setattr(type(points), "repartition", repartition)
    made = intervals.interval_join(spans, points, ("lo", "hi"), ("lo", "lo"), block=50)
    monkeypatch.undo()
    told = sum(len(range(-(-lo // 25), min(hi // 25, 3999) + 1)) for lo, hi in ((i * 100, i * 100 + (1500 if i % 8 else 10)) for i in range(1000)))
    assert made.count() == told and len(exchanged) == 2
    assert sum(exchanged) <= 2 * (4000 + 1000) + 2 * told // 50


@pytest.mark.parametrize("scope", [None, "lang"])
def test_hits_of_many_queries_are_not_exchanged(spark, monkeypatch, scope):
    """Ties, null and repeated doc_ids, words that many queries ask for: as from all hits by (q, row)."""
    rng = random.Random(5)
    docs = [(None if i % 50 == 0 else i // 2 * 2 if i % 7 == 0 else i, " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 6))), rng.choice(["en", "de", None])) for i in range(600)]
    index = index_of(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4))
    of = {r.w: r.df for r in index.terms.collect()}
    asked = [(q, w, of[w], rng.choice(["en", "de"])) for q in range(0, 400, 2) for w in rng.sample(sorted(of), 3)]
    queries = spark.createDataFrame([*asked, (2, "none", 2, "en"), (5, "a", of["a"], None)][: None if scope else -1], "q long, w string, df long, lang string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    monkeypatch.setattr(search, "PIECE", 1000)
    made = search.bm25_many(index, queries, 5, scope)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "HashAggregate" not in plan
    assert rows(made) == rows(search.bm25_many(index, queries, 5, scope, limit=0))


def test_spreads_against_plain_ends(spark):
    nan = float("nan")
    rows = [(i % 7, i % 3, float(i * 37 % 101)) for i in range(500)] + [(50, 1, None), (51, 1, nan), (51, 1, 2.0), (52, 1, nan), (None, 1, 3.0), (None, 1, 8.0), (53, 1, None), (53, 1, 4.0)]
    df = spark.createDataFrame(rows, "k long, day int, value double").repartition(5)
    made = registry.udfs.spreads(df, ("k", "day"))
    assert "FlatMapGroups" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "ArrowAggregatePython" not in plan and "MapInArrow" in plan
    told = {(r.k, r.day): str(r.spread) for r in made.collect()}
    plain = df.groupBy("k", "day").agg((F.max("value") - F.min("value")).alias("spread"))
    assert told == {(r.k, r.day): str(r.spread) for r in plain.collect()} and len(told) == 26


def test_quantised_candidates_are_not_exchanged(spark):
    """What a task tells is its k best of each query, not the share of all that was ranked."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(4)
    q = v.where("vec_id % 20 = 0")
    near = pq.pq_topk(pq.build_pq(v, store.fresh_path(spark, "pq"), block=64), q, 3)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("MapInPandas") == 3 and near.count() == 3 * q.count()


def test_best_of_a_row_with_ties(spark):
    rng = np.random.default_rng(2)
    sims, ids = rng.integers(0, 4, (20, 50)).astype(float), np.stack([rng.permutation(50) for _ in range(20)])
    sims[3] = -np.inf
    best, own = vectors._best(sims, ids, 7)
    for row in (r for r in range(20) if r != 3):
        assert list(zip(best[row], own[row])) == sorted(zip(sims[row], ids[row]), key=lambda x: (-x[0], x[1]))[:7]
    assert not np.isfinite(best[3]).any()
