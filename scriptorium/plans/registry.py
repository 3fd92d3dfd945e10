"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import udfs
from scriptorium.functions.urls import ABSOLUTE, LOWER, UPPER, URL
from scriptorium.operators import context, dedup, gazetteer, hierarchy, intervals, links, phrases, pq, search, text, transcripts, usage, vectors
from scriptorium.operators.usage_store import UsageStore
from scriptorium.plans import relational
from scriptorium.plans.store import drop_path, fingerprint, fresh_path, materialise, scoped
from scriptorium.sources import layout, turnlog
from scriptorium.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed inputs of the registered searches.
TERMS = ["the", "license", "queque", "und"]
SCOPE = "en"
REGION = "ASIA"
BUDGET, CONTEXT, KEYWORDS = 1000, 20_000, 8


def _on(function, *names: str, **options) -> Query:
    """A query that applies ``function`` to tables by name."""
    return lambda spark, sf_dir: function(*[table(spark, sf_dir, n) for n in names], **options)


_kept: dict[tuple[str, str, str], tuple[str, search.Index | phrases.Positions]] = {}


def _index(spark: SparkSession, sf_dir: str, kind: str, build: Callable) -> search.Index | phrases.Positions:
    """An index of a folder's documents: written on first use in a session, and anew when the
    documents' files have changed; the one before is then deleted."""
    key, now = (spark.sparkContext.applicationId, sf_dir, kind), fingerprint(spark, f"{sf_dir}/documents.parquet")
    was, index = _kept.get(key, (None, None))
    if was != now:
        if index:
            drop_path(spark, index.path)
        index = build(table(spark, sf_dir, "documents"), fresh_path(spark, kind), ("lang",))
        _kept[key] = (now, index)
    return index


def index_of(spark: SparkSession, sf_dir: str) -> search.Index:
    return _index(spark, sf_dir, "index", search.build_index)


def positions_of(spark: SparkSession, sf_dir: str) -> phrases.Positions:
    return _index(spark, sf_dir, "positions", phrases.build_positions)


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(index_of(spark, sf_dir), TERMS, F.col("lang") == SCOPE)


def _bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.topk(_bm25(spark, sf_dir), 20).select("doc_id", "rank")


def _queries_of(v: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return v.where("vec_id % 20 = 0")


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.knn_topk(v, _queries_of(v), 10).select("a", "b", "rank")


def _cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.cosine_pairs(v, _queries_of(v), 0.3)


def _knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.ivf_topk(vectors.build_ivf(v, fresh_path(spark, "ivf")), _queries_of(v), 10).select("a", "b", "rank")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector of the query set, taking vec_id as doc_id: the 20 best documents by
    the document's KEYWORDS rarest words, fused with its 20 nearest neighbours."""
    v, index = table(spark, sf_dir, "embeddings"), index_of(spark, sf_dir)
    asked = search.keywords(index, _queries_of(v).select(F.col("vec_id").alias("q")), KEYWORDS)
    near = vectors.knn_topk(v, _queries_of(v), 20).select(F.col("a").alias("q"), F.col("b").alias("doc_id"), "rank")
    return search.rank_fusion([search.bm25_many(index, asked, 20), near], query=("q",))


def _knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.knn_scoped(v, _queries_of(v), "label", 10).select("a", "b", "rank")


def _knn_ivf_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.ivf_topk_scoped(vectors.build_scoped_ivf(v, fresh_path(spark, "ivf"), "label"), _queries_of(v), "label", 10).select("a", "b", "rank")


def _knn_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return pq.pq_topk(pq.build_pq(v, fresh_path(spark, "pq")), _queries_of(v), 10).select("a", "b", "rank")


def _hybrid_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``hybrid_rrf``, with both rankings inside the language of the query's document."""
    v, index = table(spark, sf_dir, "embeddings"), index_of(spark, sf_dir)
    v = v.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id")
    queries = _queries_of(v)
    asked = search.keywords(index, queries.select(F.col("vec_id").alias("q")), KEYWORDS).join(queries.select(F.col("vec_id").alias("q"), "lang"), "q")
    near = vectors.knn_scoped(v, queries, "lang", 20).select(F.col("a").alias("q"), F.col("b").alias("doc_id"), "rank")
    return search.rank_fusion([search.bm25_many(index, asked, 20, "lang"), near], query=("q",))


PHRASE, CLOSE, WITHIN = ["released", "under", "the", "mit", "license"], ["the", "license", "under"], 6


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that any user had in the minutes (as many as its value) before a purchase."""
    events = table(spark, sf_dir, "events")
    minutes = F.floor(F.greatest(F.col("value"), F.lit(0.0))).cast("long")
    spans = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), (F.col("ts") - F.make_dt_interval(mins=minutes.cast("int"))).alias("from"), "ts")
    return intervals.interval_join(spans, events.select("event_id", "ts"), ("from", "ts"), ("ts", "ts")).select("left.purchase_id", "right.event_id")


def _open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's items that were under way at once: between order and shipment,
    whichever came first, of different orders."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    spans = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_orderkey", F.least("o_orderdate", "l_shipdate").alias("from"), F.greatest("o_orderdate", "l_shipdate").alias("to"))
    late = spans.where(F.datediff("to", "from") <= 120)
    pairs = intervals.interval_join(late, late, ("from", "to"), ("from", "to"), ("o_custkey",)).where("left.l_orderkey < right.l_orderkey")
    return pairs.groupBy(F.col("left.o_custkey").alias("o_custkey")).agg(F.count("*").alias("n"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as entities, known by their first three words, their first six, or the
    two after the first."""
    words = F.col("ws")
    items = table(spark, sf_dir, "benchmark").select("item_id", text.letters("text").alias("ws"))
    aliases = F.array(*[F.array_join(F.slice(words, a, n), " ") for a, n in ((1, 3), (1, 6), (2, 2))])
    return gazetteer.dictionary_mentions(table(spark, sf_dir, "documents"), items.select(F.col("item_id").alias("entity"), F.explode(aliases).alias("alias")))


@scoped
def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and items laid out in the same buckets, joined, grouped and ranked as they lie."""
    paths = {n: fresh_path(spark, n) for n in ("orders", "lineitem")}
    names = {n: p.rpartition("/")[2].replace("-", "_") for n, p in paths.items()}
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    buckets = layout.buckets_for(max(layout.rows_bytes(table(spark, sf_dir, n)) for n in paths))
    orders, items = (layout.lay_out(table(spark, sf_dir, n), names[n], paths[n], (keys[n],), buckets) for n in paths)
    late = items.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey"))).where("k = 1")
    told = materialise(orders.join(late, orders["o_orderkey"] == late["l_orderkey"]).select("o_orderkey", "o_custkey", "l_shipdate"), "last-items")
    for n in paths:
        layout.drop(spark, names[n], paths[n])
    return told


@scoped
def _turnlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a log of turns, written and read back for a range of them."""
    turnlog.register(spark)
    path = fresh_path(spark, "turnlog")
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.format("turnlog").mode("append").save(path)
    told = materialise(spark.read.format("turnlog").load(path).where("conv_id >= 3 and conv_id < 60"), "turns")
    drop_path(spark, path)
    return told


@scoped
def _kept_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube from states that three batches, one of them run twice, and a correction that was
    taken back have added to."""
    store, events = UsageStore(spark, fresh_path(spark, "usage")), table(spark, sf_dir, "events")
    for i in (0, 1, 2, 1):
        store.append(events.where(F.col("event_id") % 3 == i), f"batch-{i}")
    wrong = events.where("event_type = 'error'")
    store.append(wrong, "wrong")
    store.append(wrong, "taken-back", retract=True)
    told = materialise(store.cube(), "usage-cube")
    drop_path(spark, store.path)
    return told


@scoped
def _usage_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, events = UsageStore(spark, fresh_path(spark, "usage")), table(spark, sf_dir, "events")
    for i in range(3):
        store.append(events.where(F.col("event_id") % 3 == i), f"batch-{i}")
    told = materialise(store.rollup("event_type", "day"), "usage-rollup")
    drop_path(spark, store.path)
    return told


def _link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_edges(table(spark, sf_dir, "pages"))


@scoped
def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup.duplicate_clusters(docs, dedup.near_links(docs))


@scoped
def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``duplicate_clusters``, at 0.8 and with texts that differ in case alone as copies."""
    docs = table(spark, sf_dir, "documents")
    return dedup.duplicate_clusters(docs, dedup.near_links(docs, 0.8), fold_case=True)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.extractive_summary(table(spark, sf_dir, "documents"), index_of(spark, sf_dir))


def _words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").lateralJoin(udfs.WordsOf(F.col("text").outer())).select("item_id", "pos", "word")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return udfs.spreads(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("day"), "value"), ("user_id", "day"))


def _approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy_rollup(*[table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")])


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.scope_filter(REGION, *[table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")])


TOKENS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents"
_BM25_SQL = rf"""
WITH words AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '\p{{L}}+') AS ws FROM documents),
d AS (SELECT doc_id, lang, len(ws) AS dl, {", ".join(f"len(list_filter(ws, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))} FROM words),
s AS (SELECT count(*) AS n, avg(dl) FILTER (WHERE dl > 0) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(TERMS)))} FROM d)
SELECT doc_id, {" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(TERMS)))} AS score
FROM d, s WHERE lang = '{SCOPE}' AND greatest({", ".join(f"tf{i}" for i in range(len(TERMS)))}) > 0"""
_TOPK_SQL = f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_BM25_SQL}) t ORDER BY score DESC, doc_id LIMIT 20"
_SIM = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_NEAR_SQL = f"SELECT a, b, rank FROM (SELECT q.vec_id AS a, v.vec_id AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE %s) t WHERE rank <= %d"
_SHINGLES_SQL = r"""
words AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s, md5(array_to_string(s, '|')) AS h FROM words WHERE len(w) >= 5),
heads AS (SELECT min(doc_id) AS x, h, any_value(s) AS s FROM sets GROUP BY h),
flat AS (SELECT x, len(s) AS n, unnest(s) AS g FROM heads),
near AS (SELECT a.x AS x, b.x AS y, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM flat a JOIN flat b ON a.g = b.g AND a.x < b.x GROUP BY a.x, b.x),
pairs AS (SELECT x, y, j FROM near WHERE j >= 0.7 UNION ALL SELECT h.x, s.doc_id, 1.0::DOUBLE FROM sets s JOIN heads h ON s.h = h.h WHERE s.doc_id <> h.x)"""
_FOLDED_SQL = r"""
once AS (SELECT min(doc_id) AS x, lower(text) AS t FROM documents GROUP BY lower(text)),
words AS (SELECT x, regexp_extract_all(t, '\p{L}+') AS w FROM once),
sets AS (SELECT x, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM words WHERE len(w) >= 5),
flat AS (SELECT x, len(s) AS n, unnest(s) AS g FROM sets),
near AS (SELECT a.x AS x, b.x AS y, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM flat a JOIN flat b ON a.g = b.g AND a.x < b.x GROUP BY a.x, b.x)"""
_INDEX_SQL = f"""
t AS ({TOKENS}), tf AS (SELECT w, doc_id, count(*) AS tf FROM t GROUP BY w, doc_id), dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)"""
_HYBRID_SQL = f"""WITH {_INDEX_SQL}, st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(dl) FROM dl) AS avgdl),
asked AS (SELECT q, w, df FROM (SELECT v.vec_id AS q, tf.w AS w, df.df AS df, row_number() OVER (PARTITION BY v.vec_id ORDER BY df.df, tf.w) AS k FROM embeddings v JOIN tf ON tf.doc_id = v.vec_id JOIN df ON df.w = tf.w WHERE v.vec_id % 20 = 0 AND df.df >= 2) a WHERE k <= {KEYWORDS}),
sc AS (SELECT q, tf.doc_id AS doc_id, sum(CAST(floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1000000) AS BIGINT)) AS score FROM asked JOIN tf ON tf.w = asked.w JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY q, tf.doc_id),
ranked AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc)
SELECT q, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT q, doc_id, rank FROM ranked WHERE rank <= 20 UNION ALL SELECT a, b, rank FROM ({_NEAR_SQL % ('q.vec_id % 20 = 0', 20)}) n) u GROUP BY q, doc_id"""
_SCOPED_SQL = _HYBRID_SQL.replace("asked AS (SELECT q, w, df FROM", "lg AS (SELECT doc_id, lang FROM documents),\nasked AS (SELECT q, w, df, lang FROM lg JOIN").replace(f"WHERE k <= {KEYWORDS})", f"ON lg.doc_id = q WHERE k <= {KEYWORDS})", 1).replace("JOIN tf ON tf.w = asked.w JOIN dl", "JOIN tf ON tf.w = asked.w JOIN lg ON lg.doc_id = tf.doc_id AND lg.lang = asked.lang JOIN dl", 1).replace(_NEAR_SQL % ("q.vec_id % 20 = 0", 20), _NEAR_SQL.replace("JOIN embeddings v ON", "JOIN lg lq ON lq.doc_id = q.vec_id JOIN lg lv ON lv.lang = lq.lang JOIN embeddings v ON v.vec_id = lv.doc_id AND") % ("q.vec_id % 20 = 0", 20))
_ABC = f"'{UPPER}', '{LOWER}'"
_WORDS_SQL = r"SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents) d"


_DICTIONARY_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM benchmark),
n AS (SELECT name, min(item_id) AS entity FROM (SELECT item_id, unnest([ws[1:3], ws[1:6], ws[2:3]]) AS name FROM i) a WHERE len(name) > 0 GROUP BY name),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents),
t AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d),
m AS (SELECT doc_id, p, max({'n': len(name), 'entity': entity}) AS x FROM t JOIN n ON t.ws[p] = n.name[1] AND t.ws[p:p + len(name) - 1] = n.name GROUP BY doc_id, p),
l AS (SELECT doc_id, list({'p': p, 'n': x.n, 'entity': x.entity} ORDER BY p) AS ms FROM m GROUP BY doc_id),
c AS (SELECT doc_id, list_reduce(ms, lambda s, y: CASE WHEN y.p >= s.e THEN {'e': y.p + y.n, 'picked': list_append(s.picked, y)} ELSE s END, {'e': 0::BIGINT, 'picked': CAST([] AS STRUCT(p BIGINT, n BIGINT, entity BIGINT)[])}) AS s FROM l)
SELECT doc_id, x.p - 1 AS place, x.n AS n, x.entity AS entity FROM (SELECT doc_id, unnest(s.picked) AS x FROM c) u"""


def _phrase_sql(words: list[str]) -> str:
    joins = " ".join(f"JOIN t t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.place = t0.place + {i} AND t{i}.w = '{w}'" for i, w in enumerate(words) if i)
    return f"WITH t AS ({_WORDS_SQL}) SELECT t0.doc_id AS doc_id, count(*) AS n, min(t0.place) AS first FROM t t0 {joins} WHERE t0.w = '{words[0]}' GROUP BY t0.doc_id"


def _near_sql(words: list[str], within: int) -> str:
    lasts = ", ".join(f"last_value(CASE WHEN w = '{w}' THEN place END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS l{i}" for i, w in enumerate(words))
    names = [f"l{i}" for i in range(len(words))]
    return f"WITH t AS ({_WORDS_SQL}), s AS (SELECT doc_id, place, {lasts} FROM t WHERE w IN ({', '.join(repr(w) for w in words)})) SELECT doc_id, min(place - least({', '.join(names)}) + 1) AS span FROM s WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)} AND place - least({', '.join(names)}) + 1 <= {within} GROUP BY doc_id"


def name_sql(url: str) -> str:
    part = lambda i: f"regexp_extract({url}, '{URL}', {i})"
    walked = f"list_reduce(list_concat([''], string_split({part(3)}, '/')[2:]), lambda seen, x: CASE WHEN x = '..' THEN regexp_replace(seen, '/[^/]*$', '') WHEN x = '.' THEN seen ELSE seen || '/' || x END)"
    path = rf"CASE WHEN {part(3)} = '' THEN '/' WHEN regexp_matches({part(3)}, '/\.\.?(/|$)') THEN {walked} || CASE WHEN regexp_matches({part(3)}, '/\.\.?$') THEN '/' ELSE '' END ELSE {part(3)} END"
    return f"CASE WHEN contains({url}, '://') THEN translate({part(1)}, {_ABC}) || '://' || translate({part(2)}, {_ABC}) || {path} || {part(4)} END"


def resolved_sql(target: str, url: str) -> str:
    """A link target as an absolute url, seen from ``url``; ``&amp;`` is already read."""
    part = lambda i: f"regexp_extract({url}, '{URL}', {i})"
    base = f"({part(1)} || '://' || translate({part(2)}, {_ABC}))"
    return f"""CASE WHEN regexp_matches({target}, '{ABSOLUTE}') THEN {target} WHEN starts_with({target}, '//') THEN {part(1)} || ':' || {target} WHEN starts_with({target}, '/') THEN {base} || {target}
  WHEN starts_with({target}, '?') THEN {base} || {part(3)} || {target} WHEN starts_with({target}, '#') OR {target} = '' THEN {url}
  ELSE {base} || regexp_replace(CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END, '[^/]*$', '') || {target} END"""


def _links_sql() -> str:
    return f"""
WITH names AS (SELECT {name_sql('url')} AS name, min(page_id) AS dst FROM pages WHERE url IS NOT NULL GROUP BY 1),
edges AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
seen AS (SELECT *, replace(target, '&amp;', '&') AS t FROM edges),
full_url AS (SELECT page_id, target, {resolved_sql('t', 'url')} AS u FROM seen)
SELECT page_id, target, dst FROM full_url LEFT JOIN names ON names.name = {name_sql('u')}"""


_SENTENCES_SQL = r"SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents) t"

#: name -> (query, DuckDB SQL or None where SQL can't express it).
QUERIES: dict[str, tuple[Query, str | None]] = {
    "hierarchy_rollup": (_rollup, "SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, CAST(grouping(r_name, n_name) AS BIGINT) AS gid FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"),
    "scope_filter": (_scope, f"SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{REGION}'"),
    "hierarchy_walk": (lambda s, d: relational.run_sql(s, d, hierarchy.WALK), hierarchy.WALK),
    "html_to_text": (_on(text.html_to_text, "pages"), "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_len FROM pages"),
    "outline": (_on(text.outline, "pages"), r"SELECT page_id, pos, regexp_extract(tag, '^<(h[1-6]|li)', 1) AS kind, regexp_extract(tag, '>([^<]*)$', 1) AS text FROM (SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(?:h[1-6]|li)[^>]*>[^<]*') AS t FROM pages) a) b"),
    "normalize_text": (_on(text.normalize_text, "documents"), r"SELECT doc_id, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM documents"),
    "link_edges": (_link_edges, "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages"),
    "resolved_links": (_on(links.resolved_links, "pages"), _links_sql()),
    "backlink_count": (lambda s, d: links.backlink_count(_link_edges(s, d)), "SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) t GROUP BY target"),
    "orphan_notes": (_on(links.orphan_notes, "documents", "labels"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "tokenize": (_on(text.tokens, "documents"), TOKENS),
    "inverted_index": (lambda s, d: search.inverted_index(index_of(s, d)), f"WITH {_INDEX_SQL} SELECT tf.w AS w, tf.doc_id AS doc_id, tf, df, dl FROM tf JOIN df ON df.w = tf.w JOIN dl ON dl.doc_id = tf.doc_id"),
    "bm25_search": (_bm25, _BM25_SQL),
    "bm25_topk": (_bm25_topk, _TOPK_SQL),
    "cosine_pairs": (_cosine, f"SELECT q.vec_id AS a, v.vec_id AS b, {_SIM} AS sim FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND {_SIM} >= 0.3"),
    "knn_topk": (_knn, _NEAR_SQL % ("q.vec_id % 20 = 0", 10)),
    "knn_ivf": (_knn_ivf, None),
    "hybrid_rrf": (scoped(_hybrid), _HYBRID_SQL),
    "knn_scoped": (scoped(_knn_scoped), _NEAR_SQL % ("v.label = q.label AND q.vec_id % 20 = 0", 10)),
    "knn_ivf_scoped": (scoped(_knn_ivf_scoped), None),
    "knn_pq": (scoped(_knn_pq), None),
    "hybrid_rrf_scoped": (scoped(_hybrid_scoped), _SCOPED_SQL),
    "phrase_search": (lambda s, d: phrases.phrase(positions_of(s, d), PHRASE), _phrase_sql(PHRASE)),
    "proximity_search": (lambda s, d: phrases.near(positions_of(s, d), CLOSE, WITHIN), _near_sql(CLOSE, WITHIN)),
    "interval_join": (_purchases, "SELECT p.event_id AS purchase_id, e.event_id AS event_id FROM (SELECT event_id, ts, ts - to_minutes(CAST(floor(greatest(value, 0)) AS BIGINT)) AS f FROM events WHERE event_type = 'purchase') p JOIN events e ON e.ts BETWEEN p.f AND p.ts"),
    "interval_join_keyed": (_open_items, "WITH s AS (SELECT o_custkey, l_orderkey, least(o_orderdate, l_shipdate) AS f, greatest(o_orderdate, l_shipdate) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey), x AS (SELECT * FROM s WHERE date_diff('day', f, t) <= 120) SELECT a.o_custkey AS o_custkey, count(*) AS n FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.l_orderkey < b.l_orderkey AND a.f <= b.t AND b.f <= a.t GROUP BY a.o_custkey"),
    "segment_sessions": (_on(transcripts.segment_sessions, "events"), "SELECT user_id, min(ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS gap FROM events) a) b GROUP BY user_id, s"),
    "segment_tumbling": (_on(transcripts.segment_tumbling, "events"), "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1"),
    "segment_sliding": (_on(transcripts.segment_sliding, "events"), "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(6 * unnest([0, 1, 2, 3]) AS BIGINT)) AS start FROM events) t GROUP BY start"),
    "finalized_segments": (_on(transcripts.finalized_segments, "events"), "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1"),
    "layout_buckets": (_laid_out, "SELECT o_orderkey, o_custkey, max(l_shipdate) AS l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey"),
    "source_turnlog": (_turnlog, "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id >= 3 AND conv_id < 60"),
    "turn_stitch": (_on(transcripts.turn_stitch, "conversations"), "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"),
    "turn_pairs": (_on(transcripts.turn_pairs, "conversations"), "SELECT conv_id, turn, prompt, reply FROM (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS r, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) t WHERE role = 'user' AND r = 'assistant'"),
    "asof_context": (_on(transcripts.asof_context, "events"), "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM events"),
    "entity_mentions": (_on(text.entity_mentions, "documents"), rf"SELECT surface, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{text.MENTION}')) AS surface FROM documents) t GROUP BY surface"),
    "dictionary_mentions": (_dictionary, _DICTIONARY_SQL),
    "entity_cooccurrence": (_on(text.entity_cooccurrence, "documents"), rf"WITH m AS (SELECT DISTINCT doc_id, surface FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{text.MENTION}')) AS surface FROM documents) t) SELECT x.surface AS a, y.surface AS b, count(*) AS n FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.surface < y.surface GROUP BY ALL"),
    "pii_flags": (_on(text.pii_flags, "documents"), rf"SELECT doc_id, n_emails FROM (SELECT doc_id, len(regexp_extract_all(text, '{text.EMAIL}')) AS n_emails FROM documents) t WHERE n_emails > 0"),
    "extractive_summary": (
        _summary,
        rf"""WITH t AS ({TOKENS}), tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
wt AS (SELECT doc_id, w, tf * CAST(floor(ln(1 + (SELECT count(*) FROM documents) / df) * 1000000) AS BIGINT) AS x FROM tf JOIN df USING (w)),
sw AS (SELECT doc_id, pos, unnest(list_distinct(regexp_extract_all(lower(sentence), '\p{{L}}+'))) AS w FROM ({_SENTENCES_SQL}) s WHERE trim(sentence) <> ''),
sc AS (SELECT doc_id, pos, CAST(sum(x) AS BIGINT) AS score FROM sw JOIN wt USING (doc_id, w) GROUP BY doc_id, pos)
SELECT doc_id, pos, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM sc) r WHERE rank <= 3""",
    ),
    "exact_duplicates": (_on(dedup.exact_duplicates, "documents"), "SELECT md5(text) AS h, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1"),
    "near_duplicates": (_on(dedup.near_duplicates, "documents"), f"WITH {_SHINGLES_SQL} SELECT x, y, j FROM pairs"),
    "near_duplicates_lsh": (_on(dedup.near_duplicates_lsh, "documents"), None),
    "duplicate_clusters": (
        _clusters,
        f"""WITH RECURSIVE {_SHINGLES_SQL}, copies AS (SELECT min(doc_id) AS x, text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1),
links AS (SELECT x, y FROM pairs UNION SELECT c.x, d.doc_id FROM copies c JOIN documents d ON d.text = c.text), e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
r AS (SELECT x AS doc_id, x AS o FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x) SELECT doc_id, min(o) AS cluster FROM r GROUP BY doc_id""",
    ),
    "duplicate_members": (_members, f"WITH RECURSIVE {_FOLDED_SQL}, e AS (SELECT x, y FROM near WHERE j >= 0.8 UNION SELECT y, x FROM near WHERE j >= 0.8), r AS (SELECT x AS doc_id, x AS o FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x), c AS (SELECT doc_id AS x, min(o) AS cluster FROM r GROUP BY doc_id), k AS (SELECT lower(text) AS t, min(doc_id) AS x, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY lower(text)) SELECT d.doc_id, coalesce(c.cluster, k.x) AS cluster FROM documents d JOIN k ON lower(d.text) = k.t LEFT JOIN c ON c.x = k.x WHERE k.n > 1 OR c.cluster IS NOT NULL"),
    "continuity_overlap": (_on(context.continuity_overlap, "documents", "benchmark"), "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "context_pack": (_on(context.context_pack, "documents", budget=CONTEXT), f"SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) t WHERE used <= {CONTEXT}"),
    "usage_cube": (_on(usage.usage_cube, "events"), "SELECT event_type, user_id, day, count(*) AS n, CAST(sum(x) AS DECIMAL(38,2)) AS cost, CAST(grouping(event_type, user_id, day) AS BIGINT) AS gid FROM (SELECT event_type, user_id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS x FROM events) t GROUP BY CUBE (event_type, user_id, day)"),
    "usage_estimates": (_usage_estimates, None),
    "usage_rolling": (_on(usage.usage_rolling, "events"), "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS DECIMAL(38,2)) AS s FROM events"),
    "usage_percentiles": (_on(usage.usage_percentiles, "events"), "SELECT event_type, quantile_cont(value, 0.9) AS p90, median(value) AS p50 FROM events GROUP BY event_type"),
    "usage_props": (_on(usage.usage_props, "events"), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "budget_breach": (_on(usage.budget_breach, "events", budget=BUDGET), f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM (SELECT *, sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) a WHERE run > {BUDGET}) b WHERE rn = 1"),
}
QUERIES["usage_incremental"] = (_kept_usage, QUERIES["usage_cube"][1])
QUERIES |= {
    "udf_scalar": (lambda s, d: table(s, d, "documents").select("doc_id", udfs.capital_share("text").alias("share")), "SELECT doc_id, length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(text) AS share FROM documents"),
    "udaf_partial": (lambda s, d: udfs.geometric_means(table(s, d, "events")).select("event_type", F.round("gmean", 6).alias("gmean")), "SELECT event_type, round(exp(sum(ln(value)) / count(*)), 6) AS gmean FROM events WHERE value > 0 GROUP BY event_type"),
    "udaf_grouped": (_spread, "SELECT user_id, CAST(ts AS DATE) AS day, max(value) - min(value) AS spread FROM events GROUP BY ALL"),
    "udtf_words": (_words_of, "SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark) t"),
    "agg_approx_distinct": (_approx, None),
}
for _name, _sql in relational.SQL.items():
    QUERIES[_name] = ((lambda s, d, q=_sql: relational.run_sql(s, d, q)), _sql)
for _name, (_spark, _duck) in relational.DIALECT.items():
    QUERIES[_name] = ((lambda s, d, q=_spark: relational.run_sql(s, d, q)), _duck)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
