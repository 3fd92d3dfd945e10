"""The registered queries of the ten operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.urls import LOWER, UPPER, URL
from scriptorium.llm import decontaminate, merkle, ngram_join, packing, pii, quality_classifier, quality_rules, repair, token_counts, token_files, toxicity, url_filter, warc
from scriptorium.llm.tokens import PIECES, TokenizerFile
from scriptorium.plans.registry import name_sql, resolved_sql
from scriptorium.plans.store import fresh_path, scoped
from scriptorium.sources.tables import table


def vocabulary(name: str = "byte_bpe_50k.json", pieces: int = PIECES) -> TokenizerFile:
    """A public tokenizer file by name, and the pieces a worker remembers of it."""
    import public_tokenizers

    return TokenizerFile.read(public_tokenizers.path(name), pieces)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(), folder, end_id=0)
    return token_files.read_token_files(manifest, folder)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality_rules.judge(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def _held_out(df: DataFrame, folds: int, fold: int) -> DataFrame:
    """A null doc_id is in no fold."""
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold
    return df.select("doc_id", F.coalesce(own, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, folds=4, held_out=2), 4, 2)


def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, folds=5, held_out=0), 5, 0)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"), min_bytes=1000)
    return warc.describe(*warc.store_archives(archives)).drop("verified")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"), threshold=0.8, size=5).select("doc_id", "class_id", "n_links")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13, share=20).drop("spans")


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(), fresh_path(spark, "token-cache"), max_tokens=1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = {"text": F.when(told, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}
    return merkle.verify(table(spark, sf_dir, "documents"), found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < pii.TOKEN)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_log(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: scoped(f) for f in (op1_token_files, op2_quality_rules, op3_toxicity_nnpu, op4_quality_ftrl, op5_warc_archive, op6_best_fit_packing, op7_ngram_jaccard_join, op8_decontamination, op9_url_filter, op10_token_counts, op11_merkle_manifest, op12_contextual_pii, op13_conversation_repair)}


_WS = r"[\x20\x09-\x0D]+"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gg WHERE c > 1) q GROUP BY r),
l AS (SELECT r, host, md5(t) AS content, unnest(list_transform(raw, lambda x: md5(trim(regexp_replace(translate(x, {_ABC}), '{_WS}', ' ', 'g'))))) AS h, unnest(list_transform(raw, lambda x: len(list_filter(regexp_split_to_array(x, '{_WS}'), lambda y: y <> '')))) AS n FROM s),
f AS (SELECT host, h FROM l GROUP BY host, h HAVING count(DISTINCT content) > 20),
gone AS (SELECT r, sum(n) AS n FROM l JOIN f USING (host, h) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words FROM s LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_removed_words > 0.5 * n_words) AS kept FROM m"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN n >= 1000 AND top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top IS DISTINCT FROM page_id THEN top END AS refers_to FROM q"""

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM iw),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n),
hit AS (SELECT r, p, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND win.s = array_to_string(w[p:p + dw.n - 1], ' ')),
cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) x GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS h FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


def _rule_sql(host: str, path: str, what: int) -> str:
    """The longest fitting rule's name (0) or action (1) as a CASE."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, a)[what]}'" for a, h, p in ordered)
    return f"CASE {cases} END"


#: The tags that declare a page's names, as patterns without a look behind.
_BEFORE = r"(?:[^>]*[^\w>-])?"
_CANONICAL = rf"""(?is)<link\s{_BEFORE}rel\s*=\s*(?:(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?')[^>]*|canonical(?:[\s/][^>]*)?)>"""
_REFRESH = rf"""(?is)<meta\s{_BEFORE}http-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)[^\w-]href\s*=\s*["']?\s*([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def _op9_sql() -> str:
    quoted = lambda r: r.replace("'", "''")
    part = lambda url, i: f"regexp_extract({url}, '{URL}', {i})"
    every = lambda tag, attribute: f"list_transform(regexp_extract_all(html, '{quoted(tag)}'), lambda x: replace(regexp_extract(x, '{quoted(attribute)}', 1), '&amp;', '&'))"
    return f"""
WITH RECURSIVE tag AS (SELECT url, unnest(list_concat({every(_CANONICAL, _HREF)}, {every(_REFRESH, _TARGET)})) AS t FROM pages WHERE html IS NOT NULL AND url IS NOT NULL),
target AS (SELECT url, {resolved_sql('t', 'url')} AS u FROM tag WHERE t <> ''),
named AS (SELECT {name_sql('url')} AS a, {name_sql('u')} AS b FROM target),
both_ways AS (SELECT a, b FROM named WHERE a <> b UNION SELECT b, a FROM named WHERE a <> b),
r AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM r JOIN both_ways x ON r.other = x.a),
n AS (SELECT node, other, {_rule_sql('h', 'p', 1)} AS act FROM (SELECT node, other, translate({part('other', 2)}, {_ABC}) AS h, {part('other', 3)} AS p FROM r) y),
c AS (SELECT node FROM n GROUP BY node HAVING coalesce(bool_or(act = 'block'), false) AND NOT coalesce(bool_or(act = 'allow'), false)),
j AS (SELECT page_id, url, coalesce(translate({part('url', 2)}, {_ABC}), '') AS host, coalesce({part('url', 3)}, '') AS path FROM pages),
k AS (SELECT page_id, host, path, {_rule_sql('host', 'path', 0)} AS rule, {_rule_sql('host', 'path', 1)} AS act, {name_sql('url')} AS node FROM j)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN c.node IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM k LEFT JOIN c ON c.node = k.node"""


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: a bit at a time, over list_reduce."""
    bits = "list_reduce(CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda t, y: xor(t >> 1, 3988292384 * (t & 1)), xor(c, x))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs {name}_r1.. of runs (grp, i, s, c) over {name}_n0 (grp, i, h, c): ``c`` nodes are in
    the level below, and a single one goes up as it is."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"{name}_r{k} AS MATERIALIZED (SELECT grp, i // 16 AS i, string_agg(h, '' ORDER BY i) AS s, any_value(c) AS c FROM {name}_n{k - 1} GROUP BY grp, i // 16)")
        out.append(f"{name}_n{k} AS (SELECT grp, i, CASE WHEN c > 1 THEN sha256(s) ELSE s END AS h, count(*) OVER (PARTITION BY grp) AS c FROM {name}_r{k})")
    return ",\n".join(out)


def _op11_sql(levels: int = 6, top: int = 4) -> str:
    """Groups of up to 16 ** levels rows, and up to 16 ** top groups."""
    enc = lambda v: f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')"
    rest = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    told = f"CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, {_ABC}) ELSE text END"
    steps = [(f"g_r{k}", f"l.i // {16 ** (k - 1)} % 16", f"g_r{k}.grp = l.grp AND g_r{k}.i = l.i // {16**k}") for k in range(1, levels + 1)]
    steps += [(f"t_r{k}", f"t.i // {16 ** (k - 1)} % 16", f"t_r{k}.i = t.i // {16**k}") for k in range(1, top + 1)]
    sides = ", ".join(f"substr({r}.s, 1, 64 * ({at})) AS a{n}, substr({r}.s, 64 * ({at}) + 65) AS b{n}, {r}.c AS c{n}" for n, (r, at, _) in enumerate(steps, 1))
    folds = ",\n".join(f"f{n} AS (SELECT * REPLACE (CASE WHEN c{n} > 1 THEN sha256(a{n} || f || b{n}) ELSE f END AS f) FROM f{n - 1})" for n in range(1, len(steps) + 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '-') AS grp, sha256({rest} || {enc('text')}) AS leaf, sha256({rest} || {enc(told)}) AS found FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d),
g_n0 AS (SELECT grp, i, leaf AS h, count(*) OVER (PARTITION BY grp) AS c FROM l),
{_tree_sql('g', levels)},
t AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS i FROM g_n{levels}),
t_n0 AS (SELECT '' AS grp, i, h, count(*) OVER () AS c FROM t),
{_tree_sql('t', top)},
f0 AS (SELECT l.doc_id, l.leaf, l.found AS f, t.h AS subroot, {sides} FROM l JOIN t ON t.grp = l.grp {" ".join(f"JOIN {r} ON {on}" for r, _, on in steps)}),
{folds}
SELECT doc_id, leaf, subroot, root.h AS root, sha256({" || ".join(f"a{n} || b{n}" for n in range(1, len(steps) + 1))}) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM f{len(steps)}, t_n{top} root"""


def _op12_sql() -> str:
    """The base patterns as the contract has them; tokens as runs that are filtered afterwards."""
    sources = {pii.EMAIL: ("t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), pii.IP: ("t", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), pii.CARD: ("t", r"[0-9](?:[\x20-]?[0-9])+"), pii.PHONE: ("t", r"\+[0-9][\x20().0-9-]+[0-9]"), pii.TOKEN: ("j", f"[{pii.TOKENS}]+")}
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all({s}, '{p}') AS hits, string_split_regex({s}, '{p}') AS gaps FROM m" for k, (s, p) in sources.items())
    pair = rf"'([0-9])[\x20-]([0-9])', '\1{pii.JOINT}\2', 'g'"
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = "list_sum(list_transform(range(length(dg)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(dg[length(dg) - i] AS INTEGER) WHEN CAST(dg[length(dg) - i] AS INTEGER) > 4 THEN 2 * CAST(dg[length(dg) - i] AS INTEGER) - 9 ELSE 2 * CAST(dg[length(dg) - i] AS INTEGER) END)) % 10 = 0"
    words = lambda c: f"regexp_extract_all(translate({c}, {_ABC}), '{pii.WORD}')"
    letter = lambda c: f"regexp_matches({c}, '\\p{{L}}')"
    last = lambda k: f"array_to_string(b[len(b) - {k - 1}:], ' ')"
    rounds, worth = [], "NULL"
    for n in range(pii.ROUNDS):
        if n:
            rounds.append(f"t{n} AS (SELECT value, sum(coalesce(worth, 0)) // (2 * count(*)) AS own FROM live LEFT JOIN w{n - 1} USING (context) WHERE NOT seed GROUP BY value)")
        own = f"(SELECT live.*, own FROM live LEFT JOIN t{n} USING (value))" if n else "(SELECT *, NULL AS own FROM live)"
        rounds.append(f"w{n} AS (SELECT context, total // (n + 1) AS worth FROM (SELECT context, n, sum(CASE WHEN seed THEN {pii.ONE} ELSE coalesce(own, 0) END) AS total FROM {own} h GROUP BY context, n) x WHERE total >= {pii.SUPPORT * pii.ONE})")
        worth = f"w{n}"
    names = "[" + ", ".join(f"'{k}'" for k in pii.KINDS) + "]"
    listed = lambda only: f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE {only}), '')"
    return f"""
WITH m AS MATERIALIZED (SELECT r, doc_id, t, regexp_replace(regexp_replace(translate(t, '{pii.JOINT}', '{pii.OTHER}'), {pair}), {pair}) AS j FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents) d),
x AS ({found}),
u AS (SELECT r, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(gaps[2:]) AS nxt, generate_subscripts(hits, 1) AS k FROM x WHERE len(hits) > 0),
p AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY k) AS BIGINT) AS e, {digits} AS dg, translate(hit, '{pii.JOINT}', ' ') AS plain FROM u),
q AS (SELECT *, ltrim(plain, '{pii.MARKS}') AS bare, rtrim(ltrim(plain, '{pii.MARKS}'), '{pii.MARKS}') AS inside FROM p),
g AS (SELECT r, kind, CASE WHEN kind = 4 THEN e - length(bare) ELSE e - length(hit) END AS s, CASE WHEN kind = 4 THEN e - (length(bare) - length(inside)) ELSE e END AS e, translate(CASE WHEN kind = 4 THEN inside ELSE plain END, {_ABC}) AS value,
  CASE WHEN kind = 4 THEN right(gap, {pii.BEFORE}) || left(hit, length(hit) - length(bare)) ELSE right(gap, {pii.BEFORE}) END AS lft, CASE WHEN kind = 4 THEN right(hit, length(bare) - length(inside)) || left(nxt, {pii.AFTER}) ELSE left(nxt, {pii.AFTER}) END AS rgt
  FROM q WHERE CASE kind WHEN 1 THEN regexp_full_match(hit, '{pii.PART}(?:\\.{pii.PART}){{3}}') WHEN 2 THEN length(dg) BETWEEN 14 AND 19 AND {luhn} WHEN 3 THEN length(dg) BETWEEN 10 AND 15
    WHEN 4 THEN length(hit) >= 5 AND length(inside) >= 4 AND (contains(hit, '@') OR length(dg) >= 2) ELSE true END),
f AS (SELECT *, coalesce(max(e) FILTER (WHERE kind < 4) OVER (PARTITION BY r ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached,
  min(s) FILTER (WHERE kind < 4) OVER (PARTITION BY r ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM g),
h AS MATERIALIZED (SELECT r, kind, s, e, value, {words('lft')} AS b, {words('rgt')} AS a FROM f WHERE kind < 4 OR (reached <= s AND (ahead IS NULL OR ahead >= e))),
c AS MATERIALIZED (SELECT r, kind, s, e, value, unnest(list_filter([CASE WHEN len(b) >= 2 AND {letter(last(2))} THEN {last(2)} || ' _' END, CASE WHEN len(b) >= 3 AND {letter(last(3))} THEN {last(3)} || ' _' END, CASE WHEN len(b) >= 1 AND len(a) >= 1 AND {letter('b[len(b)]')} THEN b[len(b)] || ' _ ' || a[1] END], lambda y: y IS NOT NULL)) AS context FROM h),
edge AS (SELECT context, value, bool_or(kind < 4) AS seed FROM c GROUP BY context, value),
live AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY context) AS n FROM edge) y WHERE n >= {pii.SUPPORT}),
{", ".join(rounds)},
fresh AS (SELECT DISTINCT r, kind, s, e FROM c WHERE kind = 4 AND context IN (SELECT context FROM {worth} WHERE worth >= {pii.ENOUGH})),
every AS (SELECT r, kind, s, e FROM h WHERE kind < 4 UNION ALL SELECT * FROM fresh),
told AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, name in enumerate(pii.KINDS[:4]))}, {listed('kind < 4')} AS base, {listed('true')} AS spans FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in pii.KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM m LEFT JOIN told USING (r)"""


def _op13_sql() -> str:
    """The cheapest way to each of four states (nothing, s, u, a written last) as nine digits of
    cost and the edits, ``~`` where there is none, turn by turn in list_reduce."""
    add = lambda e, w, x: f"CASE WHEN {e} = '~' THEN '~' ELSE lpad(CAST(CAST({e}[1:9] AS BIGINT) + {w} AS VARCHAR), 9, '0') || {e}[10:] || '{x}' END"
    own = "CASE WHEN x.fault = 't' THEN 5 ELSE 0 END"
    stay = lambda e, initial: f"CASE WHEN x.fault IN ('b', 'd') THEN '~' ELSE least({add(e, f'{own} + 1', 'R')}, CASE WHEN x.initial = '{initial}' THEN {add(e, own, 'K')} ELSE '~' END) END"
    only_s = f"CASE WHEN x.fault IN ('b', 'd') OR x.initial <> 's' THEN '~' ELSE {add('e[1]', own, 'K')} END"
    inserted = f"[e[1], e[2], least(e[3], {', '.join(add(f'e[{q}]', 5, 'I') for q in (1, 2, 4))}), least(e[4], {add('e[3]', 5, 'I')}, {', '.join(add(f'e[{q}]', 10, 'II') for q in (1, 2))})]"
    move = lambda c: c.replace("e[", "c[")
    step = f"[{add('c[1]', 2, 'D')}, least({add('c[2]', 2, 'D')}, {move(only_s)}), least({add('c[3]', 2, 'D')}, {', '.join(stay(f'c[{q}]', 'u') for q in (1, 2, 4))}), least({add('c[4]', 2, 'D')}, {stay('c[3]', 'a')})]"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    key = "coalesce(CAST(conv_id AS VARCHAR), '-')"
    return f"""
WITH d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
x AS (SELECT {key} AS ck, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE k <> 0),
o AS (SELECT ck, turn, role, text, role[1:1] AS initial, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM x),
j AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 THEN 'd' WHEN right(rtrim(text, {spaces}), 1) IN ('.', '!', '?') THEN 'o' ELSE 't' END AS fault,
  lag(initial) OVER (PARTITION BY ck ORDER BY i) || initial AS pair FROM o),
g AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'initial': initial, 'fault': fault}} ORDER BY i) AS held FROM j GROUP BY ck),
w AS (SELECT * EXCLUDE held, list_reduce(held, lambda e, x: list_transform([{inserted}], lambda c: {step})[1], ['000000000', '~', '~', '~']) AS e FROM g),
b AS (SELECT * EXCLUDE e, list_transform([{inserted}], lambda c: least(c[1], c[4]))[1] AS best FROM w),
l AS (SELECT ck, unnest(range(1, len(best) - 8)) AS k, substr(best, CAST(9 + k AS BIGINT), 1) AS letter FROM b),
n AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY ck ORDER BY k) AS i, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY ck ORDER BY k) AS place FROM l),
p AS (SELECT n.ck, n.k, n.letter, n.place, CASE WHEN letter <> 'I' THEN j.role END AS role, CASE WHEN letter <> 'I' THEN j.text ELSE '' END AS text, max(CASE WHEN letter = 'K' AND n.place = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.ck) AS s FROM n LEFT JOIN j ON j.ck = n.ck AND j.i = n.i),
r AS (SELECT ck, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h FROM p WHERE letter <> 'D' GROUP BY ck)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost, coalesce(best[10:], '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, {key} AS ck FROM conversations) a LEFT JOIN b USING (ck) LEFT JOIN r USING (ck)"""


def oracle_sql() -> dict[str, str]:
    """Tokenizers, trained classifiers and similarity classes at scale are no SQL; tests
    hold those queries against brute force."""
    return {"op2_quality_rules": OP2_SQL, "op5_warc_archive": OP5_SQL, "op8_decontamination": OP8_SQL, "op9_url_filter": _op9_sql(), "op11_merkle_manifest": _op11_sql(), "op12_contextual_pii": _op12_sql(), "op13_conversation_repair": _op13_sql()}
