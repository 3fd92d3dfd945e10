"""Generic relational coverage: a query for each category of operator, in SQL that both
engines read alike (``dialect`` holds the few spellings that differ)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scriptorium.sources.tables import SCHEMAS, table

SQL = {
    "scan_project_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "join_inner": "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_right": "SELECT d.doc_id, l.toxic FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id",
    "join_full": "SELECT d.doc_id, p.page_id FROM documents d FULL OUTER JOIN pages p ON d.doc_id = p.page_id * 2 + 1",
    "join_semi": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_in": "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)",
    "join_cross_small": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_range": "SELECT r.r_name, CAST(count(*) AS BIGINT) AS n FROM region r JOIN nation n ON n.n_nationkey >= r.r_regionkey * 5 AND n.n_nationkey < r.r_regionkey * 5 + 7 GROUP BY r.r_name",
    "join_lateral": "SELECT n_name, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t",
    "agg_group": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_grouping_sets": "SELECT lang, source, count(*) AS n, CAST(grouping(lang) AS BIGINT) AS gl, CAST(grouping(source) AS BIGINT) AS gs FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS n_high FROM events GROUP BY event_type",
    "window_ranking": "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)",
    "window_analytic": "SELECT event_id, lag(event_id, 1) OVER w AS before_id, lead(event_id, 2) OVER w AS later_id, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_frames": "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
    "set_union": "SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey AS k FROM part",
    "set_union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey AS k FROM customer",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "subquery_scalar": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "subquery_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "func_string": "SELECT p_partkey, upper(p_name) AS u, replace(p_brand, '#', '-') AS b, substring(p_type, 1, 3) AS t, CAST(length(p_name) AS BIGINT) AS n, concat(p_brand, '/', p_type) AS c FROM part",
    "func_math": "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, sqrt(abs(s_acctbal)) AS r, sign(s_acctbal) AS g FROM supplier",
    "func_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(o_orderdate AS DATE) AS d FROM orders",
    "func_date_parts": "SELECT o_orderkey, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due FROM orders",
    "func_null": "SELECT d.doc_id, coalesce(l.quality, -1) AS q, nullif(l.toxic, 0) AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
}

#: name -> (Spark SQL, DuckDB SQL) where the spelling differs.
DIALECT = {
    "pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, 1 AS x FROM lineitem) PIVOT (count(x) FOR l_linestatus IN ('O' AS open_n, 'F' AS done_n))",
        "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_n, count(*) FILTER (WHERE l_linestatus = 'F') AS done_n FROM lineitem GROUP BY l_returnflag",
    ),
    "unpivot": (
        "SELECT doc_id, kind, flag FROM labels UNPIVOT (flag FOR kind IN (quality, toxic))",
        "SELECT doc_id, 'quality' AS kind, quality AS flag FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels",
    ),
    "func_array": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS first_x, array_max(embedding) AS top FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first_x, list_max(embedding) AS top FROM embeddings",
    ),
    "func_map": (
        "SELECT conv_id, map_from_arrays(collect_list(role), collect_list(n))['user'] AS n_user FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) t GROUP BY conv_id",
        "SELECT conv_id, max(n) FILTER (WHERE role = 'user') AS n_user FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) t GROUP BY conv_id",
    ),
    "func_json": (
        "SELECT event_id, CAST(variant_get(parse_json(props), '$.k', 'bigint') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "recursive_series": (
        "WITH RECURSIVE t(i, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, total + i + 1 FROM t WHERE i < 20) SELECT CAST(i AS BIGINT) AS i, total FROM t",
        "WITH RECURSIVE t(i, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, CAST(total + i + 1 AS BIGINT) FROM t WHERE i < 20) SELECT CAST(i AS BIGINT) AS i, total FROM t",
    ),
}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over one folder's tables, without leaving views in the session: each table is
    passed as an argument."""
    names = [n for n in SCHEMAS if re.search(rf"\b{n}\b", sql)]
    for n in names:
        sql = re.sub(rf"(?<![\w.{{'])\b{n}\b(?![\w('])", "{" + n + "}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})
