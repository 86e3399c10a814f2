"""Statements of the SQL surface over whole tables, with what they mean in standard SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.plans.sqlsurface import query_frame
from stratalith.session import table

#: name: (table, statement in the surface's dialect, the same in DuckDB's)
STATEMENTS = {
    "sql_project_filter": (
        "orders",
        "SELECT o_orderkey, [o_totalprice] * 2 AS twice FROM orders WHERE o_orderpriority LIKE '1-urg%' AND o_totalprice > 100000.0",
        "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderpriority ILIKE '1-urg%' AND o_totalprice > 100000",
    ),
    "sql_group_having": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, total(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10",
    ),
    "sql_distinct": ("customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "sql_window_rank": (
        "orders",
        "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, "
        "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before FROM orders) WHERE k <= 3",
        "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS k, "
        "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before FROM orders) WHERE k <= 3",
    ),
    "sql_window_frame": (
        "events",
        "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three FROM events",
        "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three FROM events",
    ),
    "sql_window_values": (
        "orders",
        "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS quarter, first_value(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS head, "
        "dense_rank() OVER (ORDER BY o_orderpriority) AS priority FROM orders",
        "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS quarter, first_value(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS head, "
        "CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS priority FROM orders",
    ),
    "sql_union": (
        "part",
        "SELECT p_brand AS v FROM part WHERE p_size < 10 UNION SELECT p_type FROM part WHERE p_size >= 40",
        "SELECT p_brand AS v FROM part WHERE p_size < 10 UNION SELECT p_type FROM part WHERE p_size >= 40",
    ),
    "sql_intersect": (
        "part",
        "SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 45",
        "SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 45",
    ),
    "sql_except": (
        "part",
        "SELECT p_partkey FROM part EXCEPT SELECT p_partkey FROM part WHERE p_size % 2 = 0",
        "SELECT p_partkey FROM part EXCEPT SELECT p_partkey FROM part WHERE p_size % 2 = 0",
    ),
    "sql_recursive_cte": (
        "nation",
        "WITH RECURSIVE n(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM n WHERE i < 24) SELECT i, n_name FROM n JOIN nation ON n_nationkey = i",
        "WITH RECURSIVE n(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM n WHERE i < 24) SELECT i, n_name FROM n JOIN nation ON n_nationkey = i",
    ),
    "sql_self_join": (
        "supplier",
        "SELECT a.s_suppkey AS a, count(b.s_suppkey) AS richer FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey",
        "SELECT a.s_suppkey AS a, count(b.s_suppkey) AS richer FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey",
    ),
    "sql_semi": (
        "orders",
        "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')",
        "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')",
    ),
    "sql_anti": (
        "orders",
        "SELECT DISTINCT o_custkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')",
        "SELECT DISTINCT o_custkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')",
    ),
    "sql_json": (
        "events",
        "SELECT event_id, json_extract(props, '$.k') AS k, json_valid(props) AS ok, json_object('e', event_type) AS o FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_valid(props) AS INTEGER) AS ok, '{\"e\":\"' || event_type || '\"}' AS o FROM events",
    ),
    "sql_dates": (
        "orders",
        "SELECT o_orderkey, date(o_orderdate, '+1 month') AS m, strftime('%Y-%j', o_orderdate) AS yj, julianday(o_orderdate) AS jd, unixepoch(o_orderdate, 'start of month') AS s FROM orders",
        "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS m, strftime(o_orderdate, '%Y-%j') AS yj, "
        "epoch_us(o_orderdate) / 86400000000.0 + 2440587.5 AS jd, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS s FROM orders",
    ),
    "sql_string": (
        "part",
        "SELECT p_partkey, substr(p_name, -3, 2) AS tail, upper(p_brand) || '-' || p_size AS tag, instr(p_type, ' ') AS gap, concat(p_brand, NULL, p_type) AS both, trim(p_name, 'aeiou') AS t, "
        "printf('%05d|%s', p_size, p_brand) AS f, hex(p_brand) AS h, quote(p_name) AS q, replace(p_type, ' ', '_') AS r, unicode(p_name) AS u, length(p_name) AS n FROM part",
        "SELECT p_partkey, p_name[-3:-2] AS tail, upper(p_brand) || '-' || p_size AS tag, instr(p_type, ' ') AS gap, p_brand || p_type AS both, trim(p_name, 'aeiou') AS t, "
        "format('{:05d}|{}', p_size, p_brand) AS f, hex(encode(p_brand)) AS h, '''' || p_name || '''' AS q, replace(p_type, ' ', '_') AS r, unicode(p_name) AS u, length(p_name) AS n FROM part",
    ),
    "sql_math": (
        "part",
        "SELECT p_partkey, p_size / 7 AS whole, p_size / 0 AS none, p_size % 7 AS m, log(p_size) AS lg, round(p_retailprice, 1) AS r, max(p_size, 25) AS hi, trunc(p_retailprice / 3) AS t, pow(p_size, 2) AS sq, "
        "abs(-p_size) AS a, sign(p_size - 20) AS sg, iif(p_size > 20, 'big', 'small') AS c, typeof(p_size) AS ty FROM part",
        "SELECT p_partkey, p_size // 7 AS whole, CAST(NULL AS BIGINT) AS none, p_size % 7 AS m, log10(p_size) AS lg, round(CAST(p_retailprice AS DECIMAL(38, 12)), 1)::DOUBLE AS r, greatest(p_size, 25) AS hi, trunc(p_retailprice / 3) AS t, "
        "pow(p_size, 2) AS sq, abs(-p_size) AS a, sign(p_size - 20) AS sg, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS c, 'integer' AS ty FROM part",
    ),
    "sql_group_concat": (
        "nation",
        "SELECT n_regionkey, group_concat(n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_name) AS n FROM nation GROUP BY n_regionkey",
    ),
    "sql_aggregate_filter": (
        "lineitem",
        "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, min(l_shipdate) AS first FROM lineitem WHERE l_shipmode GLOB '*' OR 1 = 1 GROUP BY l_returnflag".replace("l_shipmode", "l_linestatus"),
        "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS first FROM lineitem GROUP BY l_returnflag",
    ),
    "sql_glob": (
        "part",
        "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*' AND p_name IS NOT 'x'",
        "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]*'",
    ),
    "sql_window_more": (
        "orders",
        "SELECT o_orderkey, rank() OVER w AS r, percent_rank() OVER w AS p, cume_dist() OVER w AS c, lead(o_orderkey, 2) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS after, "
        "last_value(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, "
        "nth_value(o_orderkey, 3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS third FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
        "SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, percent_rank() OVER w AS p, cume_dist() OVER w AS c, lead(o_orderkey, 2) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS after, "
        "last_value(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, "
        "nth_value(o_orderkey, 3) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS third FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)",
    ),
    "sql_trigonometry": (
        "part",
        "SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 9) AS c, round(asin(p_size / 100.0), 9) AS d, round(acos(p_size / 100.0), 9) AS e, "
        "round(atan(p_size), 9) AS f, round(atan2(p_size, 7), 9) AS g, round(degrees(p_size), 9) AS h, round(radians(p_size), 9) AS i, round(pi(), 9) AS j, acos(p_size + 2) AS none FROM part",
        "SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 9) AS c, round(asin(p_size / 100.0), 9) AS d, round(acos(p_size / 100.0), 9) AS e, "
        "round(atan(p_size), 9) AS f, round(atan2(p_size, 7), 9) AS g, round(degrees(p_size), 9) AS h, round(radians(p_size), 9) AS i, round(pi(), 9) AS j, CAST(NULL AS DOUBLE) AS none FROM part",
    ),
    "sql_numbers": (
        "part",
        "SELECT p_partkey, round(sqrt(p_retailprice), 9) AS a, round(exp(p_size / 10.0), 9) AS b, round(ln(p_size), 9) AS c, round(log2(p_size), 9) AS d, round(log10(p_size), 9) AS e, ceil(p_retailprice) AS f, "
        "ceiling(p_retailprice / 7) AS g, floor(p_retailprice) AS h, mod(p_retailprice, 7) AS i, power(p_size, 0.5) AS j, round(log(2, p_size), 9) AS k, sqrt(-p_size) AS none, min(p_size, 25, 30) AS lo, -7 / 2 AS whole FROM part",
        "SELECT p_partkey, round(sqrt(p_retailprice), 9) AS a, round(exp(p_size / 10.0), 9) AS b, round(ln(p_size), 9) AS c, round(log2(p_size), 9) AS d, round(log10(p_size), 9) AS e, ceil(p_retailprice) AS f, "
        "ceil(p_retailprice / 7) AS g, floor(p_retailprice) AS h, p_retailprice % 7 AS i, pow(p_size, 0.5) AS j, round(ln(p_size) / ln(2), 9) AS k, CAST(NULL AS DOUBLE) AS none, least(p_size, 25, 30) AS lo, CAST(-3 AS BIGINT) AS whole FROM part",
    ),
    "sql_null_handling": (
        "part",
        "SELECT p_partkey, coalesce(nullif(p_size, 7), nullif(p_size, 8), -1) AS a, ifnull(nullif(p_brand, 'Brand#2'), 'two') AS b, nvl(NULL, p_type) AS c, likely(p_size > 20) AS d, unlikely(p_size) AS e, "
        "cast(p_retailprice AS integer) AS f, cast(p_size AS text) AS g, cast('12abc' AS integer) AS h, cast(p_size AS real) AS i, p_size IN (1, 2, 3) AS j, like('brand#1%', p_brand) AS k, p_size BETWEEN 5 AND 9 AS l, p_brand NOT LIKE ('%#2') AS q, glob('*#1?', p_brand) AS r, "
        "p_name IS NULL AS m, typeof(p_retailprice) AS n, typeof(NULL) AS o FROM part WHERE p_name NOTNULL",
        "SELECT p_partkey, coalesce(nullif(p_size, 7), nullif(p_size, 8), -1) AS a, ifnull(nullif(p_brand, 'Brand#2'), 'two') AS b, p_type AS c, p_size > 20 AS d, p_size AS e, "
        "CAST(trunc(p_retailprice) AS BIGINT) AS f, CAST(p_size AS VARCHAR) AS g, CAST(12 AS BIGINT) AS h, CAST(p_size AS DOUBLE) AS i, p_size IN (1, 2, 3) AS j, p_brand ILIKE 'brand#1%' AS k, p_size BETWEEN 5 AND 9 AS l, p_brand NOT ILIKE '%#2' AS q, p_brand GLOB '*#1?' AS r, "
        "p_name IS NULL AS m, 'real' AS n, 'null' AS o FROM part WHERE p_name IS NOT NULL",
    ),
    "sql_text_more": (
        "part",
        "SELECT p_partkey, lower(p_brand) AS a, substring(p_name, 2, 3) AS b, ltrim('  ' || p_name) AS c, rtrim(p_name || '  ') AS d, ltrim(p_name, 'rs') AS e, rtrim(p_name, 'gt') AS f, format('%d-%s', p_size, p_type) AS g, "
        "concat_ws('/', p_brand, NULL, p_type) AS h, char(65, 97 + p_size % 26) AS i, upper('straße') AS j, hex('é') AS k, length('日本') AS l, unicode('é') AS m, instr(p_name, 'zzz') AS n, substr(p_name, 3) AS o, quote(p_size) AS p FROM part",
        "SELECT p_partkey, lower(p_brand) AS a, substring(p_name, 2, 3) AS b, ltrim('  ' || p_name) AS c, rtrim(p_name || '  ') AS d, ltrim(p_name, 'rs') AS e, rtrim(p_name, 'gt') AS f, format('{}-{}', p_size, p_type) AS g, "
        "concat_ws('/', p_brand, NULL, p_type) AS h, 'A' || chr(97 + p_size % 26) AS i, 'STRAßE' AS j, 'C3A9' AS k, 2 AS l, 233 AS m, 0 AS n, p_name[3:] AS o, CAST(p_size AS VARCHAR) AS p FROM part",
    ),
    "sql_times": (
        "orders",
        "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate, '+90 minutes') AS t, datetime(o_orderdate, '-1 day', '+3 hours') AS dt, date(o_orderdate, 'start of year', '+5 months') AS y, "
        "strftime('%d.%m.%Y %H:%M:%S', o_orderdate) AS f, datetime(o_orderdate, '+1 year', '-30 seconds') AS n FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 90 MINUTE, '%H:%M:%S') AS t, strftime(o_orderdate - INTERVAL 1 DAY + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS dt, "
        "strftime(date_trunc('year', o_orderdate) + INTERVAL 5 MONTH, '%Y-%m-%d') AS y, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') AS f, "
        "strftime(date_trunc('month', o_orderdate) + INTERVAL 1 YEAR + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) + (o_orderdate - date_trunc('day', o_orderdate)) - INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS n FROM orders",
    ),
    "sql_json_more": (
        "events",
        "SELECT event_id, json(props) AS a, json_array(event_id, event_type) AS b, json_array_length('[1, 2, ' || event_id || ']') AS c, json_type(props) AS d, json_quote(event_type) AS e, json_type('[1]') AS f, json_valid('{') AS g FROM events",
        "SELECT event_id, replace(props, ' ', '') AS a, '[' || event_id || ',\"' || event_type || '\"]' AS b, 3 AS c, 'object' AS d, '\"' || event_type || '\"' AS e, 'array' AS f, 0 AS g FROM events",
    ),
    "sql_aggregates": (
        "lineitem",
        "SELECT l_linestatus, sum(l_linenumber) AS a, min(l_quantity) AS b, max(l_shipdate) AS c, count(l_tax) AS d, count(DISTINCT l_returnflag) AS e, avg(l_linenumber) AS f, total(l_linenumber) AS g, "
        "sum(DISTINCT l_linenumber) AS h, string_agg(DISTINCT l_returnflag, '+') AS i FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS a, min(l_quantity) AS b, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS c, count(l_tax) AS d, count(DISTINCT l_returnflag) AS e, avg(l_linenumber) AS f, "
        "CAST(sum(l_linenumber) AS DOUBLE) AS g, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS h, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS i FROM lineitem GROUP BY l_linestatus",
    ),
    "sql_cross_join": (
        "region",
        "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey",
        "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey",
    ),
    "sql_natural_join": (
        "nation",
        "WITH named AS (SELECT n_nationkey, upper(n_name) AS large FROM nation) SELECT n_nationkey, n_name, large FROM nation NATURAL JOIN named",
        "SELECT n_nationkey, n_name, upper(n_name) AS large FROM nation",
    ),
    "sql_using_join": (
        "nation",
        "WITH counted AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT n_name, n FROM nation JOIN counted USING (n_regionkey)",
        "SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation",
    ),
    "sql_full_join": (
        "customer",
        "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a FULL OUTER JOIN customer b ON a.c_custkey = b.c_custkey + 10 AND b.c_acctbal > 0",
        "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a FULL OUTER JOIN customer b ON a.c_custkey = b.c_custkey + 10 AND b.c_acctbal > 0",
    ),
    "sql_case_exists": (
        "supplier",
        "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'some' ELSE 'much' END AS c, CASE s_nationkey WHEN 1 THEN 'one' END AS n, (SELECT max(x.s_acctbal) FROM supplier x) - s_acctbal AS gap FROM supplier",
        "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'some' ELSE 'much' END AS c, CASE s_nationkey WHEN 1 THEN 'one' END AS n, (SELECT max(x.s_acctbal) FROM supplier x) - s_acctbal AS gap FROM supplier",
    ),
    "sql_values": ("region", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(col1, col2)"),
    "sql_limit_offset": (
        "orders",
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 20",
        "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    ),
}


def surface(df):
    """A relational table as the surface sees it: times are ISO text."""
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name) if f.dataType.simpleString().startswith("timestamp") else F.col(f.name) for f in df.schema.fields])


def _query(name, statement):
    def run(spark, d):
        return query_frame(surface(table(spark, d, name)), name, statement)

    return run


def sql_truncation(spark, d):
    """A bounded read: the rows past the limit show only as one more row."""
    got = query_frame(surface(table(spark, d, "customer")), "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey", limit=100)
    return got.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) > 100).alias("truncated"))


QUERIES = {k: _query(t, s) for k, (t, s, _) in STATEMENTS.items()} | {"sql_truncation": sql_truncation}
SQL = {k: o for k, (_, _, o) in STATEMENTS.items()} | {"sql_truncation": "SELECT least(count(*), 101) AS rows, count(*) > 100 AS truncated FROM customer"}
