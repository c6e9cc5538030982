"""Plain SQL above tiered tables: joins, aggregates, windows, sets, subqueries, functions, and 22 analytical queries.

``orders_t``, ``events_t`` and ``lineitem_t`` are tiered; the other tables are plain. Most texts run as they are on Spark and on
DuckDB; where the dialects differ, both are given.
"""

from __future__ import annotations

M = "CAST({} AS DECIMAL(18,2))"
REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"


def money(column: str) -> str:
    """An exact sum, whatever the order of rows."""
    return f"CAST(sum({M.format(column)}) AS DOUBLE)"


def mean(column: str) -> str:
    return f"CAST(sum({M.format(column)}) AS DOUBLE) / count({column})"


REVENUE = f"CAST(sum({REV}) AS DOUBLE)"


def tiered_sql(body: str, **views: str) -> str:
    """``body`` with the tiered tables as common table expressions."""
    heads = ", ".join(f"{name} AS ({sql})" for name, sql in views.items() if name in body)
    if not heads:
        return body
    body = body.strip()
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"


def same(body: str) -> tuple[str, str]:
    return body, body


SURFACE: dict[str, tuple[str, str]] = {
    # joins
    "join_inner": same("SELECT o_orderkey, o_totalprice, c_name FROM orders_t JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"),
    "join_left": same("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders_t ON o_custkey = c_custkey AND o_orderstatus = 'U'"),
    "join_right": same("SELECT c_custkey, o_orderkey FROM orders_t RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "join_full": same("SELECT o.o_orderkey, e.event_id FROM orders_t o FULL JOIN events_t e ON o.o_orderkey = e.event_id + 1000"),
    "join_cross": same("SELECT o_orderkey, event_id FROM (SELECT o_orderkey FROM orders_t ORDER BY o_orderkey LIMIT 2) CROSS JOIN (SELECT event_id FROM events_t ORDER BY event_id DESC LIMIT 2)"),
    "join_semi": same("SELECT o_orderkey FROM orders_t WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "join_anti": same("SELECT o_orderkey FROM orders_t o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)"),
    "join_null_anti": same("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders_t WHERE o_custkey IS NOT NULL)"),
    "join_tier_tier": same("SELECT o_orderkey, event_type, value FROM orders_t JOIN events_t ON o_orderkey = event_id WHERE o_orderstatus = 'U'"),
    "join_tier_tier_left": same("SELECT event_id, o_orderkey FROM events_t LEFT JOIN orders_t ON o_orderkey = event_id"),
    "join_expr_key": same("SELECT o_orderkey, n_name FROM orders_t JOIN nation ON (o_custkey * 7 + o_orderkey) % 25 = n_nationkey"),
    "join_theta": same("SELECT a.o_orderkey AS x, b.event_id AS y FROM orders_t a JOIN events_t b ON a.o_custkey = b.user_id AND a.o_orderkey < b.event_id"),
    "join_disjunctive": same("SELECT o_orderkey, l_linenumber, l_quantity FROM orders_t, lineitem WHERE o_orderkey = l_orderkey AND (o_orderpriority = '1-URGENT' AND l_quantity > 45 OR o_orderstatus = 'U' AND l_quantity < 3)"),
    "join_self": same("SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders_t a JOIN orders_t b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate = b.o_orderdate"),
    "join_lateral": (
        "SELECT c_custkey, t.n, t.top FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders_t WHERE o_custkey = c_custkey) t",
        "SELECT c_custkey, coalesce(n, 0) AS n, top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders_t GROUP BY 1) ON o_custkey = c_custkey",
    ),
    # aggregates
    "agg_count_filter": same("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'U') AS changed, count(DISTINCT o_custkey) AS customers FROM orders_t"),
    "agg_min_max_avg": same(f"SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, {mean('o_totalprice')} AS mean FROM orders_t GROUP BY o_orderstatus"),
    "agg_empty": (
        "SELECT coalesce(sum(o_custkey), 0) AS s, count(*) AS n FROM orders_t WHERE o_orderkey < 0",
        "SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS s, count(*) AS n FROM orders_t WHERE o_orderkey < 0",
    ),
    "agg_having": same("SELECT o_custkey, count(*) AS n FROM orders_t GROUP BY o_custkey HAVING count(*) > (SELECT count(*) * 1.5 FROM orders_t) / (SELECT count(DISTINCT o_custkey) FROM orders_t)"),
    "agg_two_level": same("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders_t GROUP BY o_custkey) GROUP BY n"),
    "agg_distinct": same("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders_t"),
    "agg_distinct_pair": (
        "SELECT count(DISTINCT o_custkey, o_orderpriority) AS n FROM orders_t",
        "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders_t)",
    ),
    "agg_string": (
        "SELECT o_custkey, listagg(CAST(o_orderkey AS STRING), ',') WITHIN GROUP (ORDER BY o_orderkey) AS ids FROM orders_t GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders_t GROUP BY o_custkey",
    ),
    "agg_conditional": (
        "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'U' THEN 1 ELSE 0 END) AS changed FROM orders_t GROUP BY o_orderpriority",
        "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'U' THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM orders_t GROUP BY o_orderpriority",
    ),
    "agg_duplicate_keys": same("SELECT o_orderkey, count(*) AS n FROM orders_t GROUP BY o_orderkey HAVING count(*) > 1"),
    "agg_content_hash": (
        # a sum of rows' hashes: it depends on no order, and parts of it are summed apart
        "SELECT count(*) AS n, sum(CAST(conv(substr(md5(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 8), 16, 10) AS BIGINT)) AS h FROM orders_t",
        "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 8) AS BIGINT)) AS BIGINT) AS h FROM orders_t",
    ),
    "agg_json": (
        "SELECT o_custkey, to_json(array_sort(collect_list(o_orderkey))) AS keys FROM orders_t GROUP BY o_custkey",
        "SELECT o_custkey, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS keys FROM orders_t GROUP BY o_custkey",
    ),
    # windows, order, sets, subqueries
    "win_row_number": (
        "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth FROM orders_t",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders_t",
    ),
    "distinct_on": (
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders_t) WHERE k = 1",
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders_t ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    ),
    "sort_mixed": same("SELECT o_orderkey, o_orderpriority FROM orders_t ORDER BY o_orderpriority DESC, o_orderdate ASC, o_orderkey DESC LIMIT 77"),
    "sort_offset": same("SELECT o_orderkey, o_totalprice FROM orders_t ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 499"),
    "set_union_all": same("SELECT o_orderkey AS k FROM orders_t WHERE o_orderstatus = 'U' UNION ALL SELECT event_id FROM events_t"),
    "set_except_all": same("SELECT o_orderpriority FROM orders_t EXCEPT ALL SELECT o_orderpriority FROM orders_t WHERE o_orderstatus <> 'U'"),
    "cte": same(f"WITH spent AS (SELECT o_custkey, {money('o_totalprice')} AS total FROM orders_t GROUP BY o_custkey) SELECT o_custkey, total FROM spent WHERE total = (SELECT max(total) FROM spent)"),
    "scalar_subq": same("SELECT o_orderkey FROM orders_t WHERE o_totalprice > (SELECT max(o_totalprice) * 0.95 FROM orders_t)"),
    "exists_theta": same("SELECT o_orderpriority, count(*) AS n FROM orders_t o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_shipdate >= o.o_orderdate) GROUP BY o_orderpriority"),
    "nested_in": same("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders_t WHERE o_orderstatus = 'U') GROUP BY l_suppkey HAVING count(*) > 10)"),
    "gen_series": (
        "SELECT s.id AS k, CAST(s.id % 7 AS INT) AS r, o_custkey FROM range(1, 201) s LEFT JOIN orders_t ON o_orderkey = s.id",
        "SELECT k, CAST(k % 7 AS INT) AS r, o_custkey FROM range(1, 201) s(k) LEFT JOIN orders_t ON o_orderkey = k",
    ),
    "inline_values": same("SELECT v.code, count(*) AS n FROM (VALUES ('F'), ('O'), ('U')) AS v(code) JOIN orders_t ON o_orderstatus = v.code GROUP BY v.code"),
    # scalar functions
    "fn_string": (
        "SELECT event_id, lower(substr(event_type, 1, 8)) AS a, CAST(length(event_type) AS BIGINT) AS b, trim(concat('  ', props, ' ')) AS c, CAST(instr(event_type, 'i') AS BIGINT) AS d, ascii(props) AS e, concat_ws('-', props, NULL, event_type) AS f, md5(event_type) AS g, sha2(event_type, 256) AS h FROM events_t",
        "SELECT event_id, lower(substr(event_type, 1, 8)) AS a, length(event_type) AS b, trim(concat('  ', props, ' ')) AS c, instr(event_type, 'i') AS d, ascii(props) AS e, concat_ws('-', props, NULL, event_type) AS f, md5(event_type) AS g, sha256(event_type) AS h FROM events_t",
    ),
    "fn_like": same("SELECT o_orderkey FROM orders_t WHERE o_orderpriority LIKE '1-%' AND o_orderpriority NOT LIKE '%LOW' OR o_orderpriority ILIKE '%MEDIUM%' AND o_orderstatus IN ('U', 'F')"),
    "fn_null": same("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'U'), 'changed') AS s, greatest(o_custkey, o_orderkey) AS g, o_orderstatus IS DISTINCT FROM 'U' AS d FROM orders_t"),
    "fn_math": (
        "SELECT o_orderkey, o_orderkey % 17 AS m, o_orderkey DIV 10 AS q, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 3, 1) AS DOUBLE) AS r FROM orders_t",
        "SELECT o_orderkey, o_orderkey % 17 AS m, o_orderkey // 10 AS q, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 3, 1) AS DOUBLE) AS r FROM orders_t",
    ),
    "fn_date": (
        "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS s, o_orderdate + INTERVAL 7 DAYS AS later FROM orders_t WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(epoch(o_orderdate) AS BIGINT) AS s, o_orderdate + INTERVAL 7 DAY AS later FROM orders_t WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
    ),
    "fn_now": (
        "SELECT o_orderkey, o_orderdate < now() AS past, o_orderdate + INTERVAL 1 MONTH < now() AS month_past FROM orders_t",
        "SELECT o_orderkey, o_orderdate < CAST(now() AS TIMESTAMP) AS past, o_orderdate + INTERVAL 1 MONTH < CAST(now() AS TIMESTAMP) AS month_past FROM orders_t",
    ),
    "fn_cast": (
        "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS b, CAST(o_orderdate AS DATE) AS d FROM orders_t",
        "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS b, CAST(o_orderdate AS DATE) AS d FROM orders_t",
    ),
    "fn_json": (
        "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(to_json(named_struct('id', event_id, 'tags', array(event_type, 'x'))), '$.tags[0]') AS tag FROM events_t",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS tag FROM events_t",
    ),
    "fn_json_rows": (
        "SELECT event_id, x AS v FROM events_t LATERAL VIEW explode(from_json(concat('[', event_id, ',', user_id, ']'), 'array<bigint>')) t AS x",
        "SELECT event_id, unnest([event_id, user_id]) AS v FROM events_t",
    ),
    "fn_array": (
        "SELECT o_orderkey, CAST(size(a) AS BIGINT) AS n, element_at(a, 2) AS second, CAST(array_position(a, o_orderstatus) AS BIGINT) AS at, array_contains(a, 'U') AS has, p AS pos, x AS item FROM (SELECT o_orderkey, o_orderstatus, array(o_orderpriority, o_orderstatus) AS a FROM orders_t) LATERAL VIEW posexplode(a) t AS p, x",
        "SELECT o_orderkey, len(a) AS n, a[2] AS second, CAST(list_position(a, o_orderstatus) AS BIGINT) AS at, list_contains(a, 'U') AS has, unnest([0, 1]) AS pos, unnest(a) AS item FROM (SELECT o_orderkey, o_orderstatus, [o_orderpriority, o_orderstatus] AS a FROM orders_t)",
    ),
}

#: Analytical queries in the shapes of a combined transactional and analytical benchmark, over the star schema.
CH: dict[str, tuple[str, str]] = {
    "ch_q01": same(f"SELECT l_linenumber, {money('l_quantity')} AS qty, {money('l_extendedprice')} AS amount, {mean('l_quantity')} AS avg_qty, count(*) AS n FROM lineitem JOIN orders_t ON o_orderkey = l_orderkey WHERE l_shipdate > TIMESTAMP '1995-01-02 00:00:00' GROUP BY l_linenumber"),
    "ch_q02": same("SELECT s_suppkey, n_name, l_partkey, l_quantity FROM lineitem_t, supplier, nation, region, (SELECT l_partkey AS pk, min(l_quantity) AS least FROM lineitem_t, supplier, nation, region WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name LIKE 'E%' GROUP BY l_partkey) m WHERE l_partkey = pk AND l_quantity = least AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name LIKE 'E%'"),
    "ch_q03": same(f"SELECT o_orderkey, o_orderdate, {REVENUE} AS revenue FROM customer, orders_t, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_mktsegment LIKE 'A%' AND o_orderdate > TIMESTAMP '1996-01-01 00:00:00' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 100"),
    "ch_q04": same("SELECT o_orderpriority, count(*) AS n FROM orders_t o WHERE o_orderdate >= TIMESTAMP '1993-01-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_shipdate >= o.o_orderdate) GROUP BY o_orderpriority"),
    "ch_q05": same(f"SELECT n_name, {REVENUE} AS revenue FROM customer, orders_t, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND c_nationkey = s_nationkey AND n_regionkey = r_regionkey AND r_name LIKE 'A%' GROUP BY n_name"),
    "ch_q06": same(f"SELECT {money('l_extendedprice')} AS revenue FROM lineitem_t WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00' AND l_quantity BETWEEN 1 AND 20"),
    "ch_q07": same(f"SELECT n1.n_name AS supplier_nation, n2.n_name AS customer_nation, CAST(extract(year FROM l_shipdate) AS INT) AS y, {REVENUE} AS revenue FROM supplier, lineitem, orders_t, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND (n1.n_nationkey = 3 AND n2.n_nationkey = 7 OR n1.n_nationkey = 7 AND n2.n_nationkey = 3) GROUP BY n1.n_name, n2.n_name, extract(year FROM l_shipdate)"),
    "ch_q08": same(f"SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(sum(CASE WHEN n2.n_nationkey = 7 THEN {REV} ELSE 0 END) AS DOUBLE) / CAST(sum({REV}) AS DOUBLE) AS share FROM part, lineitem, supplier, orders_t, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND r_regionkey = 1 GROUP BY extract(year FROM o_orderdate)"),
    "ch_q09": same(f"SELECT n_name, CAST(extract(year FROM o_orderdate) AS INT) AS y, {REVENUE} AS profit FROM part, supplier, lineitem, orders_t, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_partkey % 3 = 0 GROUP BY n_name, extract(year FROM o_orderdate) ORDER BY n_name, y DESC"),
    "ch_q10": same(f"SELECT c_custkey, c_name, n_name, {REVENUE} AS revenue FROM customer, orders_t, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate <= l_shipdate AND c_nationkey = n_nationkey AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 200"),
    "ch_q11": same(f"SELECT l_partkey, {money('l_quantity')} AS qty FROM lineitem_t, supplier WHERE l_suppkey = s_suppkey AND s_nationkey < 10 GROUP BY l_partkey HAVING sum({M.format('l_quantity')}) > (SELECT sum({M.format('l_quantity')}) * 0.001 FROM lineitem_t, supplier WHERE l_suppkey = s_suppkey AND s_nationkey < 10)"),
    "ch_q12": same("SELECT l_linenumber, count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS high, count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS low FROM orders_t, lineitem WHERE o_orderkey = l_orderkey AND o_orderdate <= l_shipdate AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY l_linenumber"),
    "ch_q13": same("SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders_t ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders(c_custkey, n) GROUP BY n ORDER BY customers DESC, n DESC"),
    "ch_q14": same(f"SELECT 100.0 * CAST(sum(CASE WHEN p_partkey % 5 = 0 THEN {REV} ELSE 0 END) AS DOUBLE) / CAST(sum({REV}) AS DOUBLE) AS share FROM lineitem, part, orders_t WHERE l_partkey = p_partkey AND l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1994-01-01 00:00:00'"),
    "ch_q15": same(f"WITH revenue AS (SELECT l_suppkey AS suppkey, {REVENUE} AS total FROM lineitem JOIN orders_t ON l_orderkey = o_orderkey GROUP BY l_suppkey) SELECT s_suppkey, total FROM supplier, revenue WHERE s_suppkey = suppkey AND total = (SELECT max(total) FROM revenue)"),
    "ch_q16": same("SELECT p_partkey % 20 AS brand, count(DISTINCT l_suppkey) AS suppliers FROM lineitem_t, part WHERE p_partkey = l_partkey AND p_partkey % 7 <> 0 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 4) GROUP BY p_partkey % 20 ORDER BY suppliers DESC"),
    "ch_q17": same(f"SELECT {money('l_extendedprice')} / 7.0 AS yearly FROM lineitem_t, (SELECT p_partkey AS k, {mean('l_quantity')} AS a FROM part, lineitem_t WHERE l_partkey = p_partkey AND p_partkey % 4 = 0 GROUP BY p_partkey) t WHERE l_partkey = k AND l_quantity < a"),
    "ch_q18": same(f"SELECT c_name, o_orderkey, o_orderdate, {money('l_extendedprice')} AS amount FROM customer, orders_t, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY c_name, o_orderkey, o_orderdate HAVING sum({M.format('l_extendedprice')}) > 200000"),
    "ch_q19": same(f"SELECT {REVENUE} AS revenue FROM lineitem, part, orders_t WHERE o_orderkey = l_orderkey AND (l_partkey = p_partkey AND p_partkey % 3 = 0 AND l_quantity BETWEEN 1 AND 10 OR l_partkey = p_partkey AND p_partkey % 3 = 1 AND l_quantity BETWEEN 10 AND 20 OR l_partkey = p_partkey AND p_partkey % 3 = 2 AND l_quantity BETWEEN 20 AND 30)"),
    "ch_q20": same(f"SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_suppkey IN (SELECT l_suppkey FROM lineitem_t WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 9 = 0) GROUP BY l_suppkey, l_partkey HAVING sum({M.format('l_quantity')}) > 40)"),
    "ch_q21": same("SELECT s_suppkey, count(*) AS waiting FROM supplier, lineitem l1, orders_t WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND l1.l_shipdate > o_orderdate AND NOT EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_shipdate > l1.l_shipdate) GROUP BY s_suppkey ORDER BY waiting DESC, s_suppkey LIMIT 100"),
    "ch_q22": same(f"SELECT c_nationkey, count(*) AS n, {money('c_acctbal')} AS balance FROM customer WHERE c_nationkey IN (1, 2, 3, 4, 5, 6, 7) AND c_acctbal > (SELECT CAST(sum({M.format('c_acctbal')}) AS DOUBLE) / count(*) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders_t WHERE o_custkey = c_custkey AND o_totalprice > 350000) GROUP BY c_nationkey"),
}

#: Statements with named parameters: what Spark gets, the values, and the same with the values written out.
PARAMETERS: dict[str, tuple[str, dict, str]] = {
    "stmt_parameters": (
        "SELECT o_orderkey, o_totalprice FROM orders_t WHERE o_totalprice > :least AND o_orderpriority = :priority",
        {"least": 150000.0, "priority": "2-HIGH"},
        "SELECT o_orderkey, o_totalprice FROM orders_t WHERE o_totalprice > 150000 AND o_orderpriority = '2-HIGH'",
    ),
    "stmt_parameters_hostile": (
        "SELECT o_orderstatus, count(*) AS n FROM orders_t WHERE o_orderpriority <> :priority GROUP BY o_orderstatus",
        {"priority": "' OR '1' = '1"},
        "SELECT o_orderstatus, count(*) AS n FROM orders_t GROUP BY o_orderstatus",
    ),
}
