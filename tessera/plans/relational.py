"""Relational algebra through the SQL facade: one query for each family."""

from tessera.plans.registry import sql

# projections and filters
sql("projection", "SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 AS twice FROM part")
sql("filter_bool", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS kind FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT o_totalprice BETWEEN 1000 AND 50000 AND o_custkey IS NOT NULL AND o_orderkey <> 7")
sql("like_prefix", "SELECT path, name FROM dentries WHERE path LIKE '/src1/%' AND name NOT LIKE '%9.txt' AND name ILIKE '%.TXT'")
sql("regex_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_like(p_name, '^(red|small) .*[gt]$')", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|small) .*[gt]$')")
sql("keyword_or", "SELECT id, name FROM workspaces WHERE name ILIKE '%#0000000_7%' OR description ILIKE '%#0000000_7%' OR description ILIKE '%of%3_'")
sql("series", "SELECT id * id AS square FROM range(1, 101)", "SELECT range * range AS square FROM range(1, 101)")

# joins
sql("join_inner", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n USING (n_nationkey)".replace("JOIN nation n USING (n_nationkey)", "JOIN nation n ON n.n_nationkey = c.c_nationkey"))
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
sql("join_right", "SELECT o.o_orderkey, c.c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey")
sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey")
sql("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderstatus = 'P')")
sql("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
sql("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
sql("join_theta", "SELECT a.n_nationkey AS lo, b.n_nationkey AS hi FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_natural", "SELECT r_regionkey, r_name, k FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS k FROM nation GROUP BY n_regionkey) x")
sql("join_lateral", "SELECT n.n_name, t.best FROM nation n, LATERAL (SELECT max(s.s_acctbal) AS best FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t")

# aggregation
sql("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus".replace("TIMESTAMP '1998", "TIMESTAMP_NTZ '1998"), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
sql("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority")
sql("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 3000000")
sql("agg_filter", "SELECT l_linenumber, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS cheap FROM lineitem GROUP BY l_linenumber")
sql("agg_stats", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 3) AS vp, round(corr(p_size, p_retailprice), 5) AS r, round(median(p_size), 3) AS mid, bool_and(p_size > 0) AS all_sized, bool_or(p_size > 49) AS any_large, bit_or(p_size) AS bits FROM part GROUP BY p_brand")
sql("agg_collect", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_percentile", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.9), 2) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 2) AS p90 FROM orders GROUP BY o_orderstatus")
for _kind, _by in (("grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("rollup", "ROLLUP (l_returnflag, l_linestatus)")):
    sql(_kind, f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem GROUP BY {_by}")

# windows
sql("win_rank", "SELECT s_suppkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(4) OVER w AS nt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
sql("win_lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after2, first_value(value) OVER w AS first, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
sql("win_frame_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY event_type) AS n FROM events")
sql("win_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND 50000 FOLLOWING) AS near FROM orders")
sql("win_qualify", "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier) t WHERE rn <= 2")

# sort, limit, sets, subqueries
sql("sort_limit", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders ORDER BY o_custkey DESC NULLS LAST, o_orderpriority LIMIT 50 OFFSET 10")
sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
sql("intersect_all", "SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT l_suppkey FROM lineitem")
sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("except_all", "SELECT l_suppkey AS k FROM lineitem EXCEPT ALL SELECT o_custkey FROM orders")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 2000000) SELECT c_name, round(t, 2) AS total FROM top JOIN customer ON c_custkey = o_custkey")
sql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND p_size < (SELECT max(p_size) FROM part) - 10")
sql("corr_subquery", "SELECT s_suppkey FROM supplier s WHERE s_acctbal > (SELECT avg(t.s_acctbal) FROM supplier t WHERE t.s_nationkey = s.s_nationkey)")
sql("values_table", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v) WHERE v IS NOT NULL OR k = 3")

# functions
sql("fn_string", "SELECT p_partkey, lower(p_brand) AS lo, trim('  x ') || substring(p_name, 2, 4) AS sub, concat(p_type, '-', p_name) AS cat, replace(p_name, 'r', 'RR') AS rep, lpad(CAST(p_size AS STRING), 5, '0') AS pad, length(p_name) AS len, levenshtein(p_name, 'red ring') AS lev, reverse(p_type) AS rev, instr(p_name, 'i') AS pos, regexp_replace(p_name, '[aeiou]', '_') AS vow FROM part", "SELECT p_partkey, lower(p_brand) AS lo, trim('  x ') || substring(p_name, 2, 4) AS sub, concat(p_type, '-', p_name) AS cat, replace(p_name, 'r', 'RR') AS rep, lpad(CAST(p_size AS STRING), 5, '0') AS pad, CAST(length(p_name) AS INT) AS len, CAST(levenshtein(p_name, 'red ring') AS INT) AS lev, reverse(p_type) AS rev, CAST(instr(p_name, 'i') AS INT) AS pos, regexp_replace(p_name, '[aeiou]', '_', 'g') AS vow FROM part")
sql("fn_date", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, date_add(CAST(o_orderdate AS DATE), 30) AS later, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS days, date_format(o_orderdate, 'yyyy/MM/dd') AS text FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INT) AS days, strftime(o_orderdate, '%Y/%m/%d') AS text FROM orders")
sql("fn_math", "SELECT p_partkey, round(sqrt(p_size), 6) AS root, abs(p_size - 25) AS dist, power(p_size, 2) AS sq, p_size % 7 AS m, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, CAST(ceil(p_retailprice / 7) AS BIGINT) AS c, round(ln(p_retailprice), 6) AS l, CAST(sign(p_size - 25) AS INT) AS s FROM part")
sql("fn_array", "SELECT doc_id, size(split(source, 'r')) AS parts, array_contains(array('de', 'en'), lang) AS known, aggregate(filter(transform(sequence(1, 5), x -> x * CAST(doc_id % 7 AS INT)), x -> x % 2 = 0), 0, (a, x) -> a + x) AS evens FROM documents", "SELECT doc_id, CAST(len(string_split(source, 'r')) AS INT) AS parts, list_contains(['de', 'en'], lang) AS known, CAST(coalesce(list_sum(list_filter(list_transform(range(1, 6), lambda x: x * (doc_id % 7)), lambda x: x % 2 = 0)), 0) AS INT) AS evens FROM documents")
sql("fn_explode", "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, explode(split(text, ' ')) AS w FROM documents) GROUP BY doc_id, w", "SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY doc_id, w", dealt={"documents": "doc_id"})
sql("fn_map", "SELECT n_nationkey, element_at(map('k', n_regionkey, 'n', n_nationkey), 'k') AS k, size(map_keys(map('a', 1, 'b', n_regionkey))) AS n FROM nation", "SELECT n_nationkey, n_regionkey AS k, 2 AS n FROM nation")
sql("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS k1, variant_get(parse_json(props), '$.k', 'bigint') AS kv FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) + 1 AS k1, CAST(json_extract(props, '$.k') AS BIGINT) AS kv FROM events")
sql("fn_cond", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), 'none') AS seg, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich' END AS kind, CAST(c_acctbal AS BIGINT) AS whole FROM customer WHERE c_acctbal - floor(c_acctbal) < 0.4 AND c_acctbal > 0", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), 'none') AS seg, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 9000 THEN 'rich' END AS kind, CAST(floor(c_acctbal) AS BIGINT) AS whole FROM customer WHERE c_acctbal - floor(c_acctbal) < 0.4 AND c_acctbal > 0")
sql("json_extract", "SELECT id, get_json_object(payload, '$.file_id') AS file_id FROM outbox WHERE get_json_object(payload, '$.file_id') IN ('f1', 'f2', 'f3')", "SELECT id, json_extract_string(payload, '$.file_id') AS file_id FROM outbox WHERE json_extract_string(payload, '$.file_id') IN ('f1', 'f2', 'f3')")
sql("offset_page", "SELECT id, name, count(*) OVER () AS total FROM workspaces WHERE kind = 'fs' ORDER BY id LIMIT 20 OFFSET 20")
