"""Filters, projections, joins, aggregates, set operations, previews, windows
and scalar-function families (inventory sections B, C, D, F, G, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ._registry import query, tbl

# ----------------------------------------------------------------- filters


@query("filter_predicate", """
SELECT * FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05""")
def filter_predicate(spark, sf):
    return R.where(tbl(spark, sf, "lineitem"), "l_quantity > 30 AND l_discount < 0.05")


@query("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf):
    return R.where_clauses(tbl(spark, sf, "orders"), [{"column": "o_orderstatus", "op": "eq", "value": "F"}])


@query("filter_neq", "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'")
def filter_neq(spark, sf):
    return R.where_clauses(tbl(spark, sf, "orders"),
                           [{"column": "o_orderpriority", "op": "neq", "value": "1-URGENT"}])


@query("filter_range", "SELECT * FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.02 AND l_discount <= 0.08")
def filter_range(spark, sf):
    return R.where_clauses(tbl(spark, sf, "lineitem"), [
        {"column": "l_quantity", "op": "gte", "value": 10},
        {"column": "l_quantity", "op": "lt", "value": 20},
        {"column": "l_discount", "op": "gt", "value": 0.02},
        {"column": "l_discount", "op": "lte", "value": 0.08}])


@query("filter_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, sf):
    return R.where_clauses(tbl(spark, sf, "orders"),
                           [{"column": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}])


@query("filter_not_in", "SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def filter_not_in(spark, sf):
    return R.where_clauses(tbl(spark, sf, "customer"),
                           [{"column": "c_mktsegment", "op": "not_in", "value": ["BUILDING", "MACHINERY"]}])


def _nullable_customer(spark, sf):
    # Base tables hold no NULLs; make some the same way the oracle does.
    return tbl(spark, sf, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))


_NULLABLE_CUSTOMER_SQL = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal,
  nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""


@query("filter_is_null", f"SELECT * FROM {_NULLABLE_CUSTOMER_SQL} WHERE c_mktsegment IS NULL")
def filter_is_null(spark, sf):
    return R.where_clauses(_nullable_customer(spark, sf), [{"column": "c_mktsegment", "op": "is_null"}])


@query("filter_is_not_null", f"SELECT * FROM {_NULLABLE_CUSTOMER_SQL} WHERE c_mktsegment IS NOT NULL")
def filter_is_not_null(spark, sf):
    return R.where_clauses(_nullable_customer(spark, sf), [{"column": "c_mktsegment", "op": "is_not_null"}])


@query("filter_like", "SELECT * FROM part WHERE p_name LIKE '%red%'")
def filter_like(spark, sf):
    return R.where_clauses(tbl(spark, sf, "part"), [{"column": "p_name", "op": "like", "value": "%red%"}])


@query("filter_conjunction", """
SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_quantity > 25
  AND l_shipdate >= TIMESTAMP '1996-01-01'""")
def filter_conjunction(spark, sf):
    return R.where_clauses(tbl(spark, sf, "lineitem"), [
        {"column": "l_returnflag", "op": "eq", "value": "R"},
        {"column": "l_linestatus", "op": "neq", "value": "O"},
        {"column": "l_quantity", "op": "gt", "value": 25},
        {"column": "l_shipdate", "op": "gte", "value": "1996-01-01 00:00:00"}])


# -------------------------------------------------------------- projection

@query("project_expr", """
SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS disc_price,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, lower(l_returnflag) AS rf
FROM lineitem""")
def project_expr(spark, sf):
    return R.project(tbl(spark, sf, "lineitem"), [
        "l_orderkey",
        {"expr": "l_extendedprice * (1 - l_discount)", "alias": "disc_price"},
        {"expr": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "alias": "charge"},
        {"expr": "lower(l_returnflag)", "alias": "rf"}])


@query("project_columns", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def project_columns(spark, sf):
    return R.project(tbl(spark, sf, "orders"), ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("map_columns", """
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
       lower(o_orderpriority) AS priority, upper(o_orderstatus) AS status FROM orders""")
def map_columns(spark, sf):
    return R.map_columns(tbl(spark, sf, "orders"), [
        {"source_column": "o_orderkey", "target_column": "order_id"},
        {"source_column": "o_orderdate", "target_column": "order_date", "transform": "CAST({{source}} AS DATE)"},
        {"source_column": "o_orderpriority", "target_column": "priority", "transform": "LOWER({{source}})"},
        {"source_column": "o_orderstatus", "target_column": "status", "transform": "UPPER({{source}})"}])


# ------------------------------------------------------------------- joins

@query("join_inner", "SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(spark, sf):
    return R.join(tbl(spark, sf, "orders"), tbl(spark, sf, "customer"), "o_custkey", "c_custkey", "inner")


# Outer, semi and anti joins need unmatched rows; every part has line items and
# every order a customer, so the keys of some rows are negated.  All rows of
# both tables take part.
_PARTS = "(SELECT * REPLACE (CASE WHEN p_size > 25 THEN -p_partkey ELSE p_partkey END AS p_partkey) FROM part)"
_ORDERS = "(SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS o_custkey) FROM orders)"
_CUSTOMERS = "(SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN -c_custkey ELSE c_custkey END AS c_custkey) FROM customer)"


def _negated(df, key, condition):
    return df.withColumn(key, F.when(F.expr(condition), -F.col(key)).otherwise(F.col(key)))


def _parts(spark, sf):
    return _negated(tbl(spark, sf, "part"), "p_partkey", "p_size > 25")


def _orders(spark, sf):
    return _negated(tbl(spark, sf, "orders"), "o_custkey", "o_orderstatus = 'P'")


def _customers(spark, sf):
    return _negated(tbl(spark, sf, "customer"), "c_custkey", "c_acctbal < 0")


@query("join_left", f"SELECT p.*, l.* FROM {_PARTS} p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey")
def join_left(spark, sf):
    return R.join(_parts(spark, sf), tbl(spark, sf, "lineitem"), "p_partkey", "l_partkey", "left")


@query("join_right", f"SELECT l.*, p.* FROM lineitem l RIGHT JOIN {_PARTS} p ON l.l_partkey = p.p_partkey")
def join_right(spark, sf):
    return R.join(tbl(spark, sf, "lineitem"), _parts(spark, sf), "l_partkey", "p_partkey", "right")


@query("join_full", f"SELECT o.*, c.* FROM {_ORDERS} o FULL OUTER JOIN {_CUSTOMERS} c ON o.o_custkey = c.c_custkey")
def join_full(spark, sf):
    return R.join(_orders(spark, sf), _customers(spark, sf), "o_custkey", "c_custkey", "full")


@query("join_cross", "SELECT c.*, r.* FROM customer c CROSS JOIN region r")
def join_cross(spark, sf):
    # The user-chosen join type; the right side is the fixed five-row region
    # dimension, so the product grows only linearly with customer.
    return R.join(tbl(spark, sf, "customer"), tbl(spark, sf, "region"), how="cross")


@query("join_semi", f"SELECT c.* FROM {_CUSTOMERS} c WHERE EXISTS (SELECT 1 FROM {_ORDERS} o WHERE o.o_custkey = c.c_custkey)")
def join_semi(spark, sf):
    return R.join(_customers(spark, sf), _orders(spark, sf), "c_custkey", "o_custkey", "left_semi")


@query("join_anti", f"SELECT c.* FROM {_CUSTOMERS} c WHERE NOT EXISTS (SELECT 1 FROM {_ORDERS} o WHERE o.o_custkey = c.c_custkey)")
def join_anti(spark, sf):
    return R.join(_customers(spark, sf), _orders(spark, sf), "c_custkey", "o_custkey", "left_anti")


@query("join_residual", """
SELECT o.*, c.* FROM orders o JOIN customer c
  ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 40""")
def join_residual(spark, sf):
    return R.join(tbl(spark, sf, "orders"), tbl(spark, sf, "customer"), "o_custkey", "c_custkey", "inner",
                  condition="l.o_totalprice > r.c_acctbal * 40")


@query("join_composite_key", """
SELECT l.*, s.n_lines FROM lineitem l JOIN
  (SELECT l_orderkey, l_suppkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey, l_suppkey) s
  ON l.l_orderkey = s.l_orderkey AND l.l_suppkey = s.l_suppkey""")
def join_composite_key(spark, sf):
    li = tbl(spark, sf, "lineitem")
    per = li.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"))
    return R.join(li, per, keys=[("l_orderkey", "l_orderkey"), ("l_suppkey", "l_suppkey")])


JOIN_CHAIN_SQL = """
SELECT l.*, o.*, c.*, n.* FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey"""


@query("join_chain", JOIN_CHAIN_SQL)
def join_chain(spark, sf):
    tables = {t: tbl(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation")}
    return R.join_chain(tables["lineitem"], [
        {"right_table": "orders", "left_key": "l_orderkey", "right_key": "o_orderkey"},
        {"right_table": "customer", "left_key": "o_custkey", "right_key": "c_custkey"},
        {"right_table": "nation", "left_key": "c_nationkey", "right_key": "n_nationkey"}], tables)


# -------------------------------------------------------------- aggregates

@query("agg_sum", "SELECT l_returnflag, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY l_returnflag")
def agg_sum(spark, sf):
    return R.aggregate(tbl(spark, sf, "lineitem"), ["l_returnflag"],
                       [{"col": "l_quantity", "func": "sum", "alias": "sum_qty"}])


@query("agg_multi", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum_price,
       round(avg(l_discount), 6) AS avg_disc, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty,
       count(l_orderkey) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_multi(spark, sf):
    df = R.aggregate(tbl(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [
        {"col": "l_extendedprice", "func": "sum", "alias": "sum_price"},
        {"col": "l_discount", "func": "avg", "alias": "avg_disc"},
        {"col": "l_quantity", "func": "min", "alias": "min_qty"},
        {"col": "l_quantity", "func": "max", "alias": "max_qty"},
        {"col": "l_orderkey", "func": "count", "alias": "n"}])
    return df.withColumns({"sum_price": F.round("sum_price", 2), "avg_disc": F.round("avg_disc", 6)})


@query("agg_global", """
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date,
       max(o_orderdate) AS last_date FROM orders""")
def agg_global(spark, sf):
    df = R.aggregate(tbl(spark, sf, "orders"), [], [
        {"col": "*", "func": "count", "alias": "n"},
        {"col": "o_totalprice", "func": "sum", "alias": "total"},
        {"col": "o_orderdate", "func": "min", "alias": "first_date"},
        {"col": "o_orderdate", "func": "max", "alias": "last_date"}])
    return df.withColumn("total", F.round("total", 2))


@query("agg_count_distinct", """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus""")
def agg_count_distinct(spark, sf):
    return R.aggregate(tbl(spark, sf, "orders"), ["o_orderstatus"],
                       [{"col": "o_custkey", "func": "count_distinct", "alias": "n_customers"}])


@query("agg_approx_distinct")
def agg_approx_distinct(spark, sf):
    # HyperLogLog++ sketch: mergeable partial aggregates, fixed memory per group.
    return R.aggregate(tbl(spark, sf, "lineitem"), ["l_returnflag"],
                       [{"col": "l_partkey", "func": "approx_count_distinct", "alias": "approx_parts"}])


@query("agg_stats", """
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd_qty, round(var_samp(l_discount), 8) AS var_disc,
       median(l_quantity) AS med_qty, list_sort(list(DISTINCT l_linestatus)) AS statuses
FROM lineitem GROUP BY l_returnflag""")
def agg_stats(spark, sf):
    df = R.aggregate(tbl(spark, sf, "lineitem"), ["l_returnflag"], [
        {"col": "l_quantity", "func": "stddev", "alias": "sd_qty"},
        {"col": "l_discount", "func": "variance", "alias": "var_disc"},
        {"col": "l_quantity", "func": "median", "alias": "med_qty"},
        {"col": "l_linestatus", "func": "collect_set", "alias": "statuses"}])
    return df.withColumns({"sd_qty": F.round("sd_qty", 6), "var_disc": F.round("var_disc", 8),
                           "statuses": F.sort_array("statuses")})


@query("pivot_sum", """
SELECT l_returnflag,
       sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS "F",
       sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS "O"
FROM lineitem GROUP BY l_returnflag""")
def pivot_sum(spark, sf):
    li = tbl(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return R.pivot(li, ["l_returnflag"], "l_linestatus", "l_quantity", "sum", values=["F", "O"])


@query("pivot_infer_values", """
SELECT o_orderpriority,
       count(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS "F",
       count(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS "O",
       count(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS "P"
FROM orders GROUP BY o_orderpriority""")
def pivot_infer_values(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey")
    return R.pivot(o, None, "o_orderstatus", "o_orderkey", "count")


# ------------------------------------------------------------------ set ops

@query("union_all_by_name", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 300000""")
def union_all_by_name(spark, sf):
    o = tbl(spark, sf, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = o.filter("o_orderstatus = 'O'").select("o_orderstatus", "o_orderkey", "o_custkey")
    c = o.filter("o_totalprice > 300000").select("o_custkey", "o_orderstatus", "o_orderkey")
    return R.union([a, b, c])


@query("union_distinct", """
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def union_distinct(spark, sf):
    o = tbl(spark, sf, "orders")
    return R.union([o.filter("o_orderstatus = 'F'").select("o_custkey"),
                    o.filter("o_orderstatus = 'O'").select("o_custkey")], distinct=True)


# ---------------------------------------------------------- preview / windows

@query("preview_limit")
def preview_limit(spark, sf):
    return R.preview(tbl(spark, sf, "orders"), 100)


@query("preview_topk", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 20")
def preview_topk(spark, sf):
    return R.preview(tbl(spark, sf, "orders"), 20, order_by=["o_totalprice desc", "o_orderkey asc"])


@query("window_rank", """
SELECT *, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS INTEGER) AS rnk FROM orders""")
def window_rank(spark, sf):
    return R.with_expr(tbl(spark, sf, "orders"),
                       "rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)", "rnk")


@query("window_lag", """
SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev_value FROM events""")
def window_lag(spark, sf):
    return R.with_expr(tbl(spark, sf, "events"), "lag(value) OVER (PARTITION BY user_id ORDER BY ts)",
                       "prev_value")


@query("window_running_sum", """
SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_qty FROM lineitem""")
def window_running_sum(spark, sf):
    return R.with_expr(tbl(spark, sf, "lineitem"),
                       "sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, "
                       "l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
                       "running_qty")


# ------------------------------------------------------ scalar function families

@query("expr_string", """
SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, trim('  ' || c_name || '  ') AS trimmed,
       substring(c_name, 1, 8) AS prefix8, concat_ws('-', c_name, c_mktsegment) AS joined,
       regexp_replace(c_name, '[0-9]', '#', 'g') AS masked, CAST(length(c_name) AS INTEGER) AS len
FROM customer""")
def expr_string(spark, sf):
    return R.project(tbl(spark, sf, "customer"), [
        "c_custkey",
        {"expr": "upper(c_name)", "alias": "up"},
        {"expr": "lower(c_mktsegment)", "alias": "low"},
        {"expr": "trim(concat('  ', c_name, '  '))", "alias": "trimmed"},
        {"expr": "substring(c_name, 1, 8)", "alias": "prefix8"},
        {"expr": "concat_ws('-', c_name, c_mktsegment)", "alias": "joined"},
        {"expr": "regexp_replace(c_name, '[0-9]', '#')", "alias": "masked"},
        {"expr": "length(c_name)", "alias": "len"}])


@query("expr_date", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days_to_2000,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due, CAST(o_orderdate AS DATE) AS d
FROM orders""")
def expr_date(spark, sf):
    return R.project(tbl(spark, sf, "orders"), [
        "o_orderkey",
        {"expr": "year(o_orderdate)", "alias": "y"},
        {"expr": "month(o_orderdate)", "alias": "m"},
        {"expr": "CAST(date_trunc('month', o_orderdate) AS DATE)", "alias": "month_start"},
        {"expr": "datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE))", "alias": "days_to_2000"},
        {"expr": "date_add(CAST(o_orderdate AS DATE), 30)", "alias": "due"},
        {"expr": "CAST(o_orderdate AS DATE)", "alias": "d"}])


@query("expr_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice) AS r0, abs(l_discount - 0.05) AS dev,
       CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_extendedprice) AS BIGINT) AS cl,
       sqrt(l_quantity) AS sq, ((l_orderkey % 7) + 7) % 7 AS pm
FROM lineitem""")
def expr_math(spark, sf):
    return R.project(tbl(spark, sf, "lineitem"), [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        {"expr": "round(l_extendedprice)", "alias": "r0"},
        {"expr": "abs(l_discount - 0.05)", "alias": "dev"},
        {"expr": "floor(l_extendedprice)", "alias": "fl"},
        {"expr": "ceil(l_extendedprice)", "alias": "cl"},
        {"expr": "sqrt(l_quantity)", "alias": "sq"},
        {"expr": "pmod(l_orderkey, 7)", "alias": "pm"}])


@query("expr_conditional", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band
FROM orders""")
def expr_conditional(spark, sf):
    return R.project(tbl(spark, sf, "orders"), [
        "o_orderkey",
        {"expr": "coalesce(nullif(o_orderstatus, 'P'), 'pending')", "alias": "status"},
        {"expr": "CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' "
                 "ELSE 'low' END", "alias": "band"}])


@query("expr_array", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, embedding[1] AS first,
       list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) AS total,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_pos,
       list_transform(embedding, lambda x: x * 2) AS doubled
FROM embeddings""")
def expr_array(spark, sf):
    return R.project(tbl(spark, sf, "embeddings"), [
        "vec_id",
        {"expr": "size(embedding)", "alias": "dim"},
        {"expr": "element_at(embedding, 1)", "alias": "first"},
        {"expr": "aggregate(embedding, CAST(0 AS DOUBLE), (acc, x) -> acc + x)", "alias": "total"},
        {"expr": "size(filter(embedding, x -> x > 0))", "alias": "n_pos"},
        {"expr": "transform(embedding, x -> CAST(x * 2 AS FLOAT))", "alias": "doubled"}])


@query("expr_map_struct")
def expr_map_struct(spark, sf):
    return R.project(tbl(spark, sf, "customer"), [
        "c_custkey",
        {"expr": "map_from_arrays(array('seg', 'name'), array(c_mktsegment, c_name))", "alias": "attrs"},
        {"expr": "element_at(map_from_arrays(array('seg'), array(c_mktsegment)), 'seg')", "alias": "seg"},
        {"expr": "named_struct('key', c_custkey, 'nation', c_nationkey)", "alias": "ref"}])


@query("expr_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS k_plus
FROM events""")
def expr_json(spark, sf):
    return R.project(tbl(spark, sf, "events"), [
        "event_id",
        {"expr": "CAST(get_json_object(props, '$.k') AS INT)", "alias": "k"},
        {"expr": "from_json(props, 'k INT').k + 1", "alias": "k_plus"}])


@query("expr_hash", """
SELECT c_custkey, sha256(c_name) AS h256, md5(c_name) AS h_md5, sha1(c_name) AS h_sha1 FROM customer""")
def expr_hash(spark, sf):
    return R.project(tbl(spark, sf, "customer"), [
        "c_custkey",
        {"expr": "sha2(c_name, 256)", "alias": "h256"},
        {"expr": "md5(c_name)", "alias": "h_md5"},
        {"expr": "sha1(c_name)", "alias": "h_sha1"}])
