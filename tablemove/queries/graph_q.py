"""Schema-relationship and graph queries (inventory sections H, C10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import overlap as O  # noqa: E741
from ..operators import relate as H
from ..operators.quality import orphan_counts
from ..sources.catalog import catalog_columns
from ._registry import query, tbl
from .sources_q import STAR_COLUMNS

ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()

# Declared foreign keys of the test schema (table, column, "table.column").
DECLARED_FKS = [
    ("nation", "n_regionkey", "region.r_regionkey"),
    ("customer", "c_nationkey", "nation.n_nationkey"),
    ("supplier", "s_nationkey", "nation.n_nationkey"),
    ("orders", "o_custkey", "customer.c_custkey"),
    ("lineitem", "l_orderkey", "orders.o_orderkey"),
    ("lineitem", "l_partkey", "part.p_partkey"),
    ("lineitem", "l_suppkey", "supplier.s_suppkey"),
    ("labels", "doc_id", "documents.doc_id"),
]


def _catalog(spark, sf, names=ALL_TABLES):
    return catalog_columns(spark, {t: tbl(spark, sf, t) for t in names})


# ------------------------------------------------------------ profile (H1)

def _profile_sql():
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
             "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
    parts = []
    for i, c in enumerate(STAR_COLUMNS["orders"]):
        parts.append(f"""SELECT count(*) AS row_count, '{c}' AS column_name, {i + 1} AS ordinal, '{types[c]}' AS dtype,
  1.0 - count({c}) / count(*) AS null_pct, count(DISTINCT {c}) AS distinct_count,
  CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders""")
    return "\nUNION ALL ".join(parts)


@query("profile_columns", _profile_sql())
def profile_columns(spark, sf):
    return H.profile_columns(tbl(spark, sf, "orders"))


FINGERPRINT_SQL = """
WITH c AS (SELECT DISTINCT table_name, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'float'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS dtype
  FROM information_schema.columns WHERE table_name IN (%s))
SELECT table_name, md5(to_json(list({'column_name': column_name, 'dtype': dtype} ORDER BY column_name, dtype)))
  AS fingerprint
FROM c GROUP BY table_name""" % ", ".join(f"'{t}'" for t in ALL_TABLES)


@query("schema_fingerprint", FINGERPRINT_SQL)
def schema_fingerprint(spark, sf):
    return H.schema_fingerprint(_catalog(spark, sf))


# ---------------------------------------------------------------- drift

def _evolved(spark, sf):
    """The star tables after a schema change, derived from the data."""
    o = tbl(spark, sf, "orders").withColumn("o_comment", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    c = tbl(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
    li = tbl(spark, sf, "lineitem").drop("l_tax")
    return {"orders": o, "customer": c, "lineitem": li, "part": tbl(spark, sf, "part")}


DRIFT_SQL = """
WITH old AS (SELECT DISTINCT table_name, column_name, data_type FROM information_schema.columns
             WHERE table_name IN ('orders', 'customer', 'lineitem', 'part')),
new AS (SELECT table_name, column_name,
               CASE WHEN table_name = 'customer' AND column_name = 'c_acctbal' THEN 'DECIMAL(12,2)' ELSE data_type END
                 AS data_type
        FROM old WHERE NOT (table_name = 'lineitem' AND column_name = 'l_tax')
        UNION ALL SELECT 'orders', 'o_comment', 'VARCHAR'),
j AS (SELECT coalesce(o.table_name, n.table_name) AS t, coalesce(o.column_name, n.column_name) AS c,
             o.data_type AS ot, n.data_type AS nt
      FROM old o FULL JOIN new n ON o.table_name = n.table_name AND o.column_name = n.column_name)
SELECT t AS table_name,
       coalesce(list_sort(list(c) FILTER (WHERE ot IS NULL)), []::VARCHAR[]) AS added_columns,
       coalesce(list_sort(list(c) FILTER (WHERE nt IS NULL)), []::VARCHAR[]) AS removed_columns,
       coalesce(list_sort(list(c) FILTER (WHERE ot IS NOT NULL AND nt IS NOT NULL AND ot <> nt)), []::VARCHAR[])
         AS type_changed_columns
FROM j GROUP BY t HAVING count(*) FILTER (WHERE ot IS NULL OR nt IS NULL OR ot <> nt) > 0"""


@query("schema_drift", DRIFT_SQL)
def schema_drift(spark, sf):
    old = _catalog(spark, sf, ("orders", "customer", "lineitem", "part"))
    new = catalog_columns(spark, _evolved(spark, sf))
    return H.schema_drift(old, new).drop("old_fingerprint", "new_fingerprint")


@query("schema_diff", """
SELECT * FROM (VALUES ('o_comment', 'added', 'string', NULL), ('o_totalprice', 'type_changed', 'decimal(18,2)', 'double'),
                      ('o_orderpriority', 'removed', NULL, 'string'))
  AS t("column", change, staged_type, dest_type)""")
def schema_diff(spark, sf):
    dest = tbl(spark, sf, "orders")
    staged = (dest.withColumn("o_comment", F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
                  .withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
                  .drop("o_orderpriority"))
    return H.schema_diff(staged, dest)


# ---------------------------------------------------------------- edges

def fk_catalog(spark):
    return spark.createDataFrame(DECLARED_FKS, "table_name string, column_name string, foreign_key string")


def verified_fk_edges(spark, sf):
    """Explicit edges with their orphan count, checked against the data."""
    tables_df = spark.createDataFrame([(t,) for t in ALL_TABLES], "table_name string")
    edges = H.explicit_edges(fk_catalog(spark), tables_df)
    fks = [(src, col, *ref.rsplit(".", 1)) for src, col, ref in DECLARED_FKS]
    names = {t for fk in fks for t in (fk[0], fk[2])}
    checks = orphan_counts({t: tbl(spark, sf, t) for t in names}, fks).select(
        F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), "orphan_rows")
    return edges.join(checks, ["source_table", "source_column"])


def _fk_sql():
    parts = []
    for src, col, ref in DECLARED_FKS:
        rt, rc = ref.rsplit(".", 1)
        parts.append(f"""SELECT '{src}' AS source_table, '{col}' AS source_column, '{rt}' AS target_table,
  '{rc}' AS target_column, 'explicit' AS kind, 1.0::DOUBLE AS confidence,
  (SELECT count(*) FROM {src} s WHERE s.{col} IS NOT NULL AND NOT EXISTS
     (SELECT 1 FROM {rt} r WHERE r.{rc} = s.{col})) AS orphan_rows""")
    return "\nUNION ALL ".join(parts)


@query("explicit_edges", _fk_sql())
def explicit_edges(spark, sf):
    return verified_fk_edges(spark, sf).select("source_table", "source_column", "target_table", "target_column",
                                               "kind", "confidence", "orphan_rows")


_TWO61 = "2305843009213693952"  # 2^61: exact scaling for Python-style half-even rounding in SQL

NAME_EDGES_SQL = f"""
WITH cols AS (SELECT DISTINCT table_name AS t, column_name AS c, ordinal_position AS o,
                     replace(lower(column_name), '_', '') AS k
              FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in ALL_TABLES)})),
pairs AS (SELECT a.t AS ta, a.c AS ac, a.o AS ao, a.k AS ak, b.t AS tb, b.c AS bc, b.o AS bo, b.k AS bk
          FROM cols a JOIN cols b ON a.t < b.t),
lcs AS (SELECT *, list_reduce(string_split(ak, ''),
          lambda row, ch: list_reduce(range(1, length(bk) + 1),
            lambda nr, j: list_append(nr, CASE WHEN bk[j] = ch THEN row[j] + 1 ELSE greatest(row[j + 1], nr[j]) END),
            [0]),
          list_transform(range(0, length(bk) + 1), lambda x: 0))[length(bk) + 1] AS l
        FROM pairs),
r AS (SELECT *, CAST(2 * l AS DOUBLE) / CAST(length(ak) + length(bk) AS DOUBLE) AS ratio FROM lcs
      WHERE length(ak) + length(bk) > 0),
f AS (SELECT *, CAST(CAST(0.9 AS DOUBLE) * ratio * {_TWO61}.0 AS HUGEINT) * 1000 AS num FROM r
      WHERE ratio >= 0.7 - 1e-12),
q AS (SELECT *, num // {_TWO61} AS qq, (num - (num // {_TWO61}) * {_TWO61}) * 2 AS rem2 FROM f),
c AS (SELECT *, CAST(qq + CASE WHEN rem2 > {_TWO61} OR (rem2 = {_TWO61} AND qq % 2 = 1) THEN 1 ELSE 0 END
                     AS DOUBLE) / 1000.0 AS confidence FROM q)
SELECT ta AS source_table, tb AS target_table, 'inferred_name' AS kind, ac AS source_column,
       bc AS target_column, confidence, confidence < 0.85 AS needs_confirmation
FROM c QUALIFY row_number() OVER (PARTITION BY ta, tb ORDER BY confidence DESC, ao, bo) = 1"""


@query("name_edges", NAME_EDGES_SQL)
def name_edges(spark, sf):
    cols = _catalog(spark, sf).withColumn("connector", F.col("table_name"))
    return H.name_edges(cols).select("source_table", "target_table", "kind", "source_column", "target_column",
                                     "confidence", "needs_confirmation")


OVERLAP_PAIRS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"),
    ("orders", "o_orderstatus", "lineitem", "l_linestatus"),
]


def _overlap_sql():
    parts = []
    for ta, ca, tb, cb in OVERLAP_PAIRS:
        parts.append(f"""SELECT '{ta}' AS table_a, '{ca}' AS column_a, '{tb}' AS table_b, '{cb}' AS column_b,
  (SELECT count(DISTINCT {ca}) FROM {ta}) AS n_a, (SELECT count(DISTINCT {cb}) FROM {tb}) AS n_b,
  (SELECT count(*) FROM (SELECT DISTINCT CAST({ca} AS VARCHAR) v FROM {ta} INTERSECT
                         SELECT DISTINCT CAST({cb} AS VARCHAR) FROM {tb})) AS n_both""")
    body = "\nUNION ALL ".join(parts)
    return f"""SELECT *, CASE WHEN n_a + n_b - n_both > 0 THEN n_both / (n_a + n_b - n_both) ELSE 0.0 END AS jaccard,
  CASE WHEN least(n_a, n_b) > 0 THEN n_both / least(n_a, n_b) ELSE 0.0 END AS containment FROM ({body})"""


def _overlap(spark, sf):
    tables = {t: tbl(spark, sf, t) for t in {p[0] for p in OVERLAP_PAIRS} | {p[2] for p in OVERLAP_PAIRS}}
    return H.value_overlap(tables, OVERLAP_PAIRS)


@query("value_overlap", _overlap_sql())
def value_overlap(spark, sf):
    return _overlap(spark, sf)


# Columns of the test tables by the common form of their values.
NUMBERS = """region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey customer.c_acctbal
supplier.s_suppkey supplier.s_nationkey supplier.s_acctbal part.p_partkey part.p_size part.p_retailprice orders.o_orderkey
orders.o_custkey orders.o_totalprice lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber
lineitem.l_quantity lineitem.l_extendedprice lineitem.l_discount lineitem.l_tax events.event_id events.user_id events.value
documents.doc_id documents.n_chars embeddings.vec_id embeddings.label pages.page_id benchmark.item_id labels.doc_id
labels.quality labels.toxic conversations.conv_id conversations.turn""".split()
TEXTS = """region.r_name nation.n_name customer.c_name customer.c_mktsegment supplier.s_name part.p_name part.p_brand part.p_type
orders.o_orderstatus orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus events.event_type events.props documents.text
documents.lang documents.source pages.url pages.html benchmark.text conversations.role conversations.text""".split()
TIMES, VECTORS = ["orders.o_orderdate", "lineitem.l_shipdate", "events.ts"], ["embeddings.embedding"]


def _all_overlaps_sql(where=""):
    number = "'n' || CASE WHEN CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE)) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({c} AS DOUBLE) AS VARCHAR) END"
    forms = [(NUMBERS, number), (TEXTS, "'s' || {c}"), (TIMES, "'t' || CAST({c} AS VARCHAR)"), (VECTORS, "'v' || CAST({c} AS VARCHAR)")]
    one = "SELECT DISTINCT '{t}' AS t, '{c}' AS c, {form} AS v FROM {t} WHERE {c} IS NOT NULL"
    rows = " UNION ALL ".join(one.format(t=t, c=c, form=form.format(c=c)) for names, form in forms for t, c in (x.split(".") for x in names))
    names = ", ".join("('{}', '{}')".format(*x.split(".")) for x, _ in ((x, f) for names, f in forms for x in names))
    return f"""
WITH vals AS ({rows}), cols(t, c) AS (VALUES {names}),
n AS (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c),
met AS (SELECT x.t AS ta, x.c AS ca, y.t AS tb, y.c AS cb, count(*) AS n FROM vals x JOIN vals y ON x.v = y.v AND (x.t < y.t OR x.t = y.t AND x.c < y.c) GROUP BY ALL),
counted AS (
  SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, coalesce(na.n, 0) AS n_a, coalesce(nb.n, 0) AS n_b, coalesce(met.n, 0) AS n_both
  FROM cols a JOIN cols b ON a.t < b.t OR a.t = b.t AND a.c < b.c
  LEFT JOIN n na ON na.t = a.t AND na.c = a.c LEFT JOIN n nb ON nb.t = b.t AND nb.c = b.c
  LEFT JOIN met ON ta = a.t AND ca = a.c AND tb = b.t AND cb = b.c),
shares AS (
  SELECT *, CASE WHEN n_a + n_b - n_both > 0 THEN n_both / (n_a + n_b - n_both) ELSE 0.0 END AS jaccard,
    CASE WHEN least(n_a, n_b) > 0 THEN n_both / least(n_a, n_b) ELSE 0.0 END AS containment FROM counted)
SELECT * FROM shares {where}"""


@query("value_overlap_all", _all_overlaps_sql())
def value_overlap_all(spark, sf):
    """Overlap of all pairs of columns of all tables, with each pair in the result."""
    return O.value_overlap_all({t: tbl(spark, sf, t) for t in ALL_TABLES})


@query("value_overlap_likely", _all_overlaps_sql("WHERE jaccard >= 0.5"))
def value_overlap_likely(spark, sf):
    """The pairs that share at least half of their values: chosen by sketches, counted exactly."""
    return O.value_overlap_all({t: tbl(spark, sf, t) for t in ALL_TABLES}, least_jaccard=0.5)


def _edge_table(spark, sf):
    ex = verified_fk_edges(spark, sf).drop("orphan_rows")
    return ex.unionByName(H.value_edges(_overlap(spark, sf)))


@query("low_confidence_edges", f"""
SELECT table_a AS source_table, column_a AS source_column, table_b AS target_table, column_b AS target_column,
       round(0.6 * jaccard, 3) AS confidence, TRUE AS needs_confirmation
FROM ({_overlap_sql()}) WHERE jaccard >= 0.5""")
def low_confidence_edges(spark, sf):
    return H.low_confidence(_edge_table(spark, sf)).select(
        "source_table", "source_column", "target_table", "target_column", "confidence", "needs_confirmation")


JOIN_REQUESTS = [("lineitem", "orders", "l_orderkey", "o_orderkey"),
                 ("customer", "orders", "c_custkey", "o_custkey"),
                 ("orders", "customer", "o_orderkey", "c_custkey"),
                 ("events", "customer", "user_id", "c_custkey")]


@query("join_support", """
SELECT * FROM (VALUES ('lineitem', 'orders', 'l_orderkey', 'o_orderkey', 1.0::DOUBLE, FALSE),
                      ('customer', 'orders', 'c_custkey', 'o_custkey', 1.0::DOUBLE, FALSE),
                      ('orders', 'customer', 'o_orderkey', 'c_custkey', 0.7::DOUBLE, TRUE),
                      ('events', 'customer', 'user_id', 'c_custkey', 0.7::DOUBLE, TRUE))
  AS t(left_table, right_table, left_key, right_key, confidence, needs_confirmation)""")
def join_support(spark, sf):
    joins = spark.createDataFrame(JOIN_REQUESTS, "left_table string, right_table string, left_key string, right_key string")
    return H.check_joins(joins, _edge_table(spark, sf)).drop("reasoning")


@query("mapping_report", """
SELECT * FROM (VALUES ('c_custkey', 'customer_id', 0.9::DOUBLE, 'bigint', 'bigint', FALSE),
                      ('c_name', 'full_name', 0.8::DOUBLE, 'string', 'string', FALSE),
                      ('c_acctbal', 'lifetime_value', 0.75::DOUBLE, 'double', 'double', FALSE),
                      ('c_nationkey', 'country_code', 0.6::DOUBLE, 'int', 'string', TRUE))
  AS t(source_column, target_column, score, source_type, target_type, type_mismatch),
  (SELECT 0.763::DOUBLE AS overall_confidence)""")
def mapping_report(spark, sf):
    src = catalog_columns(spark, {"customer": tbl(spark, sf, "customer")})
    # Destination schema of the warehouse customer dimension (fixture).
    dst = spark.createDataFrame(
        [("dim_customer", "customer_id", 1, "bigint", False), ("dim_customer", "full_name", 2, "string", True),
         ("dim_customer", "lifetime_value", 3, "double", True), ("dim_customer", "country_code", 4, "string", True)],
        "table_name string, column_name string, ordinal int, dtype string, nullable boolean")
    maps = spark.createDataFrame([("c_custkey", "customer_id", 0.9), ("c_name", "full_name", 0.8),
                                  ("c_acctbal", "lifetime_value", 0.75), ("c_nationkey", "country_code", 0.6)],
                                 "source_column string, target_column string, score double")
    return H.mapping_report(maps, src, dst)


# ---------------------------------------------------------------- graphs

def _fk_edges_sql():
    rows = ", ".join(f"('{s}', '{r.split('.')[0]}')" for s, _, r in DECLARED_FKS)
    return f"(SELECT a AS src, b AS dst FROM (VALUES {rows}) t(a, b) UNION SELECT b, a FROM (VALUES {rows}) t(a, b))"


def _path_sql(source, target):
    return f"""
WITH RECURSIVE e AS {_fk_edges_sql()},
p(node, path) AS (SELECT '{source}', ['{source}'] UNION ALL
  SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.node = e.src WHERE NOT list_contains(p.path, e.dst)),
hit AS (SELECT path FROM p WHERE node = '{target}')
SELECT CAST(len(min(path)) - 1 AS INTEGER) AS hops, min(path) AS path FROM hit
WHERE len(path) = (SELECT min(len(path)) FROM hit)"""


@query("join_path", _path_sql("lineitem", "nation"))
def join_path(spark, sf):
    return G.join_path(verified_fk_edges(spark, sf).filter(F.col("orphan_rows") == 0), "lineitem", "nation")


@query("auto_join", """
SELECT l.*, o.*, c.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey""")
def auto_join(spark, sf):
    tables = {t: tbl(spark, sf, t) for t in ALL_TABLES}
    edges = verified_fk_edges(spark, sf).filter(F.col("orphan_rows") == 0)
    return G.auto_join(tables, edges, ["lineitem", "customer"])


# Data graph: customers and the parts they bought, over all line items.
BUY_EDGES_SQL = """(SELECT DISTINCT 'c' || CAST(o.o_custkey AS VARCHAR) AS src, 'p' || CAST(l.l_partkey AS VARCHAR) AS dst
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def buy_edges(spark, sf):
    li = tbl(spark, sf, "lineitem")
    o = tbl(spark, sf, "orders")
    return (li.join(o, li["l_orderkey"] == o["o_orderkey"])
              .select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                      F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct())


@query("connected_components", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {BUY_EDGES_SQL} UNION SELECT dst, src FROM {BUY_EDGES_SQL}),
r(node, comp) USING KEY (node) AS (SELECT DISTINCT src, src FROM e
  UNION SELECT e.dst, min(r.comp) FROM r JOIN e ON r.node = e.src JOIN recurring.r k ON k.node = e.dst
        WHERE r.comp < k.comp GROUP BY e.dst)
SELECT node, comp AS component FROM r""")
def connected_components(spark, sf):
    return G.connected_components(buy_edges(spark, sf))


@query("graph_bfs", f"""
WITH RECURSIVE e AS (SELECT src, dst FROM {BUY_EDGES_SQL} UNION SELECT dst, src FROM {BUY_EDGES_SQL}),
found(node, hops, path) USING KEY (node) AS (
  SELECT min(src), 0, [min(src)] FROM {BUY_EDGES_SQL}
  UNION
  SELECT e.dst, min(f.hops) + 1, min(list_append(f.path, e.dst)) FROM found f JOIN e ON e.src = f.node
  WHERE e.dst NOT IN (SELECT node FROM recurring.found) GROUP BY e.dst)
SELECT node, CAST(hops AS INTEGER) AS hops, path FROM found""")
def graph_bfs(spark, sf):
    """Shortest paths from the smallest customer node over the customer-part graph."""
    e = buy_edges(spark, sf)
    seeds = e.agg(F.min("src").alias("node"))
    return G.shortest_paths(e, seeds)


@query("graph_neighbors", f"""
WITH e AS {BUY_EDGES_SQL}, s AS (SELECT min(src) AS node FROM e)
SELECT dst AS neighbor, 'out' AS direction FROM e WHERE src = (SELECT node FROM s)
UNION SELECT src, 'in' FROM e WHERE dst = (SELECT node FROM s)""")
def graph_neighbors(spark, sf):
    e = buy_edges(spark, sf)
    seed = e.agg(F.min("src")).first()[0]  # one scalar
    return H.neighbors(e, seed)


# Directed trade graph between nations: customer nation -> supplier nation.
TRADE_EDGES_SQL = """(SELECT DISTINCT CAST(c.c_nationkey AS VARCHAR) AS src, CAST(s.s_nationkey AS VARCHAR) AS dst
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def trade_edges(spark, sf):
    li = tbl(spark, sf, "lineitem")
    o, c, s = tbl(spark, sf, "orders"), tbl(spark, sf, "customer"), tbl(spark, sf, "supplier")
    j = (li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
           .join(s, li["l_suppkey"] == s["s_suppkey"]))
    return j.select(F.col("c_nationkey").cast("string").alias("src"),
                    F.col("s_nationkey").cast("string").alias("dst")).distinct()


@query("has_cycle", f"""
WITH RECURSIVE e AS {TRADE_EDGES_SQL},
reach(s, d) AS (SELECT src, dst FROM e UNION SELECT reach.s, e.dst FROM reach JOIN e ON reach.d = e.src),
cyc AS (SELECT DISTINCT s AS node FROM reach WHERE s = d)
SELECT node FROM cyc UNION SELECT d FROM reach WHERE s IN (SELECT node FROM cyc)""")
def has_cycle_q(spark, sf):
    return G.cycle_nodes(trade_edges(spark, sf))


# A customer leads to its nation, a nation to its suppliers, a supplier to the nations and parts it sells.
FLOW_EDGES_SQL = """(SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM customer
  UNION SELECT DISTINCT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION SELECT DISTINCT 's' || CAST(l.l_suppkey AS VARCHAR), 'n' || CAST(c.c_nationkey AS VARCHAR)
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_linenumber = 1
  UNION SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem)"""


@query("nodes_on_cycles", f"""
WITH RECURSIVE e AS {FLOW_EDGES_SQL},
core AS (SELECT * FROM e WHERE src[1] <> 'c' AND dst[1] <> 'p'),
reach(s, d) AS (SELECT src, dst FROM core UNION SELECT reach.s, core.dst FROM reach JOIN core ON reach.d = core.src)
SELECT s AS node FROM reach WHERE s = d""")
def nodes_on_cycles(spark, sf):
    """Nations and suppliers that trade in a circle; customers lead into circles, parts hang from them."""
    c, s, o, li = (tbl(spark, sf, t) for t in ("customer", "supplier", "orders", "lineitem"))
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    sold = li.where("l_linenumber = 1").join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    edges = [c.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst")), s.select(name("n", "s_nationkey"), name("s", "s_suppkey")),
             sold.select(name("s", "l_suppkey"), name("n", "c_nationkey")), li.select(name("s", "l_suppkey"), name("p", "l_partkey"))]
    return G.nodes_on_cycles(edges[0].union(edges[1]).union(edges[2]).union(edges[3]))


@query("inferred_edges")
def inferred_edges(spark, sf):
    """Name-similarity edges over all given tables, upgraded by the value
    overlap of the matched columns (full distinct values, no sampling)."""
    tables = {t: tbl(spark, sf, t) for t in ALL_TABLES}
    cols = catalog_columns(spark, tables).withColumn("connector", F.col("table_name"))
    return H.infer_edges(tables, cols)


def _nodes_sql():
    counts = "\n    UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES)
    return f"""
WITH fp AS ({FINGERPRINT_SQL}),
nc AS (SELECT table_name, CAST(count(DISTINCT column_name) AS INTEGER) AS column_count
       FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in ALL_TABLES)})
       GROUP BY table_name),
rc AS ({counts})
SELECT substring(sha1('files:' || fp.table_name), 1, 16) AS node_id, fp.table_name AS name,
       'files' AS connector, 'table' AS kind, nc.column_count, fp.fingerprint, rc.row_count
FROM fp JOIN nc USING (table_name) JOIN rc USING (table_name)"""


@query("graph_nodes", _nodes_sql())
def graph_nodes(spark, sf):
    return H.graph_nodes(spark, {t: tbl(spark, sf, t) for t in ALL_TABLES})
