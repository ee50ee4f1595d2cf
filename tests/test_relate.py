"""Golden values for name similarity and resolution, brute-force checks of the
similarity join, the graph iterations and fuzzy dedupe."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tablemove.functions.expressions import round_half_even, similarity_ratio
from tablemove.operators import graph as G
from tablemove.operators import relate as H
from tablemove.operators.fuzzy import fuzzy_dedupe
from tablemove.operators.similarity import similar_pairs


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j in range(1, len(b) + 1):
            new.append(row[j - 1] + 1 if b[j - 1] == ch else max(row[j], new[j - 1]))
        row = new
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * lcs(a, b) / (len(a) + len(b))


# Fixture schemas of the object-storage and warehouse mocks (column order kept).
OBJECT_STORAGE = {
    "orders.parquet": ["order_id", "customer_id", "order_date", "status", "total_amount", "currency", "region"],
    "customers.parquet": ["cust_id", "first_name", "last_name", "email", "phone", "country", "created_at"],
    "products.json": ["product_id", "sku", "name", "category", "price", "stock_quantity"],
}
WAREHOUSE = {
    "dim_customer": ["customer_id", "customer_key", "full_name", "email", "phone", "country_code", "segment",
                     "lifetime_value", "is_active", "created_at", "updated_at"],
    "fact_orders": ["order_id", "customer_id", "product_id", "order_date", "ship_date", "quantity", "unit_price",
                    "discount", "total_amount", "status", "region"],
    "dim_product": ["product_id", "sku", "product_name", "category", "subcategory", "brand", "cost_price",
                    "sell_price", "is_discontinued"],
}


def _cols(spark, groups):
    rows = [(conn, t, c, i + 1) for conn, tables in groups.items() for t, cs in tables.items()
            for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "connector string, table_name string, column_name string, ordinal int")


def test_similarity_ratio_matches_python(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcde_") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    pairs = [(a, b) for a, b in zip(words, reversed(words))]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["r"] for r in df.select(similarity_ratio("a", "b").alias("r")).collect()]
    assert got == [pytest.approx(ratio(a, b)) for a, b in pairs]


def test_round_half_even_like_python(spark):
    vals = [0.875 * 0.9, 0.7875, 2.675, 0.6305, 0.1235, 0.9 * 0.9] + [2 * a / b * 0.9 for a in range(1, 12)
                                                                      for b in range(2 * a, 30)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["r"] for r in df.select(round_half_even("x", 3).alias("r")).collect()]
    assert got == [round(v, 3) for v in vals]


def test_similar_pairs_exact_against_brute_force(spark):
    rnd = random.Random(11)
    alpha = "abcdefg"
    left = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 10))) for _ in range(120)]
    right = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 10))) for _ in range(120)]
    for t in (0.6, 0.7, 0.85):
        got = {(r["a"], r["b"]) for r in similar_pairs(spark.createDataFrame([(x,) for x in left], "name string"),
                                                        spark.createDataFrame([(x,) for x in right], "name string"),
                                                        t).collect()}
        want = {(a, b) for a in set(left) for b in set(right) if ratio(a, b) >= t - 1e-12}
        assert got == want


def test_name_edges_golden_fixture_schemas(spark):
    cols = _cols(spark, {"object_storage": OBJECT_STORAGE, "warehouse": WAREHOUSE})
    got = {(r["source_table"], r["target_table"]): (r["confidence"], r["source_column"], r["target_column"])
           for r in H.name_edges(cols).collect()}
    assert got == {
        ("orders.parquet", "dim_customer"): (0.9, "customer_id", "customer_id"),
        ("orders.parquet", "fact_orders"): (0.9, "order_id", "order_id"),
        ("customers.parquet", "dim_customer"): (0.9, "email", "email"),
        ("customers.parquet", "fact_orders"): (0.675, "cust_id", "customer_id"),
        ("products.json", "fact_orders"): (0.9, "product_id", "product_id"),
        ("products.json", "dim_product"): (0.9, "product_id", "product_id"),
    }


def test_name_edges_golden_star_schema(spark):
    from tablemove.queries.sources_q import STAR_COLUMNS
    cols = _cols(spark, {t: {t: c} for t, c in STAR_COLUMNS.items()})
    got = {(r["source_table"], r["target_table"]): (r["confidence"], r["source_column"], r["target_column"])
           for r in H.name_edges(cols).collect()}
    assert got[("customer", "orders")] == (0.787, "c_custkey", "o_custkey")
    assert got[("customer", "nation")] == (0.81, "c_nationkey", "n_nationkey")
    assert got[("customer", "supplier")] == (0.81, "c_nationkey", "s_nationkey")
    assert got[("lineitem", "orders")] == (0.8, "l_orderkey", "o_orderkey")
    assert got[("lineitem", "supplier")] == (0.787, "l_suppkey", "s_suppkey")
    assert ("lineitem", "nation") not in got


def test_resolve_names_golden(spark):
    names = ["fact_orders", "Fact_Orders", "dim_customers", "customer", "customers", "products", "orders", "xyz"]
    cands = list(OBJECT_STORAGE) + list(WAREHOUSE)
    res = H.resolve_names(spark.createDataFrame([(n,) for n in names], "entity string"),
                          spark.createDataFrame([(c, c) for c in cands], "name string, qualified_name string"))
    got = {r["entity"]: (r["resolved_name"], r["confidence"], r["needs_confirmation"]) for r in res.collect()}
    assert got == {
        "fact_orders": ("fact_orders", 1.0, False),
        "Fact_Orders": ("fact_orders", 0.95, False),
        "dim_customers": ("dim_customer", 0.96, False),
        "customer": ("dim_customer", 0.8, True),
        "customers": ("dim_customer", 0.762, True),
        "products": ("products.json", 0.762, True),
        "orders": ("fact_orders", 0.706, True),
        "xyz": (None, 0.0, True),
    }


def test_check_joins_unverified_gets_070(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "explicit", "x", "y", 1.0, "fk", False)],
                                  ", ".join(f"{c} {t}" for c, t in zip(H.EDGE_COLUMNS, [
                                      "string"] * 6 + ["double", "string", "boolean"])))
    joins = spark.createDataFrame([("b", "a", "y", "x"), ("a", "b", "x", "z")],
                                  "left_table string, right_table string, left_key string, right_key string")
    got = {(r["left_key"], r["right_key"]): (r["confidence"], r["needs_confirmation"])
           for r in H.check_joins(joins, edges).collect()}
    assert got == {("y", "x"): (1.0, False), ("x", "z"): (0.7, True)}


# ------------------------------------------------------------------- graphs

def _random_graph(seed, n=60, m=70):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}") for _ in range(m)]


def test_connected_components_brute_force(spark):
    edges = _random_graph(5)
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    want = {}
    for start in adj:
        if start in want:
            continue
        comp, q = {start}, deque([start])
        while q:
            for v in adj[q.popleft()]:
                if v not in comp:
                    comp.add(v)
                    q.append(v)
        for v in comp:
            want[v] = min(comp)
    got = {r["node"]: r["component"] for r in G.connected_components(
        spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want


def test_shortest_paths_brute_force(spark):
    edges = _random_graph(9, 40, 60)
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    src = min(adj)
    best = {src: [src]}
    frontier = [src]
    while frontier:
        cand = {}
        for u in frontier:
            for v in adj[u]:
                if v not in best:
                    p = best[u] + [v]
                    cand[v] = min(cand.get(v, p), p)
        best.update(cand)
        frontier = list(cand)
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(src,)], "node string")
    got = {r["node"]: (r["hops"], list(r["path"])) for r in G.shortest_paths(df, seeds).collect()}
    assert got == {v: (len(p) - 1, p) for v, p in best.items()}


def test_cycle_nodes_brute_force(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "a"), ("f", "g")]
    got = {r["node"] for r in G.cycle_nodes(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a", "b", "c", "d"}
    acyclic = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert G.has_cycle(acyclic).collect()[0]["has_cycle"] is False


def test_fuzzy_dedupe_brute_force(spark):
    base = ["the quick brown fox jumps over the lazy dog again and again today",
            "an entirely different sentence about data migration between two systems",
            "short text"]
    near = base[0].replace("today", "tonight")  # one changed word of twelve
    rows = [(1, base[0]), (2, base[1]), (3, base[0]), (4, base[2]), (5, near), (6, base[2]), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in fuzzy_dedupe(df, "doc_id", "text", threshold=0.5, shingle=2).collect())
    assert kept == [1, 2, 4, 7]


def test_fuzzy_dedupe_collapses_all_exact_copies(spark):
    from conftest import SF_SMALL
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = fuzzy_dedupe(docs, "doc_id", "text")
    assert kept.groupBy("text").count().filter("count > 1").count() == 0
    firsts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    # every kept document is the smallest id of its exact-copy group
    assert kept.join(firsts, ["doc_id", "text"], "left_anti").count() == 0


def test_inferred_edges_value_upgrade(spark):
    from conftest import SF_SMALL
    from tablemove.queries import QUERIES
    got = {(r["source_table"], r["target_table"]): (r["kind"], r["confidence"])
           for r in QUERIES["inferred_edges"](spark, SF_SMALL).collect()}
    # 0.4 * 0.787 + 0.6 * 1.0 (every customer has an order) = 0.9148 -> 0.915
    assert got[("customer", "orders")] == ("inferred_value", 0.915)
    import duckdb
    a, b, both = duckdb.sql(f"""
        SELECT (SELECT count(DISTINCT l_orderkey) FROM '{SF_SMALL}/lineitem.parquet'),
               (SELECT count(DISTINCT o_orderkey) FROM '{SF_SMALL}/orders.parquet'),
               (SELECT count(*) FROM (SELECT l_orderkey FROM '{SF_SMALL}/lineitem.parquet' INTERSECT
                                      SELECT o_orderkey FROM '{SF_SMALL}/orders.parquet'))""").fetchall()[0]
    jac = both / (a + b - both)
    assert got[("lineitem", "orders")] == ("inferred_value", round(0.4 * 0.8 + 0.6 * jac, 3))
    assert got[("customer", "part")][0] == "inferred_name"


def test_graph_bfs_query_brute_force(spark):
    import duckdb
    from conftest import SF_SMALL
    from tablemove.queries import QUERIES
    edges = duckdb.sql(f"""SELECT DISTINCT 'c' || CAST(o.o_custkey AS VARCHAR), 'p' || CAST(l.l_partkey AS VARCHAR)
        FROM '{SF_SMALL}/lineitem.parquet' l JOIN '{SF_SMALL}/orders.parquet' o ON l.l_orderkey = o.o_orderkey""").fetchall()
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    src = min(a for a, _ in edges)
    best, frontier = {src: [src]}, [src]
    while frontier:
        cand = {}
        for u in frontier:
            for v in adj[u]:
                if v not in best:
                    p = best[u] + [v]
                    cand[v] = min(cand.get(v, p), p)
        best.update(cand)
        frontier = list(cand)
    got = {r["node"]: (r["hops"], list(r["path"])) for r in QUERIES["graph_bfs"](spark, SF_SMALL).collect()}
    assert got == {v: (len(p) - 1, p) for v, p in best.items()}


def test_name_edges_skip_existing_pairs_both_directions(spark):
    cols = _cols(spark, {"object_storage": OBJECT_STORAGE, "warehouse": WAREHOUSE})
    existing = spark.createDataFrame([("fact_orders", "orders.parquet")], "source_table string, target_table string")
    got = {(r["source_table"], r["target_table"]) for r in H.name_edges(cols, existing=existing).collect()}
    assert ("orders.parquet", "fact_orders") not in got and ("orders.parquet", "dim_customer") in got


def test_explicit_edges_composite_and_unknown_targets(spark):
    fks = spark.createDataFrame([
        ("bseg", "mandt", "bkpf.mandt", "fk1"), ("bseg", "belnr", "bkpf.belnr", "fk1"),
        ("bseg", "kunnr", "kna1.kunnr", "fk2"), ("bseg", "x", "db.schema.missing.x", "fk3")],
        "table_name string, column_name string, foreign_key string, constraint string")
    tables = spark.createDataFrame([("bseg",), ("bkpf",), ("kna1",)], "table_name string")
    rows = H.explicit_edges(fks, tables).collect()
    ids = {(r["source_column"], r["target_table"]): r["edge_id"] for r in rows}
    assert set(ids) == {("mandt", "bkpf"), ("belnr", "bkpf"), ("kunnr", "kna1")}   # unknown target skipped
    assert ids[("mandt", "bkpf")] == ids[("belnr", "bkpf")] != ids[("kunnr", "kna1")]
    assert all(r["confidence"] == 1.0 and r["kind"] == "explicit" and not r["needs_confirmation"] for r in rows)


def test_auto_join_refuses_unconfirmed_weak_edge(spark):
    cols = ", ".join(f"{c} {t}" for c, t in zip(H.EDGE_COLUMNS, ["string"] * 6 + ["double", "string", "boolean"]))
    edges = spark.createDataFrame([("e1", "a", "b", "explicit", "k", "k", 1.0, "", False),
                                   ("e2", "b", "c", "inferred_name", "j", "j", 0.75, "", True)], cols)
    tables = {"a": spark.createDataFrame([(1, "x")], "k int, av string"),
              "b": spark.createDataFrame([(1, 7)], "k int, j int"),
              "c": spark.createDataFrame([(7, "z")], "j int, cv string")}
    with pytest.raises(ValueError, match="confirmation"):
        G.auto_join(tables, edges, ["a", "c"])
    out = G.auto_join(tables, edges, ["a", "c"], confirmed=(("b", "c"),))
    assert [tuple(r) for r in out.collect()] == [(1, "x", 7, "z")]
