"""Sinks, staging, versioned publish, end-to-end migrations, run info
(inventory sections K, L, I6-I7)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..plans import migrate as M
from ..plans.runinfo import StepTracer, estimate_frame
from ..session import scratch_path
from ..sinks import snapshots as P
from ..sinks.files import write_files, write_table as write_catalog_table
from ._registry import query, tbl
from .transforms_q import MERGE_RESULT_SQL, SCD2_SQL, merge_source, scd2_inputs

# ---------------------------------------------------------------- migrations

FLAGSHIP_SPEC = {
    "operation": "transform",
    "source_tables": ["orders", "customer"],
    "target_table": "fact_orders",
    "joins": [{"left_table": "orders", "right_table": "customer", "left_key": "o_custkey",
               "right_key": "c_custkey", "join_type": "inner"}],
    "filters": [{"column": "o_orderstatus", "op": "neq", "value": "P"}],
    "transforms": [{"op": "mask", "params": {"columns": ["c_name"], "strategy": "hash"}},
                   {"op": "type_cast", "params": {"casts": {"o_totalprice": "decimal(18,2)"}}}],
    "output_columns": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                       "c_name", "c_mktsegment"],
    "checks": [{"type": "row_count", "min": 1}],
}

FLAGSHIP_SQL = """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, CAST(o.o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
       o.o_orderdate, sha256(CAST(c.c_name AS VARCHAR)) AS c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P'"""


def _paths(sf, *names):
    return {n: os.path.join(sf, f"{n}.parquet") for n in names}


def run_flagship(spark, sf):
    root = scratch_path(spark, "migrations")
    return M.run_migration(spark, FLAGSHIP_SPEC, _paths(sf, "orders", "customer"), root)


@query("migration_flagship", FLAGSHIP_SQL)
def migration_flagship(spark, sf):
    return run_flagship(spark, sf)["frame"]


@query("migration_copy", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def migration_copy(spark, sf):
    spec = {"operation": "copy", "source_tables": ["orders"], "target_table": "orders_copy",
            "filters": [{"column": "o_orderstatus", "op": "neq", "value": "P"}]}
    return M.run_migration(spark, spec, _paths(sf, "orders"), scratch_path(spark, "migrations"))["frame"]


@query("migration_transform", """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, upper(o.o_orderpriority) AS priority,
       CAST(o.o_orderdate AS DATE) AS order_date, l.l_extendedprice * (1 - l.l_discount) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag IN ('A', 'R') AND o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""")
def migration_transform(spark, sf):
    spec = {"operation": "transform", "source_tables": ["lineitem", "orders"], "target_table": "revenue",
            "joins": [{"left_table": "lineitem", "right_table": "orders", "left_key": "l_orderkey",
                       "right_key": "o_orderkey"}],
            "filters": [{"column": "l_returnflag", "op": "in", "value": ["A", "R"]},
                        "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'"],
            "transforms": [{"op": "custom_expr", "params": {"expression": "l_extendedprice * (1 - l_discount)",
                                                            "alias": "revenue"}}],
            "column_mappings": [
                {"source_column": "l_orderkey", "target_column": "order_id"},
                {"source_column": "l_linenumber", "target_column": "line"},
                {"source_column": "o_orderpriority", "target_column": "priority", "transform": "UPPER({{source}})"},
                {"source_column": "o_orderdate", "target_column": "order_date", "transform": "CAST({{source}} AS DATE)"},
                {"source_column": "revenue", "target_column": "revenue"}]}
    return M.run_migration(spark, spec, _paths(sf, "lineitem", "orders"), scratch_path(spark, "migrations"))["frame"]


@query("migration_merge", MERGE_RESULT_SQL)
def migration_merge(spark, sf):
    root = scratch_path(spark, "migrations")
    M.run_migration(spark, {"operation": "copy", "source_tables": ["orders"], "target_table": "orders_m"},
                    _paths(sf, "orders"), root)
    spec = {"operation": "merge", "source_tables": ["changes"], "target_table": "orders_m",
            "merge_keys": ["o_orderkey"]}
    return M.run_migration(spark, spec, {"changes": merge_source(spark, sf)}, root)["frame"]


@query("migration_dedupe", """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def migration_dedupe(spark, sf):
    spec = {"operation": "dedupe", "source_tables": ["orders"], "target_table": "latest_orders",
            "transforms": [{"op": "dedupe", "params": {"keys": ["o_custkey", "o_orderstatus"],
                                                       "order_col": "o_orderdate", "tiebreak": ["o_orderkey"]}}],
            "output_columns": ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]}
    return M.run_migration(spark, spec, _paths(sf, "orders"), scratch_path(spark, "migrations"))["frame"]


@query("migration_incremental", "SELECT * FROM orders")
def migration_incremental(spark, sf):
    root = scratch_path(spark, "migrations")
    first = {"operation": "copy", "source_tables": ["orders"], "target_table": "orders_inc",
             "filters": ["o_orderdate <= TIMESTAMP '1998-01-01 00:00:00'"]}
    M.run_migration(spark, first, _paths(sf, "orders"), root)
    inc = {"operation": "incremental", "source_tables": ["orders"], "target_table": "orders_inc",
           "incremental": {"orders": {"watermark_column": "o_orderdate",
                                      "last_watermark": "1998-01-01 00:00:00"}}}
    return M.run_migration(spark, inc, _paths(sf, "orders"), root)["frame"]


@query("migration_scd2", SCD2_SQL)
def migration_scd2(spark, sf):
    """SCD type 2 through specs: the first run opens every row, the second
    merges the changed source into the destination's current version."""
    root = scratch_path(spark, "migrations")
    _, src = scd2_inputs(spark, sf)

    def spec(effective_at):
        return {"operation": "transform", "source_tables": ["src"], "target_table": "dim_customer",
                "transforms": [{"op": "scd_merge", "params": {
                    "type": 2, "keys": ["c_custkey"], "tracked": ["c_mktsegment", "c_acctbal"],
                    "effective_at": effective_at}}]}
    M.run_migration(spark, spec("2020-01-01 00:00:00"), {"src": tbl(spark, sf, "customer")}, root)
    return M.run_migration(spark, spec("2024-01-01 00:00:00"), {"src": src}, root)["frame"]


@query("migration_auto_join", """
SELECT l.*, o.*, c.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'""")
def migration_auto_join(spark, sf):
    """Two sources and no joins in the spec: the join path and keys come from
    the verified foreign-key edges (C10 inside L1)."""
    from .graph_q import ALL_TABLES, verified_fk_edges
    edges = verified_fk_edges(spark, sf).filter(F.col("orphan_rows") == 0)
    spec = {"operation": "copy", "source_tables": ["lineitem", "customer"], "target_table": "lines_by_customer",
            "filters": [{"column": "c_mktsegment", "op": "eq", "value": "BUILDING"}]}
    tables = {t: os.path.join(sf, f"{t}.parquet") for t in ALL_TABLES}
    return M.run_migration(spark, spec, tables, scratch_path(spark, "migrations"), edges=edges)["frame"]


@query("migration_csv_source", "SELECT * FROM customer WHERE c_acctbal > 0")
def migration_csv_source(spark, sf):
    """The whole customer table as pipe-separated text, read by a spec that names format, options and schema."""
    src, path = tbl(spark, sf, "customer"), scratch_path(spark, "migrations", "csv")
    write_files(src, path, "csv", "error", options={"header": "true", "sep": "|"})
    spec = {"operation": "copy", "source_tables": ["customer"], "target_table": "customer_copy",
            "sources": {"customer": {"format": "csv", "path": path, "schema": src.schema, "options": {"sep": "|"}}},
            "filters": [{"column": "c_acctbal", "op": "gt", "value": 0}]}
    return M.run_migration(spark, spec, {}, scratch_path(spark, "migrations"))["frame"]


@query("migration_to_table", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def migration_to_table(spark, sf):
    """A catalog table as the destination, with its files below the shared root."""
    root = scratch_path(spark, "migrations")
    name = "tm_orders_" + root.rsplit("/", 1)[-1]
    spec = {"operation": "copy", "source_tables": ["orders"], "target_table": "orders",
            "filters": [{"column": "o_orderstatus", "op": "neq", "value": "P"}],
            "destination": {"type": "table", "name": name, "path": f"{root}/{name}"}}
    return M.run_migration(spark, spec, _paths(sf, "orders"), root)["frame"]


@query("migration_partitioned", "SELECT * FROM lineitem")
def migration_partitioned(spark, sf):
    """Files laid out by return flag as the destination."""
    root = scratch_path(spark, "migrations")
    spec = {"operation": "copy", "source_tables": ["lineitem"], "target_table": "lines",
            "destination": {"type": "files", "format": "orc", "path": f"{root}/lines", "partition_by": ["l_returnflag"]}}
    return M.run_migration(spark, spec, _paths(sf, "lineitem"), root)["frame"]


@query("migration_aggregate", """
SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n_orders, max(o.o_orderdate) AS last_order
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P'
GROUP BY c.c_mktsegment, o.o_orderpriority HAVING count(*) > 1""")
def migration_aggregate(spark, sf):
    """An aggregate step; the published table is laid out by market segment."""
    spec = {"operation": "transform", "source_tables": ["orders", "customer"], "target_table": "orders_by_segment",
            "joins": FLAGSHIP_SPEC["joins"], "filters": FLAGSHIP_SPEC["filters"], "partition_by": ["c_mktsegment"],
            "aggregate": {"group_by": ["c_mktsegment", "o_orderpriority"], "having": "n_orders > 1",
                          "aggs": [{"col": "*", "func": "count", "alias": "n_orders"},
                                   {"col": "o_orderdate", "func": "max", "alias": "last_order"}]},
            "output_columns": ["c_mktsegment", "o_orderpriority", "n_orders", "last_order"]}
    return M.run_migration(spark, spec, _paths(sf, "orders", "customer"), scratch_path(spark, "migrations"))["frame"]


@query("migration_union", """
SELECT DISTINCT id, nation FROM (SELECT c_custkey AS id, c_nationkey AS nation FROM customer
UNION ALL SELECT s_suppkey, s_nationkey FROM supplier)""")
def migration_union(spark, sf):
    """Two sources added up by column name, repeated rows once."""
    parties = {"customer": tbl(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation"),
               "supplier": tbl(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id")}
    spec = {"operation": "copy", "source_tables": ["customer", "supplier"], "target_table": "parties",
            "union": {"tables": ["supplier"], "distinct": True}}
    return M.run_migration(spark, spec, parties, scratch_path(spark, "migrations"))["frame"]


@query("estimate_cost", """
SELECT 'orders' AS source, count(*) AS rows FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'
UNION ALL SELECT 'customer', count(*) FROM customer""")
def estimate_cost(spark, sf):
    spec = {**FLAGSHIP_SPEC, "dry_run": True,
            "incremental": {"orders": {"watermark_column": "o_orderdate", "last_watermark": "1998-01-01 00:00:00"}}}
    return estimate_frame(spark, spec, _paths(sf, "orders", "customer")).select("source", "rows")


@query("step_metrics")
def step_metrics(spark, sf):
    tr = StepTracer()
    df = tr.traced(tbl(spark, sf, "orders"), "read_orders")
    df = tr.traced(df.filter(F.col("o_orderstatus") != "P"), "filter_status")
    path = scratch_path(spark, "steps")
    df.write.mode("error").parquet(path)
    tr.finish("read_orders")
    tr.finish("filter_status")
    return tr.metrics(spark)


# ------------------------------------------------------------------ writers

@query("write_partitioned", "SELECT * FROM orders")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "partitioned")
    write_files(tbl(spark, sf, "orders"), path, "parquet", "error", partition_by=["o_orderstatus"])
    return spark.read.parquet(path)


@query("write_table", "SELECT * FROM customer")
def write_table(spark, sf):
    name = "tm_customer_" + os.urandom(4).hex()
    path = scratch_path(spark, "tables", name)
    write_catalog_table(tbl(spark, sf, "customer"), name, "error", path=path)
    return spark.table(name)


@query("stage_roundtrip", "SELECT * FROM lineitem")
def stage_roundtrip(spark, sf):
    base = scratch_path(spark, "staging")
    st = P.stage(tbl(spark, sf, "lineitem"), base, "run1")
    return P.read_staged(spark, st["staging_path"])


# ------------------------------------------------------------------ publish

def _table(spark):
    return scratch_path(spark, "published")


@query("publish_overwrite", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def publish_overwrite(spark, sf):
    t, o = _table(spark), tbl(spark, sf, "orders")
    P.publish(spark, o, t, "overwrite")
    P.publish(spark, o.filter("o_orderstatus = 'F'"), t, "overwrite")
    return P.read_table(spark, t)


@query("publish_append", "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')")
def publish_append(spark, sf):
    t, o = _table(spark), tbl(spark, sf, "orders")
    P.publish(spark, o.filter("o_orderstatus = 'F'"), t, "overwrite")
    P.publish(spark, o.filter("o_orderstatus = 'O'"), t, "append")
    return P.read_table(spark, t)


@query("publish_merge", MERGE_RESULT_SQL)
def publish_merge(spark, sf):
    t = _table(spark)
    P.publish(spark, tbl(spark, sf, "orders"), t, "merge", merge_keys=["o_orderkey"])
    P.publish(spark, merge_source(spark, sf), t, "merge", merge_keys=["o_orderkey"])
    return P.read_table(spark, t)


@query("read_as_of", "SELECT * FROM orders")
def read_as_of(spark, sf):
    t, o = _table(spark), tbl(spark, sf, "orders")
    P.publish(spark, o, t, "overwrite")
    P.publish(spark, o.filter("o_orderstatus = 'F'"), t, "overwrite")
    return P.read_as_of(spark, t, 1)


@query("rollback", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def rollback(spark, sf):
    t, o = _table(spark), tbl(spark, sf, "orders")
    P.publish(spark, o.filter("o_orderstatus <> 'P'"), t, "overwrite")
    P.publish(spark, o.filter("o_orderstatus = 'F'"), t, "overwrite")
    P.rollback(spark, t, 1)
    return P.read_table(spark, t)


@query("publish_history")
def publish_history(spark, sf):
    t, o = _table(spark), tbl(spark, sf, "orders")
    P.publish(spark, o, t, "overwrite", spec={"step": 1})
    P.publish(spark, o.filter("o_orderstatus = 'F'"), t, "append", spec={"step": 2})
    P.rollback(spark, t, 1)
    return P.history_view(spark, t)


@query("publish_result")
def publish_result(spark, sf):
    base, t = scratch_path(spark, "staging"), _table(spark)
    st = P.stage(tbl(spark, sf, "orders"), base, "approve1")
    res = P.publish_run(spark, st, t, mode="overwrite")
    return spark.createDataFrame([res], "committed boolean, run_id string, rows_written long, "
                                        "destination string, mode string, version long")
