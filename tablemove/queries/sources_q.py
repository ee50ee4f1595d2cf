"""Sources: file formats, explicit schema, catalog tables, fixed-width records,
object listing, column catalog, statistics, samples (inventory section A)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sinks.files import write_files
from ..sources import catalog as C
from ..sources import scan as S
from ._registry import query, tbl


def _cast_like(df, like):
    """Cast a read-back frame to the original column types (text formats lose them)."""
    types = dict(like.dtypes)
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in like.columns])


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, sf):
    return S.scan(spark, os.path.join(sf, "orders.parquet"))


@query("scan_csv_roundtrip", "SELECT * FROM customer")
def scan_csv_roundtrip(spark, sf):
    src = tbl(spark, sf, "customer")
    path = scratch_path(spark, "roundtrip", "csv")
    write_files(src, path, "csv", "error", options={"header": "true"})
    return _cast_like(S.scan(spark, path, "csv"), src)


@query("scan_json_roundtrip", "SELECT * FROM orders")
def scan_json_roundtrip(spark, sf):
    src = tbl(spark, sf, "orders")
    path = scratch_path(spark, "roundtrip", "json")
    write_files(src, path, "json", "error")
    return _cast_like(S.scan(spark, path, "json"), src)


@query("scan_orc_roundtrip", "SELECT * FROM lineitem")
def scan_orc_roundtrip(spark, sf):
    src = tbl(spark, sf, "lineitem")
    path = scratch_path(spark, "roundtrip", "orc")
    write_files(src, path, "orc", "error")
    return S.scan(spark, path, "orc")


CUSTOMER_SUBSET = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_acctbal", T.DoubleType()),
])


@query("scan_with_schema", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_with_schema(spark, sf):
    return S.scan(spark, os.path.join(sf, "customer.parquet"), schema=CUSTOMER_SUBSET)


@query("scan_catalog_table", "SELECT * FROM nation")
def scan_catalog_table(spark, sf):
    name = "tm_nation_" + os.urandom(4).hex()
    tbl(spark, sf, "nation").createOrReplaceTempView(name)
    return S.scan_table(spark, name)


# Fixed-width layout of the customer round trip: (field, width).
CUSTOMER_LAYOUT = [("c_custkey", 12), ("c_name", 25), ("c_nationkey", 4), ("c_acctbal", 16), ("c_mktsegment", 12)]


@query("scan_fixed_width", "SELECT * FROM customer")
def scan_fixed_width(spark, sf):
    src = tbl(spark, sf, "customer")
    path = scratch_path(spark, "roundtrip", "fixed")
    S.to_fixed_width(src, CUSTOMER_LAYOUT).write.mode("error").text(path)
    return S.scan_fixed_width(spark, path, CUSTOMER_LAYOUT, casts=dict(src.dtypes))


@query("list_objects")
def list_objects(spark, sf):
    return C.list_objects(spark, sf)


# Column order of the star-schema tables as loaded (for the oracle SQL only).
STAR_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _catalog_sql():
    parts = []
    for t, cols in STAR_COLUMNS.items():
        for i, c in enumerate(cols):
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i + 1} AS ordinal, "
                         f"count({c}) AS n_values FROM {t}")
    return "\nUNION ALL ".join(parts)


def _star_tables(spark, sf):
    return {t: tbl(spark, sf, t) for t in STAR_COLUMNS}


@query("catalog_columns", _catalog_sql())
def catalog_columns(spark, sf):
    """Column catalog joined with per-column non-NULL counts (one aggregate per table)."""
    tables = _star_tables(spark, sf)
    cols = C.catalog_columns(spark, tables)
    counts = None
    for t, df in tables.items():
        one = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).select(
            F.lit(t).alias("table_name"),
            F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]),
                                        F.array(*[F.col(c) for c in df.columns]))).alias("column_name", "n_values"))
        counts = one if counts is None else counts.unionByName(one)
    return cols.join(counts, ["table_name", "column_name"]).select("table_name", "column_name", "ordinal", "n_values")


@query("source_stats", """
SELECT t AS table_name, n AS row_count FROM (
  SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
  UNION ALL SELECT 'customer', count(*) FROM customer)""")
def source_stats(spark, sf):
    paths = {t: os.path.join(sf, f"{t}.parquet") for t in ("orders", "lineitem", "customer")}
    return C.source_stats(spark, paths).select("table_name", "row_count")


@query("sample_values", """
SELECT DISTINCT o_custkey AS value FROM orders WHERE o_custkey IS NOT NULL ORDER BY value LIMIT 100""")
def sample_values(spark, sf):
    return C.sample_values(tbl(spark, sf, "orders"), "o_custkey", 100)
