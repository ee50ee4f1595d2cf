"""Transforms, SCD, CDC, quality checks (inventory sections E, I, A10-A12, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..session import scratch_path
from ..operators import transforms as X
from ..sinks.merge import merge
from ..sources import cdc
from ..sources.scan import next_watermark, scan_incremental
from ._registry import query, tbl

# ------------------------------------------------------------------ dedupe


@query("dedupe_latest", """
SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def dedupe_latest(spark, sf):
    return X.dedupe(tbl(spark, sf, "orders"), ["o_custkey"], "o_orderdate", tiebreak=["o_orderkey"])


# -------------------------------------------------------------------- mask

@query("mask_hash", """
SELECT c_custkey, sha256(CAST(c_name AS VARCHAR)) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def mask_hash(spark, sf):
    return X.mask(tbl(spark, sf, "customer"), ["c_name"], "hash")


@query("mask_nullify", """
SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment
FROM customer""")
def mask_nullify(spark, sf):
    return X.mask(tbl(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"], "nullify")


@query("mask_tokenize", """
SELECT 'TOKEN_' || md5(CAST(c_custkey AS VARCHAR)) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer""")
def mask_tokenize(spark, sf):
    return X.mask(tbl(spark, sf, "customer"), ["c_custkey"], "tokenize")


# -------------------------------------------------------------------- cast

@query("type_cast", """
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_custkey, o_orderstatus,
       CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
       o_orderpriority FROM orders""")
def type_cast(spark, sf):
    return X.type_cast(tbl(spark, sf, "orders"), {"o_orderkey": "int", "o_totalprice": "decimal(18,2)",
                                                  "o_orderdate": "date"})


@query("type_cast_try", """
SELECT c_custkey, TRY_CAST(c_name AS INTEGER) AS c_name, c_nationkey, c_acctbal,
       TRY_CAST(c_mktsegment AS DATE) AS c_mktsegment FROM customer""")
def type_cast_try(spark, sf):
    return X.type_cast(tbl(spark, sf, "customer"), {"c_name": "int", "c_mktsegment": "date"}, on_error="null")


@query("custom_expr", """
SELECT *, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem""")
def custom_expr(spark, sf):
    return X.apply_transform(tbl(spark, sf, "lineitem"), "custom_expr",
                             {"expression": "l_extendedprice * (1 - l_discount)", "alias": "revenue"})


def _add_margin(df, column: str, rate: float):
    return df.withColumn("margin", F.col(column) * F.lit(rate))


X.register_transform("add_margin", _add_margin)


@query("custom_transform", "SELECT *, o_totalprice * 0.25 AS margin FROM orders")
def custom_transform(spark, sf):
    return X.apply_transform(tbl(spark, sf, "orders"), "add_margin", {"column": "o_totalprice", "rate": 0.25})


# ------------------------------------------------------------ merge / SCD

MERGE_SOURCE_SQL = """(
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice * 2, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 10 = 0)"""

MERGE_RESULT_SQL = f"""
WITH src AS {MERGE_SOURCE_SQL}
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)
UNION ALL SELECT * FROM src"""


def merge_source(spark, sf):
    o = tbl(spark, sf, "orders").filter(F.col("o_orderkey") % 10 == 0).withColumn(
        "o_totalprice", F.col("o_totalprice") * 2)
    return o.unionByName(o.withColumn("o_orderkey", F.col("o_orderkey") + 1000000))


@query("merge_upsert", MERGE_RESULT_SQL)
def merge_upsert(spark, sf):
    return merge(tbl(spark, sf, "orders"), merge_source(spark, sf), ["o_orderkey"])


@query("scd1_merge", """
WITH src AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0
  UNION ALL
  SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0)
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM src)
UNION ALL SELECT * FROM src""")
def scd1_merge(spark, sf):
    c = tbl(spark, sf, "customer")
    s = c.filter(F.col("c_custkey") % 10 == 0)
    src = s.withColumn("c_acctbal", F.col("c_acctbal") + 100).unionByName(
        s.withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return X.apply_transform(src, "scd_merge", {"type": 1, "keys": ["c_custkey"], "target": c})


SCD2_SQL = """
WITH t AS (SELECT *, TIMESTAMP '2020-01-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
                  TRUE AS is_current FROM customer),
s AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal,
             CASE WHEN c_custkey % 8 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment
      FROM customer WHERE c_custkey % 4 = 0
      UNION ALL
      SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0),
chg AS (SELECT t.c_custkey FROM t JOIN s ON t.c_custkey = s.c_custkey
        WHERE t.c_mktsegment IS DISTINCT FROM s.c_mktsegment OR t.c_acctbal IS DISTINCT FROM s.c_acctbal)
SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM chg)
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, valid_from,
       TIMESTAMP '2024-01-01 00:00:00' AS valid_to, FALSE AS is_current
FROM t WHERE c_custkey IN (SELECT c_custkey FROM chg)
UNION ALL
SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current
FROM s WHERE c_custkey IN (SELECT c_custkey FROM chg) OR c_custkey NOT IN (SELECT c_custkey FROM t)"""


def scd2_inputs(spark, sf):
    c = tbl(spark, sf, "customer")
    target = X.scd2(None, c, ["c_custkey"], [], "2020-01-01 00:00:00")
    s = c.filter(F.col("c_custkey") % 4 == 0).withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 8 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")))
    src = s.unionByName(c.filter(F.col("c_custkey") % 10 == 0).withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return target, src


@query("scd2_merge", SCD2_SQL)
def scd2_merge(spark, sf):
    target, src = scd2_inputs(spark, sf)
    return X.scd2(target, src, ["c_custkey"], ["c_mktsegment", "c_acctbal"], "2024-01-01 00:00:00")


# ----------------------------------------------------------- incremental, CDC

@query("incremental_read", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'")
def incremental_read(spark, sf):
    return scan_incremental(tbl(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00")


@query("next_watermark", """
SELECT max(o_orderdate) AS next_watermark FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01 00:00:00'""")
def next_watermark_q(spark, sf):
    return next_watermark(scan_incremental(tbl(spark, sf, "orders"), "o_orderdate", "1998-01-01 00:00:00"),
                          "o_orderdate")


CDC_OLD_SQL = "(SELECT * FROM orders WHERE o_orderkey % 7 <> 0)"
CDC_NEW_SQL = """(SELECT o_orderkey, o_custkey,
   CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
   o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)"""


def cdc_pair(spark, sf):
    o = tbl(spark, sf, "orders")
    old = o.filter(F.col("o_orderkey") % 7 != 0)
    new = (o.filter(F.col("o_orderkey") % 13 != 0)
            .withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, F.lit("X"))
                        .otherwise(F.col("o_orderstatus"))))
    return old, new


@query("cdc_snapshot_diff", f"""
WITH old AS {CDC_OLD_SQL}, new AS {CDC_NEW_SQL}
SELECT n.*, 'insert' AS _op FROM new n WHERE n.o_orderkey NOT IN (SELECT o_orderkey FROM old)
UNION ALL
SELECT o.*, 'delete' AS _op FROM old o WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM new)
UNION ALL
SELECT n.*, 'update' AS _op FROM new n JOIN old o ON n.o_orderkey = o.o_orderkey
WHERE n.o_custkey IS DISTINCT FROM o.o_custkey OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus
   OR n.o_totalprice IS DISTINCT FROM o.o_totalprice OR n.o_orderdate IS DISTINCT FROM o.o_orderdate
   OR n.o_orderpriority IS DISTINCT FROM o.o_orderpriority""")
def cdc_snapshot_diff(spark, sf):
    old, new = cdc_pair(spark, sf)
    return cdc.cdc_snapshot_diff(old, new, ["o_orderkey"])


@query("cdc_apply", f"SELECT * FROM {CDC_NEW_SQL}")
def cdc_apply(spark, sf):
    # Applying the diff of (old -> new) to old must give new.  Each change gets
    # a sequence number; an older duplicate change per key must lose.
    # The change feed is stored first, as a CDC log would be, then applied.
    old, new = cdc_pair(spark, sf)
    changes = cdc.cdc_snapshot_diff(old, new, ["o_orderkey"]).withColumn("_seq", F.lit(2))
    stale = changes.withColumn("_seq", F.lit(1)).withColumn("o_orderstatus", F.lit("STALE"))
    feed = scratch_path(spark, "cdc_feed")
    changes.unionByName(stale).write.mode("error").parquet(feed)
    return cdc.cdc_apply(old, spark.read.parquet(feed), ["o_orderkey"], "_seq")


# ----------------------------------------------------------------- quality

@query("qc_row_count", """
SELECT 'row_count' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value,
       CAST(1 AS DOUBLE) AS threshold, count(*) >= 1 AS passed FROM orders""")
def qc_row_count(spark, sf):
    return Q.quality(tbl(spark, sf, "orders"), [{"type": "row_count", "min": 1}])


def _null_pct_sql():
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    src = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment
              FROM customer)"""
    parts = [f"""SELECT 'null_pct' AS "check", '{c}' AS "column",
       coalesce(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS value,
       CAST(0.1 AS DOUBLE) AS threshold,
       coalesce(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE <= 0.1 AS passed FROM {src} t"""
             for c in cols]
    return "\nUNION ALL\n".join(parts)


@query("qc_null_pct", _null_pct_sql())
def qc_null_pct(spark, sf):
    df = tbl(spark, sf, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return Q.quality(df, [{"type": "null_pct", "column": "*", "threshold": 0.1}])


@query("qc_duplicates", """
SELECT 'duplicate' AS "check", 'l_orderkey,l_linenumber' AS "column", CAST(coalesce(sum(n - 1), 0) AS DOUBLE) AS value,
       CAST(0 AS DOUBLE) AS threshold, coalesce(sum(n - 1), 0) <= 0 AS passed
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) g WHERE n > 1""")
def qc_duplicates(spark, sf):
    return Q.quality(tbl(spark, sf, "lineitem"), [{"type": "duplicate", "keys": ["l_orderkey", "l_linenumber"]}])


@query("qc_referential", """
SELECT 'referential' AS "check", 'l_partkey' AS "column", CAST(count(*) AS DOUBLE) AS value,
       CAST(0 AS DOUBLE) AS threshold, count(*) <= 0 AS passed
FROM lineitem l WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
UNION ALL
SELECT 'referential', 'o_custkey', CAST(count(*) AS DOUBLE), CAST(0 AS DOUBLE), count(*) <= 0
FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""")
def qc_referential(spark, sf):
    li, part = tbl(spark, sf, "lineitem"), tbl(spark, sf, "part")
    o, c = tbl(spark, sf, "orders"), tbl(spark, sf, "customer")
    a = Q.quality(li, [{"type": "referential", "column": "l_partkey", "ref": part, "ref_column": "p_partkey"}])
    b = Q.quality(o, [{"type": "referential", "column": "o_custkey", "ref": c.filter("c_acctbal > 0"),
                       "ref_column": "c_custkey"}])
    return a.unionByName(b)


# ------------------------------------------------------------ fuzzy

@query("fuzzy_dedupe")
def fuzzy_dedupe(spark, sf):
    from ..operators.fuzzy import fuzzy_dedupe as fd
    return fd(tbl(spark, sf, "documents"), "doc_id", "text", threshold=0.8)
