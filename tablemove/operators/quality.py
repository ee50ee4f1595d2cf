"""Data-quality gates.

All checks of one call are evaluated as DataFrame aggregates; checks on the
same input share one aggregation pass (row count and every null fraction come
out of a single ``agg``).  The result is a small DataFrame
``check, column, value, threshold, passed``.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

CHECK_TYPES = ("row_count", "null_pct", "duplicate", "referential")
# Fixed value: default null-fraction threshold of a null_pct check.
DEFAULT_NULL_PCT = 0.95


class QualityError(RuntimeError):
    pass


def _row(check, column, value, threshold, passed):
    return F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"),
                    value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"),
                    passed.alias("passed"))


def quality(df: DataFrame, checks: Sequence[dict]) -> DataFrame:
    """Evaluate ``checks`` and return one row per (check, column).

    * ``{"type": "row_count", "min": 1}`` passes if count >= min
    * ``{"type": "null_pct", "column": "*"|name, "threshold": 0.95}`` passes if fraction <= threshold
    * ``{"type": "duplicate", "keys": [...], "threshold": 0}`` passes if duplicate keys <= threshold
    * ``{"type": "referential", "column": c, "ref": DataFrame, "ref_column": rc}``
      passes if orphans (non-NULL values without a parent) <= threshold
    """
    single = []   # expressions over the one global aggregate
    frames = []
    for ch in checks:
        t = ch.get("type")
        if t not in CHECK_TYPES:
            raise ValueError(f"unknown check type {t!r}; expected one of {CHECK_TYPES}")
        if t == "row_count":
            mn = ch.get("min", 1)
            single.append(("row_count", None, F.count(F.lit(1)), mn, ">="))
        elif t == "null_pct":
            col = ch.get("column", "*")
            thr = ch.get("threshold", DEFAULT_NULL_PCT)
            cols = df.columns if col == "*" else [col]
            for c in cols:
                single.append(("null_pct", c, F.avg(F.col(c).isNull().cast("double")), thr, "<="))
        elif t == "duplicate":
            keys = ch["keys"]
            thr = ch.get("threshold", 0)
            dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                     .agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("v")))
            frames.append(dup.select(_row("duplicate", ",".join(keys), F.col("v"), thr,
                                          F.col("v") <= F.lit(thr)).alias("r")))
        else:
            c, ref, rc = ch["column"], ch["ref"], ch.get("ref_column", ch["column"])
            thr = ch.get("threshold", 0)
            orphans = orphan_rows(df, c, ref, rc).withColumnRenamed("orphan_rows", "v")
            frames.append(orphans.select(_row("referential", c, F.col("v"), thr,
                                              F.col("v") <= F.lit(thr)).alias("r")))
    if single:
        g = df.agg(*[e.alias(f"_q{i}") for i, (_, _, e, _, _) in enumerate(single)])
        rows = []
        for i, (name, col, _, thr, op) in enumerate(single):
            v = F.coalesce(F.col(f"_q{i}").cast("double"), F.lit(0.0))
            passed = v >= F.lit(thr) if op == ">=" else v <= F.lit(thr)
            rows.append(_row(name, col, v, thr, passed))
        frames.insert(0, g.select(F.explode(F.array(*rows)).alias("r")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("r.*")


def orphan_rows(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """One row: child rows whose non-NULL ``column`` has no parent in ``ref``.

    Child keys are counted first (partial aggregation before the shuffle), so
    the anti join sees each distinct key once -- a key holding a third of the
    rows is one row there, not a skewed partition.
    """
    keys = (df.select(F.col(column).alias("_k")).filter(F.col("_k").isNotNull())
              .groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))
    missing = keys.join(ref.select(F.col(ref_column).alias("_k")), "_k", "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("orphan_rows"))


def orphan_counts(tables: dict[str, DataFrame], fks: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Orphan rows for many foreign keys ``(table, column, ref_table, ref_column)`` in one job.

    Every key column becomes ``(fk, integer key, text key)`` rows (keys that
    are integral on both sides stay numbers, others compare as text); child keys are counted
    map-side, parent keys made distinct, and a single anti join on
    ``(fk, key)`` finds the orphans for all foreign keys at once.
    """
    integral = ("tinyint", "smallint", "int", "bigint")

    def tagged(side: int) -> DataFrame:
        out = None
        for i, fk in enumerate(fks):
            t, c = fk[2 * side], fk[2 * side + 1]
            num = all(dict(tables[fk[s]].dtypes)[fk[s + 1]] in integral for s in (0, 2))
            one = tables[t].select(
                F.lit(i).alias("fk"),
                (F.col(c).cast("long") if num else F.lit(None).cast("long")).alias("kn"),
                (F.lit(None).cast("string") if num else F.col(c).cast("string")).alias("ks"))
            one = one.filter(F.col("kn").isNotNull() | F.col("ks").isNotNull())
            out = one if out is None else out.unionByName(one)
        return out

    child = tagged(0).groupBy("fk", "kn", "ks").agg(F.count(F.lit(1)).alias("_n"))
    parent = tagged(1).distinct()
    on = ((child["fk"] == parent["fk"]) & child["kn"].eqNullSafe(parent["kn"])
          & child["ks"].eqNullSafe(parent["ks"]))
    missing = child.join(parent, on, "left_anti").groupBy("fk").agg(F.sum("_n").alias("_o"))
    spark = next(iter(tables.values())).sparkSession
    meta = spark.createDataFrame([(i, *fk) for i, fk in enumerate(fks)],
                                 "fk int, table_name string, column_name string, ref_table string, ref_column string")
    return meta.join(missing, "fk", "left").select(
        "table_name", "column_name", "ref_table", "ref_column",
        F.coalesce(F.col("_o"), F.lit(0)).cast("long").alias("orphan_rows"))


def gate(df: DataFrame, checks: Sequence[dict], fail: bool = False) -> list:
    """Run the checks; raise on a failure if ``fail`` else log a warning.

    Returns the (small) list of result rows -- one per check, not data rows.
    """
    res = quality(df, checks).collect()
    bad = [r for r in res if not r["passed"]]
    if bad:
        msg = "; ".join(f"{r['check']}({r['column']})={r['value']} vs {r['threshold']}" for r in bad)
        if fail:
            raise QualityError(msg)
        log.warning("quality gate failed: %s", msg)
    return res
