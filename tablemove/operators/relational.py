"""Filters, projections, joins, aggregates, pivots, unions, previews.

Every function maps DataFrame(s) to a DataFrame and only declares the plan;
Catalyst pushes filters into scans, prunes columns and picks the join strategy
(broadcast only under Spark's size-checked threshold, else sort-merge with AQE
skew splitting).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import template_expr

# ---------------------------------------------------------------- filters (B)

_OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "not_in",
        "is_null", "is_not_null", "like")


def where(df: DataFrame, predicate: str | Column) -> DataFrame:
    """B1: filter by a SQL predicate string (or a Column)."""
    return df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def clause_column(clause: dict) -> Column:
    """One structured clause ``{"column", "op", "value"}`` as a boolean Column.

    Values become typed literals (no string splicing), so quoting and
    injection are not an issue and Parquet/JDBC pushdown still applies.
    """
    col, op = clause["column"], clause.get("op", "eq")
    value = clause.get("value")
    if op not in _OPS:
        raise ValueError(f"unknown filter op {op!r}; expected one of {_OPS}")
    if value is None and op not in ("is_null", "is_not_null"):
        raise ValueError(f"op {op!r} on {col!r} needs a value; use is_null / is_not_null for NULL")
    c = F.col(col)
    if op in ("is_null", "is_not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if op in ("in", "not_in"):
        vals = list(value) if isinstance(value, (list, tuple, set)) else [value]
        cond = c.isin(vals)
        return ~cond if op == "not_in" else cond
    return {
        "eq": lambda: c == F.lit(value),
        "neq": lambda: c != F.lit(value),
        "gt": lambda: c > F.lit(value),
        "gte": lambda: c >= F.lit(value),
        "lt": lambda: c < F.lit(value),
        "lte": lambda: c <= F.lit(value),
        "like": lambda: c.like(str(value)),
    }[op]()


def where_clauses(df: DataFrame, clauses: Sequence[dict]) -> DataFrame:
    """One filter per clause, stacked (Catalyst merges them into one)."""
    for cl in clauses:
        df = df.filter(clause_column(cl))
    return df


# ------------------------------------------------------------ projection (B)

def project(df: DataFrame, items: Sequence[str | dict] | None) -> DataFrame:
    """Select plain columns or ``{"expr", "alias"}`` expressions.

    An empty/None list keeps every column.
    """
    if not items:
        return df
    cols = []
    for it in items:
        if isinstance(it, str):
            cols.append(F.col(it))
        else:
            e = F.expr(it["expr"])
            cols.append(e.alias(it["alias"]) if it.get("alias") else e)
    return df.select(*cols)


def map_columns(df: DataFrame, mappings: Sequence[dict]) -> DataFrame:
    """Rename source->target, optional template such as ``UPPER({{source}})``.

    Unmapped columns are dropped (mappings win over output columns).
    """
    cols = []
    for m in mappings:
        src, dst = m["source_column"], m.get("target_column") or m["source_column"]
        tmpl = m.get("transform")
        cols.append((template_expr(tmpl, src) if tmpl else F.col(src)).alias(dst))
    return df.select(*cols)


# ------------------------------------------------------------------ joins (C)

_HOW = {"inner": "inner", "left": "left", "left_outer": "left", "leftouter": "left",
        "right": "right", "right_outer": "right", "rightouter": "right",
        "full": "full", "outer": "full", "full_outer": "full", "fullouter": "full",
        "cross": "cross", "semi": "left_semi", "left_semi": "left_semi", "leftsemi": "left_semi",
        "anti": "left_anti", "left_anti": "left_anti", "leftanti": "left_anti"}


def _norm_keys(left_key, right_key, keys) -> list[tuple[str, str]]:
    if keys:
        return [tuple(k) if isinstance(k, (tuple, list)) else (k, k) for k in keys]
    if left_key is None and right_key is None:
        return []
    if left_key is None or right_key is None:
        raise ValueError("join needs both left_key and right_key")
    return [(left_key, right_key)]


def join(left: DataFrame, right: DataFrame, left_key: str | None = None,
         right_key: str | None = None, how: str = "inner", condition: str | None = None,
         keys: Sequence | None = None, suffix: str = "_r",
         left_alias: str = "l", right_alias: str = "r", skew_split_full: bool = True) -> DataFrame:
    """Equi-join on one or more key pairs with an optional residual predicate.

    Output names never clash (decision D6): a right-hand column whose name is
    already on the left gets ``suffix``; a same-named key equal on both sides
    is kept once (coalesced for full/right joins).  Missing keys raise (D3)
    unless the join is a cross join.

    A full outer join is planned as ``left LEFT JOIN right`` plus ``right
    LEFT ANTI left`` (``skew_split_full``): AQE's skew handling splits hot keys
    of outer and anti joins but not of full outer joins, so a key holding a
    third of the rows would otherwise sit in one task.  It costs one more scan
    of each side; pass ``skew_split_full=False`` for Spark's native plan.
    """
    how_n = _HOW.get(how.lower())
    if how_n is None:
        raise ValueError(f"unknown join type {how!r}")
    pairs = _norm_keys(left_key, right_key, keys)
    if not pairs and how_n != "cross":
        raise ValueError("join keys missing: give left_key/right_key or keys (or how='cross')")
    for lk, rk in pairs:
        if lk not in left.columns:
            raise ValueError(f"left key {lk!r} not in {left.columns}")
        if rk not in right.columns:
            raise ValueError(f"right key {rk!r} not in {right.columns}")

    l, r = left.alias(left_alias), right.alias(right_alias)
    cond = None
    for lk, rk in pairs:
        c = F.col(f"{left_alias}.{lk}") == F.col(f"{right_alias}.{rk}")
        cond = c if cond is None else cond & c
    if condition:
        c = F.expr(condition)
        cond = c if cond is None else cond & c
    if how_n in ("left_semi", "left_anti"):
        return l.join(r, on=cond, how=how_n).select(*[F.col(f"{left_alias}.{c}") for c in left.columns])

    # Output layout: left columns, then right columns renamed on clashes.
    shared_keys = {lk for lk, rk in pairs if lk == rk}
    taken, right_names = set(left.columns), {}
    for c in right.columns:
        if c in shared_keys:
            continue
        name = c if c not in taken else f"{c}{suffix}"
        while name in taken:
            name = f"{name}{suffix}"
        taken.add(name)
        right_names[c] = name

    def layout(key_from: str, left_missing: bool = False) -> list[Column]:
        ltypes = dict(left.dtypes)
        out = []
        for c in left.columns:
            if c in shared_keys:
                src = F.col(f"{key_from}.{c}")
            elif left_missing:
                src = F.lit(None).cast(ltypes[c])
            else:
                src = F.col(f"{left_alias}.{c}")
            out.append(src.alias(c))
        out += [F.col(f"{right_alias}.{c}").alias(n) for c, n in right_names.items()]
        return out

    if how_n == "cross" and cond is None:
        return l.crossJoin(r).select(*layout(left_alias))
    if how_n == "full" and skew_split_full:
        matched_or_left = l.join(r, on=cond, how="left").select(*layout(left_alias))
        right_only = r.join(l, on=cond, how="left_anti").select(*layout(right_alias, left_missing=True))
        return matched_or_left.unionByName(right_only)
    joined = l.join(r, on=cond, how=how_n)
    if how_n == "full":
        cols = layout(left_alias)
        cols[:len(left.columns)] = [
            F.coalesce(F.col(f"{left_alias}.{c}"), F.col(f"{right_alias}.{c}")).alias(c) if c in shared_keys
            else col for c, col in zip(left.columns, cols)]
        return joined.select(*cols)
    return joined.select(*layout(right_alias if how_n == "right" else left_alias))


def join_chain(base: DataFrame, specs: Sequence[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """Apply joins in order, each on the running result (fixes D2)."""
    df = base
    for s in specs:
        right = tables[s["right_table"]]
        df = join(df, right, s.get("left_key"), s.get("right_key"), s.get("join_type", "inner"),
                  s.get("condition"), s.get("keys"))
    return df


# ------------------------------------------------------------- aggregates (D)

# Aggregate names reachable from a spec.  Only pyspark aggregate functions.
_AGG_ALLOWED = {
    "sum", "avg", "mean", "min", "max", "count", "count_distinct", "countDistinct",
    "approx_count_distinct", "stddev", "stddev_samp", "stddev_pop", "variance",
    "var_samp", "var_pop", "collect_set", "collect_list", "median", "first", "last",
    "sum_distinct", "percentile_approx", "kurtosis", "skewness", "bool_and", "bool_or",
    "any_value", "max_by", "min_by", "count_if", "mode",
}


def agg_column(func: str, col: str | None, alias: str | None = None, args: Sequence = ()) -> Column:
    """One aggregate; ``args`` are the further arguments of two-argument
    aggregates (a column name for ``max_by``/``min_by``, a number for
    ``percentile_approx``)."""
    if func not in _AGG_ALLOWED:
        raise ValueError(f"aggregate {func!r} not allowed; choose from {sorted(_AGG_ALLOWED)}")
    fn = getattr(F, func)
    arg = F.lit(1) if (col in (None, "*") and func == "count") else F.col(col)
    c = fn(arg, *[F.col(a) if isinstance(a, str) else a for a in args])
    return c.alias(alias or f"{func}_{col}")


def aggregate(df: DataFrame, group_by: Sequence[str], aggs: Sequence[dict]) -> DataFrame:
    """GROUP BY with ``[{col, func, alias, args?}]``; empty group_by = global.

    Spark plans partial (map-side) + final hash aggregation, so a hot key is
    combined before the shuffle.
    """
    cols = [agg_column(a["func"], a.get("col"), a.get("alias"), a.get("args", ())) for a in aggs]
    return df.groupBy(*group_by).agg(*cols)


def pivot(df: DataFrame, group_by: Sequence[str] | None, pivot_col: str,
          agg_col: str = "value", agg_fn: str = "sum", values: Sequence | None = None) -> DataFrame:
    """Spread ``pivot_col`` into columns.  Give ``values`` to skip the distinct job."""
    if group_by is None:
        group_by = [c for c in df.columns if c not in (pivot_col, agg_col)]
    g = df.groupBy(*group_by)
    g = g.pivot(pivot_col, list(values)) if values is not None else g.pivot(pivot_col)
    if agg_fn not in _AGG_ALLOWED:
        raise ValueError(f"aggregate {agg_fn!r} not allowed")
    return g.agg(getattr(F, agg_fn)(F.col(agg_col)))


# ------------------------------------------------------------- set ops (F)

def union(dfs: Iterable[DataFrame], distinct: bool = False, allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name over n inputs, optionally distinct."""
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union needs at least one input")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out.distinct() if distinct else out


# ------------------------------------------------------ preview / windows (G)

def preview(df: DataFrame, n: int = 100, order_by: Sequence[str] | None = None) -> DataFrame:
    """G1: first n rows; with ``order_by`` a TakeOrdered top-k (a limit is the feature here)."""
    if order_by:
        return df.orderBy(*[_order(o) for o in order_by]).limit(n)
    return df.limit(n)


def _order(spec: str) -> Column:
    m = re.match(r"^\s*(\S+)\s*(asc|desc)?\s*$", spec, re.I)
    if not m:
        return F.expr(spec)
    c = F.col(m.group(1))
    return c.desc() if (m.group(2) or "").lower() == "desc" else c.asc()


def with_expr(df: DataFrame, expression: str, alias: str = "custom_col") -> DataFrame:
    """Add or replace one column from a SQL expression (window expressions included)."""
    return df.withColumn(alias, F.expr(expression))
