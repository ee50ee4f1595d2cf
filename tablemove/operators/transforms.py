"""Named transforms: dedupe, mask, type cast, custom expression, SCD 1/2, and
the ``op`` registry that a migration spec dispatches through."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import pivot, with_expr

# --------------------------------------------------------------- dedupe


def dedupe(df: DataFrame, keys: Sequence[str], order_col: str | Sequence[str] = "updated_at",
           tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """Keep the newest row per key (``order_col`` descending, then ``tiebreak`` descending).

    Planned as ``row_number() = 1`` over a window; Spark inserts a
    ``WindowGroupLimit`` below the shuffle so each map task already keeps only
    its local top row per key -- a hot key does not ship all its rows.
    Empty ``keys`` raise (D9).
    """
    if not keys:
        raise ValueError("dedupe needs at least one key column")
    orders = [order_col] if isinstance(order_col, str) else list(order_col)
    ocols = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last()
             for c in list(orders) + list(tiebreak)]
    w = Window.partitionBy(*keys).orderBy(*ocols)
    return (df.withColumn("_tm_rn", F.row_number().over(w))
              .filter(F.col("_tm_rn") == 1).drop("_tm_rn"))


# ------------------------------------------------------------- mask

MASK_STRATEGIES = ("hash", "nullify", "tokenize")
# Fixed value: prefix of tokenized values.
TOKEN_PREFIX = "TOKEN_"


def mask_column(c: Column, strategy: str, dtype: str) -> Column:
    if strategy == "hash":
        return F.sha2(c.cast("string"), 256)
    if strategy == "nullify":
        return F.lit(None).cast(dtype)
    if strategy == "tokenize":
        return F.concat(F.lit(TOKEN_PREFIX), F.md5(c.cast("string")))
    raise ValueError(f"unknown mask strategy {strategy!r}; expected one of {MASK_STRATEGIES}")


def mask(df: DataFrame, columns: Sequence[str], strategy: str = "hash") -> DataFrame:
    """SHA-256 hex / typed NULL (D7) / ``TOKEN_`` + MD5 hex; NULL stays NULL."""
    types = dict(df.dtypes)
    for c in columns:
        if c not in types:
            raise ValueError(f"mask column {c!r} not in {df.columns}")
    return df.withColumns({c: mask_column(F.col(c), strategy, types[c]) for c in columns})


# --------------------------------------------------------------- cast (E5)

def type_cast(df: DataFrame, casts: dict[str, str], on_error: str = "fail") -> DataFrame:
    """E5: cast columns; ``on_error="null"`` uses ``try_cast`` (ANSI casts raise)."""
    if on_error not in ("fail", "null"):
        raise ValueError("on_error must be 'fail' or 'null'")
    out = {}
    for c, t in casts.items():
        out[c] = F.col(c).cast(t) if on_error == "fail" else F.col(c).try_cast(t)
    return df.withColumns(out)


# ------------------------------------------------------------ SCD

def split_unique_source(source: DataFrame, keys: Sequence[str], what: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a full non-NULL key, rows with a NULL key part).

    The keyed rows are collapsed by an aggregate on the keys (partial
    aggregation on the map side -- sort-based, since the carried row is a
    struct -- so a hot key never lands whole in one task)
    and a count > 1 fails the job with ``<what>: duplicate source key``.  The
    result comes out hash-partitioned on the keys, so a following join on the
    same keys reuses that partitioning.  NULL-key rows never match anything
    (D15) and are returned apart, unchanged.
    """
    all_keys = F.lit(True)
    for k in keys:
        all_keys = all_keys & F.col(k).isNotNull()
    others = [c for c in source.columns if c not in keys]
    msg = F.concat(F.lit(f"{what}: duplicate source key "), F.to_json(F.struct(*keys)))
    agg = [F.count(F.lit(1)).alias("_tm_n")]
    if others:
        agg.append(F.any_value(F.struct(*others)).alias("_tm_row"))
    keyed = (source.filter(all_keys).groupBy(*keys).agg(*agg)
                   .filter(F.when(F.col("_tm_n") > 1, F.raise_error(msg)).otherwise(F.lit(True))))
    keyed = keyed.select(*keys, *([F.col("_tm_row." + c).alias(c) for c in others])).select(*source.columns)
    return keyed, source.filter(~all_keys)


def _check_unique_source(source: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``split_unique_source`` with both parts unioned again."""
    keyed, nulls = split_unique_source(source, keys, what)
    return keyed.unionByName(nulls)


def scd2(target: DataFrame | None, source: DataFrame, keys: Sequence[str], tracked: Sequence[str],
         effective_at, valid_from: str = "valid_from", valid_to: str = "valid_to",
         is_current: str = "is_current", ts_type: str = "timestamp_ntz") -> DataFrame:
    """SCD type 2.  Closed history passes through; a current row whose
    tracked columns changed is closed at ``effective_at`` and a new current
    version opened; new keys open a version; unchanged rows stay.

    One left join of current rows against the (small, key-unique) source plus
    one anti join for new keys -- both joins AQE can split for skew, and the
    source side can be broadcast under Spark's size threshold.
    """
    eff = F.lit(effective_at).cast(ts_type) if not isinstance(effective_at, Column) else effective_at
    src, src_nulls = split_unique_source(source, keys, "scd2")
    data_cols = [c for c in source.columns]
    if target is None:
        return src.unionByName(src_nulls).select(
            *[F.col(c) for c in data_cols], eff.alias(valid_from), F.lit(None).cast(ts_type).alias(valid_to),
            F.lit(True).alias(is_current))
    bcols = [c for c in target.columns if c not in (valid_from, valid_to, is_current)]
    missing = [c for c in data_cols if c not in bcols]
    if missing:
        raise ValueError(f"scd2: source columns {missing} not in target")
    hist = target.filter(~F.col(is_current))
    cur = target.filter(F.col(is_current))

    s = src.select(*[F.col(c).alias(f"_s_{c}") for c in data_cols], F.lit(True).alias("_s_hit"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")
        cond = c if cond is None else cond & c
    j = cur.join(s, cond, "left")
    changed = F.lit(False)
    for c in tracked:
        changed = changed | (F.col("_s_hit").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_s_{c}")))
    out_cols = bcols + [valid_from, valid_to, is_current]
    keep = F.struct(*[F.col(c).alias(c) for c in out_cols])
    closed = F.struct(*[F.col(c).alias(c) for c in bcols],
                      F.col(valid_from).alias(valid_from), eff.alias(valid_to),
                      F.lit(False).alias(is_current))
    opened = F.struct(*[(F.col(f"_s_{c}") if c in data_cols else F.col(c)).alias(c) for c in bcols],
                      eff.alias(valid_from), F.lit(None).cast(ts_type).alias(valid_to),
                      F.lit(True).alias(is_current))
    cur_out = (j.select(F.explode(F.when(changed, F.array(closed, opened)).otherwise(F.array(keep))).alias("_r"))
                .select("_r.*"))
    new_keys = src.join(cur.select(*keys), list(keys), "left_anti").unionByName(src_nulls)
    opened_new = new_keys.select(*[(F.col(c) if c in data_cols else F.lit(None).cast(dict(target.dtypes)[c])).alias(c)
                                   for c in bcols],
                                 eff.alias(valid_from), F.lit(None).cast(ts_type).alias(valid_to),
                                 F.lit(True).alias(is_current))
    return hist.select(*out_cols).unionByName(cur_out).unionByName(opened_new)


# ------------------------------------------------------------ registry (N)

_TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def register_transform(name: str, fn: Callable[..., DataFrame]) -> None:
    """Extension point: any ``DataFrame -> DataFrame`` function under an op name."""
    _TRANSFORMS[name] = fn


def apply_transform(df: DataFrame, op: str, params: dict | None = None) -> DataFrame:
    """Dispatch one spec transform; unknown ops raise."""
    params = dict(params or {})
    if op == "dedupe":
        return dedupe(df, params["keys"], params.get("order_col", "updated_at"),
                      params.get("tiebreak", ()))
    if op == "mask":
        return mask(df, params.get("columns", []), params.get("strategy", "hash"))
    if op == "type_cast":
        return type_cast(df, params.get("casts", {}), params.get("on_error", "fail"))
    if op == "custom_expr":
        return with_expr(df, params["expression"], params.get("alias", "custom_col"))
    if op == "pivot":
        return pivot(df, params.get("group_by"), params["pivot_col"], params.get("agg_col", "value"),
                     params.get("agg_fn", "sum"), params.get("values") or None)
    if op == "scd_merge":
        from ..sinks.merge import merge
        kind = int(params.get("type", 1))
        target = params.get("target")  # None = first load
        if kind == 1:
            return merge(target, df, params["keys"])
        return scd2(target, df, params["keys"], params.get("tracked", []), params["effective_at"])
    if op in _TRANSFORMS:
        return _TRANSFORMS[op](df, **params)
    raise ValueError(f"unknown transform op {op!r}")
