"""Key-based merge (upsert) as a DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.transforms import split_unique_source


def merge(target: DataFrame | None, source: DataFrame, keys: Sequence[str],
          overwrite_schema: bool = False) -> DataFrame:
    """Upsert ``source`` into ``target`` on ``keys`` (all compared with ``=``).

    Matched target rows take every source column; target-only columns keep
    their value.  Unmatched source rows are inserted.  NULL keys never match
    (D15).  Duplicate non-NULL source keys fail the job.  With no target the
    source is the first version.

    Plan: ``target LEFT JOIN source`` (updates + untouched rows) and
    ``source LEFT ANTI target`` (inserts).  Unlike a full outer join, both are
    join types AQE can split when a key is hot, and when the source is small
    Spark broadcasts it under its size threshold so the target is not
    shuffled at all.
    """
    if not keys:
        raise ValueError("merge needs merge keys")
    for k in keys:
        if k not in source.columns:
            raise ValueError(f"merge key {k!r} not in source")
    src, src_nulls = split_unique_source(source, keys, "merge")
    if target is None:
        return src.unionByName(src_nulls)
    for k in keys:
        if k not in target.columns:
            raise ValueError(f"merge key {k!r} not in target")
    extra = [c for c in source.columns if c not in target.columns]
    if extra and not overwrite_schema:
        raise ValueError(f"source columns {extra} not in target (set overwrite_schema=True)")
    out_cols = list(target.columns) + extra
    tdt = dict(target.dtypes)

    s = src.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_s_hit"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")
        cond = c if cond is None else cond & c
    upd = target.join(s, cond, "left")
    hit = F.col("_s_hit").isNotNull()
    sel = []
    for c in out_cols:
        if c in source.columns and c in target.columns:
            sel.append(F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)).cast(tdt[c]).alias(c))
        elif c in target.columns:
            sel.append(F.col(c))
        else:
            sel.append(F.col(f"_s_{c}").alias(c))
    updated = upd.select(*sel)
    inserts = src.join(target.select(*keys), list(keys), "left_anti").unionByName(src_nulls)
    ins = inserts.select(*[(F.col(c).cast(tdt[c]) if c in source.columns else F.lit(None).cast(tdt[c])).alias(c)
                           if c in tdt else F.col(c) for c in out_cols])
    return updated.unionByName(ins)
