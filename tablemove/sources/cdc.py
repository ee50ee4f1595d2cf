"""Change data capture: snapshot diff (A12) and applying a change feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.transforms import split_unique_source

# Change operation codes in the ``_op`` column.
OP_INSERT, OP_UPDATE, OP_DELETE = "insert", "update", "delete"


def cdc_snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes turning snapshot ``old`` into ``new``, with an ``_op`` column.

    insert = key only in new, delete = key only in old (old values), update =
    key in both and some non-key column differs NULL-safely.  Unchanged rows
    are not emitted.  Duplicate keys on either side fail the job.

    One full outer join on the keys: each side comes out of its key
    uniqueness check already hash-partitioned on the keys, so the join adds
    no further shuffle, and with unique keys per side the join has no hot
    key.  The check is a partial-aggregated count, so a repeated key does not
    pile up in one task before it fires.
    """
    o, o_nulls = split_unique_source(old, keys, "cdc old snapshot")
    n, n_nulls = split_unique_source(new, keys, "cdc new snapshot")
    cols = list(new.columns)
    nonkey = [c for c in cols if c not in keys]
    oa = o.select(*[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_o_hit"))
    na = n.select(*[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_n_hit"))
    cond = None
    for k in keys:
        c = F.col(f"_o_{k}") == F.col(f"_n_{k}")
        cond = c if cond is None else cond & c
    j = oa.join(na, cond, "full")
    differs = F.lit(False)
    for c in nonkey:
        differs = differs | ~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    op = (F.when(F.col("_o_hit").isNull(), F.lit(OP_INSERT))
           .when(F.col("_n_hit").isNull(), F.lit(OP_DELETE))
           .when(differs, F.lit(OP_UPDATE)))
    j = j.withColumn("_op", op).filter(F.col("_op").isNotNull())
    changes = j.select(*[F.when(F.col("_op") == OP_DELETE, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c)
                         for c in cols], "_op")
    # NULL keys never match: such old rows are deletes, such new rows inserts.
    return (changes.unionByName(o_nulls.select(*cols, F.lit(OP_DELETE).alias("_op")))
                   .unionByName(n_nulls.select(*cols, F.lit(OP_INSERT).alias("_op"))))


def cdc_apply(target: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str,
              op_col: str = "_op") -> DataFrame:
    """Apply a change feed: per key the change with the largest ``seq`` wins;
    target rows with a change are replaced, deletes drop the key.

    The latest change per key is a ``max_by``-style aggregate (partial
    aggregation before the shuffle), then an anti join removes changed keys
    from the target and the surviving non-delete changes are appended.
    """
    cols = list(target.columns)
    payload = [c for c in changes.columns if c not in keys]
    # A change without an order or an operation cannot be applied: the job fails instead of dropping rows.
    whole = F.col(seq).isNotNull() & F.col(op_col).isNotNull()
    fail = F.raise_error(F.lit(f"change with NULL {seq} or {op_col}"))
    changes = changes.filter(F.when(whole, F.lit(True)).otherwise(fail.cast("boolean")))
    # Equal sequence numbers of a key: the largest payload wins, so reruns agree.
    order = F.struct(F.col(seq), F.struct(*payload)) if payload else F.col(seq)
    latest = (changes.dropna(subset=list(keys)).groupBy(*keys)
                     .agg(F.max_by(F.struct(*payload), order).alias("_c"))
                     .select(*keys, *[F.col(f"_c.{c}").alias(c) for c in payload]))
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    ins = latest.filter(F.col(op_col) != OP_DELETE).select(*cols)
    out = kept.unionByName(ins)
    # NULL keys name no row: inserts append, deletes remove one equal row each (as the diff writes them).
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    loose = changes.filter(no_key)
    added = loose.filter(F.col(op_col) != OP_DELETE).select(*cols)
    removed = loose.filter(F.col(op_col) == OP_DELETE).select(*cols)
    return out.filter(~no_key).unionByName(out.filter(no_key).unionByName(added).exceptAll(removed))
