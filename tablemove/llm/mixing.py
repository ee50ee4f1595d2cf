"""Mixing sources to target weights (operator 9): a time-varying curriculum, all in DataFrame functions.

Every source has a weight schedule, a straight line over training time t in
[0, 1].  Its integral is the source's weight in the whole mix; targets share
``share`` times all words by these weights, none above ``max_repeats`` times
its source (water-filling: a source is full when the common level times its
weight reaches its cap).  Up to time t a source has delivered its target times
the normalised integral of its schedule, so inverting that function maps the
k-th word taken of a source to a position; sorting all sources by position
gives the training order.

Within a source documents are ordered by a hash of id and text.  Whole passes
take every document; the rest of the target goes to the first documents of
that order, up to half a document.  Prefix sums go over hash buckets first, so
a source that holds most of the rows is spread over many tasks.

Cases: null source: one source, last in order.  Null or empty text: size 0,
never taken.  Rows with equal id and text are separate rows with equal parts
in the order.  Null id: like any other.  Other columns are kept; the names this
module adds start with ``mix_``.  No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, shuffle_partitions

#: Integrated weights of the sources in code-point order, repeating, and the
#: factors by which a schedule starts and ends (their mean is 1).
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = ((1.4, 0.6), (0.8, 1.2), (0.5, 1.5))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[tuple[float, float]] = RAMPS,
                   share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(mix_source, mix_source_size, mix_target, mix_from, mix_to): one row per source of ``sizes``
    (mix_source, mix_source_size); mix_from and mix_to are the ends of its schedule."""
    turn = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (turn % len(xs) + 1).cast("int"))
    cap = F.col("mix_source_size") * F.lit(float(max_repeats))
    t = (sizes.withColumns({"start": pick([r[0] * w for r, w in zip(ramps, weights)]), "end": pick([r[1] * w for r, w in zip(ramps, weights)])})
         .withColumn("w", (F.col("start") + F.col("end")) / 2).withColumn("cap", cap))
    # Sources fill up in the order of cap / weight; before a source is decided, those ahead of it are full.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last())
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({"total": F.sum("mix_source_size").over(everything) * F.lit(share),
                       "full": F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)),
                       "w_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(ahead), F.lit(0.0))})
    t = t.withColumn("level", (F.col("total") - F.col("full")) / F.col("w_left"))
    # The level is the one seen by the first source that doesn't fill up; sources behind it see lower ones.
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    return t.select("mix_source", "mix_source_size", F.least("cap", F.coalesce(F.col("w") * level, "cap")).alias("mix_target"),
                    F.col("start").alias("mix_from"), F.col("end").alias("mix_to"))


def _position(part: Column, start: Column, end: Column) -> Column:
    """Time at which the integral of a line from ``start`` to ``end`` reaches ``part`` of its whole."""
    slope, need = end - start, part * (start + end) / 2
    return F.when(slope == 0, part).otherwise(2 * need / (start + F.sqrt(F.greatest(start * start + 2 * slope * need, F.lit(0.0)))))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               share: float = 1.5, max_repeats: int = 2, weights: Sequence[float] = WEIGHTS,
               ramps: Sequence[tuple[float, float]] = RAMPS) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_taken (words taken, repeats
    counted) and mix_positions (one training position in [0, 1] per copy taken)."""
    spark = docs.sparkSession
    sized = docs.withColumns({"mix_source": F.col(source_col), "mix_size": F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
                              "mix_hash": F.xxhash64(F.col(id_col), F.col(text_col))})
    rows = docs.groupBy(source_col).count().agg(F.max("count")).first()[0] or 0
    buckets = math.isqrt(rows) + 1  # as many buckets in a source as rows in a bucket
    # The hash's high bits choose the bucket, so buckets and then rows are in hash order.
    sized = sized.withColumn("mix_bucket", F.floor((F.col("mix_hash") / F.lit(2.0**64) + 0.5) * buckets))
    keys = ["mix_source", "mix_bucket"]
    sums, sums_path = materialize(sized.groupBy(*keys).agg(F.sum("mix_size").alias("n")), "mix-sums")
    targets, targets_path = materialize(source_targets(sums.groupBy("mix_source").agg(F.sum("n").alias("mix_source_size")),
                                                       weights, ramps, share, max_repeats), "mix-targets")
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base, _ = materialize(sums.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_base"))
                          .join(targets.withColumnRenamed("mix_source", "s"), F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
                          .withColumnsRenamed({"mix_source": "s", "mix_bucket": "b"}), "mix-base")
    drop_scratch(spark, sums_path, targets_path)
    same = F.col("mix_source").eqNullSafe(F.col("s")) & (F.col("mix_bucket") == F.col("b"))
    inside = Window.partitionBy(*keys).orderBy("mix_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.withColumn("mix_upto", F.sum("mix_size").over(inside)).join(base, same).drop("s", "b")

    size, whole = F.col("mix_size"), F.col("mix_source_size")
    ahead = F.col("mix_base") + F.col("mix_upto") - size  # words of the source before this document
    passes = F.when(whole > 0, F.floor(F.col("mix_target") / whole)).otherwise(F.lit(0)).cast("long")
    rest = F.col("mix_target") - passes * whole
    extra = F.when((passes < max_repeats) & (ahead + size / 2 <= rest), 1).otherwise(0)
    out = out.withColumn("mix_copies", F.when(size > 0, passes + extra).otherwise(F.lit(0)).cast("int"))
    # Copy c of a document lies at (c * source + words ahead + half its own) of all words taken from the source.
    part = lambda c: F.least(F.lit(1.0), (c * whole + ahead + size / 2) / F.col("mix_target"))
    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.col("mix_copies") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns({"mix_taken": F.col("mix_copies") * size,
                           "mix_positions": F.transform(copies, lambda c: _position(part(c), F.col("mix_from"), F.col("mix_to")))})
    return out.drop("mix_source", "mix_hash", "mix_bucket", "mix_upto", "mix_base", "mix_copies", "mix_from", "mix_to")


def in_order(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``curriculum`` range-sorted by ``mix_first``, their first position; those not taken come last."""
    rows, _ = materialize(planned.withColumn("mix_first", F.try_element_at("mix_positions", F.lit(1))), "mix-planned")  # else run once more to find the ranges
    keys = [F.col("mix_first").asc_nulls_last(), F.col(id_col)]
    return rows.repartitionByRange(shuffle_partitions(planned.sparkSession), *keys).sortWithinPartitions(*keys)


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus in training order: ``docs``' columns, a row per copy taken, range-sorted by position."""
    planned = curriculum(docs, id_col, **options)
    copies = planned.select(*docs.columns, F.explode("mix_positions").alias("mix_position"))
    return (copies.repartitionByRange(shuffle_partitions(docs.sparkSession), "mix_position", id_col)
            .sortWithinPartitions("mix_position", id_col).drop("mix_position"))
