"""Exact string-similarity join without comparing all pairs.

``ratio(a, b) = 2·LCS(a, b) / (|a| + |b|)``.  An LCS uses each character at
most once on both sides, so ``LCS <= |chars(a) ∩ chars(b)|`` (multiset
intersection).  Hence ``ratio >= t`` needs a character overlap of at least
``t·|a| / (2 - t)``.  That is a set-overlap bound, so classic prefix
filtering applies: order all (character, occurrence) tokens globally by
rarity; two strings reaching the overlap must share a token within their
first ``|a| - overlap + 1`` tokens.  Candidates come from an equi-join on
those prefix tokens (rare tokens make small groups), then the exact LCS
expression verifies each candidate.  No pair with ``ratio >= t`` is missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import similarity_ratio


def _min_overlap(length: Column, t: float) -> Column:
    return F.ceil(length * F.lit(t / (2.0 - t)) - F.lit(1e-9)).cast("int")


def _tokens(names: DataFrame, col: str) -> DataFrame:
    """(name, token) rows; token = character + occurrence number within the name."""
    chars = names.select(F.col(col).alias("_name"), F.posexplode(F.split(F.col(col), "")).alias("_p", "_ch"))
    chars = chars.filter(F.length("_ch") > 0)
    w = Window.partitionBy("_name", "_ch").orderBy("_p")
    return chars.select("_name", F.concat(F.col("_ch"), F.lit("#"), F.row_number().over(w).cast("string")).alias("_tok"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float,
                  left_col: str = "name", right_col: str = "name") -> DataFrame:
    """All distinct (left name, right name) with ``ratio >= threshold``, with the ratio.

    Inputs are frames of strings (duplicates allowed); output columns
    ``a, b, ratio``.  Empty strings only match empty strings.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be in (0, 1]")
    ln = left.select(F.col(left_col).alias("n")).filter(F.col("n").isNotNull()).distinct()
    rn = right.select(F.col(right_col).alias("n")).filter(F.col("n").isNotNull()).distinct()
    lt, rt = _tokens(ln, "n"), _tokens(rn, "n")
    freq = lt.unionByName(rt).groupBy("_tok").agg(F.count(F.lit(1)).alias("_f"))

    def prefix(tok: DataFrame) -> DataFrame:
        ranked = tok.join(freq, "_tok")
        w = Window.partitionBy("_name").orderBy("_f", "_tok")
        ranked = ranked.withColumn("_rk", F.row_number().over(w))
        return ranked.filter(F.col("_rk") <= F.length("_name") - _min_overlap(F.length("_name"), threshold) + 1) \
                     .select("_name", "_tok")

    lp, rp = prefix(lt), prefix(rt)
    cand = (lp.withColumnRenamed("_name", "a").join(rp.withColumnRenamed("_name", "b"), "_tok")
              .select("a", "b").distinct())
    # Length bound: 2·min(|a|,|b|) >= t·(|a|+|b|) is necessary.
    la, lb = F.length("a"), F.length("b")
    cand = cand.filter(2 * F.least(la, lb) >= F.lit(threshold) * (la + lb) - F.lit(1e-9))
    scored = cand.withColumn("ratio", similarity_ratio(F.col("a"), F.col("b")))
    out = scored.filter(F.col("ratio") >= F.lit(threshold) - F.lit(1e-12))
    empties = (ln.filter(F.length("n") == 0).select(F.col("n").alias("a"))
                 .join(rn.filter(F.length("n") == 0).select(F.col("n").alias("b")), F.col("a") == F.col("b"))
                 .select("a", "b", F.lit(1.0).alias("ratio")))
    return out.unionByName(empties)


def prefix_length(length: int, threshold: float) -> int:
    """Python mirror of the prefix size, for tests."""
    return length - math.ceil(threshold * length / (2.0 - threshold) - 1e-9) + 1
