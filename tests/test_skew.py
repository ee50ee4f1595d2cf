"""Correctness when one key holds a third of the rows, with AQE skew handling
forced on at small sizes (low thresholds, no broadcast) so the split plans
actually run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablemove.operators import graph as G
from tablemove.operators import quality as Q
from tablemove.operators import relational as R
from tablemove.operators import transforms as X
from tablemove.sinks.merge import merge

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    n = 30000
    # key 0 holds a third of the rows
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                               F.col("id").alias("v"))
    yield df
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_merge_hot_key(spark, skewed):
    src = spark.createDataFrame([(0, -1), (1, -2), (10 ** 9, -3)], "k long, v long")
    out = merge(skewed, src, ["k"])
    counts = {r["v"]: r["count"] for r in out.groupBy("v").count().filter("v < 0").collect()}
    assert counts == {-1: 10000, -2: 1, -3: 1}
    assert out.count() == 30001


def test_dedupe_hot_key(spark, skewed):
    out = X.dedupe(skewed, ["k"], "v")
    assert out.filter("k = 0").collect()[0]["v"] == 29997
    assert out.count() == 20001


def test_full_join_hot_key(spark, skewed):
    right = spark.range(0, 40000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    split = R.join(skewed, right, "k", "k", "full")
    native = R.join(skewed, right, "k", "k", "full", skew_split_full=False)
    assert split.count() == native.count()
    assert split.exceptAll(native).count() == 0 and native.exceptAll(split).count() == 0


def test_duplicate_check_hot_key(spark, skewed):
    res = Q.quality(skewed, [{"type": "duplicate", "keys": ["k"]}]).collect()[0]
    assert res["value"] == 9999.0 and not res["passed"]


def test_components_with_hub(spark):
    hub = [("h", f"x{i}") for i in range(3000)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(30)]
    edges = spark.createDataFrame(hub + chain, "src string, dst string")
    comps = {r["component"]: r["n"] for r in G.connected_components(edges).groupBy("component").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert comps == {"c0": 31, "h": 3001}


def test_merge_duplicate_hot_source_key_fails(spark, skewed):
    with pytest.raises(Exception, match="duplicate source key"):
        merge(spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("v")), skewed, ["k"]).collect()
