"""Growth of iterative jobs and of the value overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemove.operators import graph as G
from tablemove.operators import overlap as O  # noqa: E741


def _estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimates_do_not_grow_over_rounds(spark):
    """a cut frame is as large as its rows, however large its plan's estimate was."""
    df = spark.range(200).withColumn("x", F.col("id"))
    for _ in range(4):
        df = G._cut(df.join(df.select(F.col("id").alias("_i")), F.col("id") == F.col("_i")).drop("_i"))
    assert df.count() == 200 and _estimate(df) < 1_000_000


def test_dense_components_hold_every_edge(spark, monkeypatch):
    """F8: a dense graph, a chain hanging from it, a loop of its own; the rounds read far fewer edges than there are."""
    dense = [(a, b) for a in range(0, 60) for b in range(60, 120)] + [(a, b) for a in range(1000, 1040) for b in range(1040, 1080)]
    chain = [(119, 200), *((i, i + 1) for i in range(200, 212))]
    read, hooked = [], G._hooked
    monkeypatch.setattr(G, "_hooked", lambda e: (read.append(e.count()), hooked(e))[1])
    edges = spark.createDataFrame([*dense, *chain, (500, 500), (None, 3), (7, None)], "src long, dst long")
    got = {r.node: r.component for r in G.connected_components(edges).collect()}
    want = {n: 0 for n in [*range(120), *range(200, 213)]} | {n: 1000 for n in range(1000, 1080)} | {500: 500}
    assert got == want and len(read) == 2 and sum(read) < len(dense)


def test_search_takes_read_edges_out(spark, monkeypatch):
    """the same tree when every level is large enough to take its edges out."""
    edges = spark.createDataFrame([(a, b) for a in range(30) for b in range(30, 60) if (a * a + b) % 5 <= 1] + [(59, 70), (70, 71)], "src long, dst long")
    seeds = spark.createDataFrame([(2,)], "node long")
    rows = lambda: {(r.node, r.hops, r.parent) for r in G.search_tree(edges, seeds).collect()}
    plain = rows()
    monkeypatch.setattr(G, "SMALL_LEVEL", 0)
    assert rows() == plain and len(plain) > 20


def test_values_are_shuffled_once(spark):
    """one hash aggregate by value; masks of more than one word give what sets give."""
    tables = {f"t{k:02d}": spark.range(k, k + 20).selectExpr("id AS a", "CAST(id % 5 AS STRING) AS b") for k in range(40)}
    columns = sorted((t, c) for t in tables for c in ("a", "b"))
    values = O.column_values(tables, columns)
    rows = lambda n: {(r.a, r.b): r.n for r in O.pair_counts(values, n).collect()}
    masks = rows(len(columns))
    assert masks == rows(O.MASKED_COLUMNS + 1)
    assert masks[0, 0] == 20 and masks[0, 2] == 19 and masks[1, 79] == 5 and (0, 1) not in masks
    plan = O.pair_counts(values, len(columns))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "collect_set" not in plan
