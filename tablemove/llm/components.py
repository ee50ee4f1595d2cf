"""Connected components by alternating large-star and small-star steps.

Each step groups edges by node with a partial minimum and joins the minimum
back; both join inputs are written tables, so AQE can split a hub's rows over
tasks.  The rounds grow with the logarithm of the longest path, and the loop
ends only when a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, prepare


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find inside each batch: the batch's edges become stars around local minima."""
    for edges in parts:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(edges["a"].tolist(), edges["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in list(root)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of an edge; component = smallest id of its component.

    Edges are pairs of longs in any direction; repeats, self-loops and pairs
    with a null are allowed (a null pair is no edge; a self-loop names a node).
    An empty input gives an empty result.
    """
    spark = prepare(edges.sparkSession, 20_000)
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    loops = pairs.where("a = b").select("a").distinct() if "loop" in edges.columns else None
    cur, path = materialize(pairs.where("a <> b").mapInPandas(_forest, "a long, b long").distinct(), "cc")
    state = _state(cur)
    while state[0]:
        mid, mid_path = _star(cur.union(cur.select("b", "a")), large=True)
        nxt, nxt_path = _star(mid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), large=False)
        drop_scratch(spark, path, mid_path)
        cur, path = nxt, nxt_path
        before, state = state, _state(cur)
        if state == before:
            break
    out = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = out.union(cur.select("b", "b").distinct())
    return out if loops is None else out.union(loops.select("a", "a")).groupBy("id").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(directed: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """One star step over rows (a: node, b: neighbour)."""
    spark = directed.sparkSession
    lows, lows_path = materialize(directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-min")
    joined = directed.join(lows, "a")
    if large:  # larger neighbours move to the minimum
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node and its smaller neighbours move to the minimum
        both = F.explode(F.array("a", "b"))
        out = joined.select(both.alias("a"), F.col("m").alias("b")).where("a <> b")
    done, path = materialize(out.distinct(), "cc")
    drop_scratch(spark, lows_path)
    return done, path
