"""Breadth-first search and cycles on long, hubby and random graphs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tablemove.operators import graph as G


def _search(edges, seeds, directed):
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        if not directed:
            adj[b].add(a)
    best, frontier = {s: [s] for s in seeds}, list(seeds)
    while frontier:
        cand = {}
        for u in frontier:
            for v in adj[u]:
                if v not in best:
                    p = best[u] + [v]
                    cand[v] = min(cand.get(v, p), p)
        best.update(cand)
        frontier = list(cand)
    return {v: (len(p) - 1, p) for v, p in best.items()}


@pytest.mark.parametrize("directed", [False, True])
def test_smallest_shortest_paths(spark, directed):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(260)] + [("hub", f"n{i:03}") for i in range(0, 120, 2)] + [("x", "y")]
    e = spark.createDataFrame(edges, "src string, dst string")
    seeds = ["n005", "hub"]
    got = {r.node: (r.hops, list(r.path)) for r in G.shortest_paths(e, spark.createDataFrame([(s,) for s in [*seeds, *seeds]], "node string"), directed=directed).collect()}
    assert got == _search(edges, seeds, directed)


def test_plan_of_a_level_does_not_grow(spark):
    """After many levels a level's plan reads no more parts than after few; paths are right on a long chain."""
    e = spark.createDataFrame([(i, i + 1) for i in range(24)], "src long, dst long")
    tree = G.search_tree(e, spark.createDataFrame([(0,)], "node long"), directed=True)
    assert tree._jdf.queryExecution().logical().toString().count("LogicalRDD") <= 6
    got = {r.node: list(r.path) for r in G.tree_paths(tree).collect()}
    assert got == {i: list(range(i + 1)) for i in range(25)}


def test_target_ends_the_search(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e")], "source_table string, target_table string")
    assert [(r.hops, list(r.path)) for r in G.join_path(e, "a", "d").collect()] == [(2, ["a", "c", "d"])]
    assert G.join_path(e, "a", "nowhere").count() == 0


def _kahn(edges):
    edges = set(edges)
    while True:
        heads = {b for _, b in edges}
        left = {(a, b) for a, b in edges if a in heads}
        if left == edges:
            return {x for e in edges for x in e}
        edges = left


def _on_cycles(edges):
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
    out = set()
    for start in list(adj):
        seen, todo = set(), list(adj[start])
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += adj[u]
        if start in seen:
            out.add(start)
    return out


def _nodes(df):
    rows = [r.node for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_cycles_of_random_graphs(spark):
    rng = random.Random(3)
    edges = []
    for g in range(60):  # one frame of many small graphs: chains, trees, rings, loops, two rings joined by a path
        n = rng.randrange(2, 9)
        edges += [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for _ in range(rng.randrange(1, 12))]
    edges += [(9000, 9001), (9001, 9002), (9002, 9000), (9002, 9003), (9003, 9004), (9004, 9005), (9005, 9004), (9005, 9006), (None, 1), (2, None)]
    e = spark.createDataFrame(edges, "src int, dst int")
    known = [x for x in edges if None not in x]
    assert _nodes(G.cycle_nodes(e)) == _kahn(known)
    assert _nodes(G.nodes_on_cycles(e)) == _on_cycles(known)


def test_cycle_test_of_a_long_chain(spark, monkeypatch):
    """Ten thousand edges in a row: as many rounds as the length has binary digits, not as many as edges."""
    cuts = []
    cut = G._cut
    monkeypatch.setattr(G, "_cut", lambda df: cuts.append(1) or cut(df))
    chain = [(i, i + 1) for i in range(10_000)]
    e = spark.createDataFrame(chain, "src int, dst int")
    assert G.has_cycle(e).first()["has_cycle"] is False
    assert len(cuts) < 40
    ring = spark.createDataFrame([*chain, (10_000, 5_000)], "src int, dst int")
    assert _nodes(G.cycle_nodes(ring)) == set(range(5_000, 10_001))
    assert len(cuts) < 90
