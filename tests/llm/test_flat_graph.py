"""Links of the embedding near-dedup where few rows have any, and what its audit measures."""

from __future__ import annotations

import numpy as np
import pytest


def sparse(n: int, pairs: int, seed: int, ids=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x[1:2 * pairs:2] = x[0:2 * pairs:2] + 0.2 * rng.normal(size=(pairs, 64))
    x = x[rng.permutation(n)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(n)) if ids is None else ids
    return [(i, v.tolist()) for i, v in zip(ids, x)], {i: int(c) - 1 for i, c in zip(ids, (unit @ unit.T >= 0.95).sum(axis=1))}


@pytest.mark.parametrize("n, pairs, seed", [(4000, 100, 1), (6000, 20, 2)])
def test_every_sparse_link_and_a_measured_audit(spark, n, pairs, seed):
    from tablemove.llm.flat_graph import PROBES, near_dedup
    rows, true = sparse(n, pairs, seed)
    seen = []
    got = {r.vec_id: r for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), on_audit=seen.append).collect()}
    assert {i: r.n_links for i, r in got.items()} == true and sum(true.values()) >= 2 * pairs * 0.9
    assert sum(not r.kept for r in got.values()) == sum(true.values()) // 2
    assert seen[-1]["recall"] >= 0.97 and seen[-1]["linked"] >= PROBES


def test_large_ids_keep_their_links(spark):
    """Ids beyond 2^53, also in units whose links make no forest edge."""
    from tablemove.llm.flat_graph import near_dedup
    ids = np.random.default_rng(8).choice(2**62, size=2400, replace=False).astype(np.int64).tolist()
    ids = [-i if k % 2 else i for k, i in enumerate(ids)]
    rows, true = sparse(2400, 30, 3, ids)
    got = {r.vec_id: r.n_links for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == true


def test_audit_raises_the_overlap(spark):
    """A search that loses links is measured and widened until it doesn't."""
    from tablemove.llm.flat_graph import near_dedup
    rows, true = sparse(4000, 60, 4)
    seen = []
    got = {r.vec_id: r.n_links for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), overlap=1, recall=0.995, on_audit=seen.append).collect()}
    assert len(seen) > 1 and seen[0]["recall"] < 0.995 <= seen[-1]["recall"] and seen[-1]["overlap"] > 1
    assert got == true


def test_clusters_that_disagree_are_listed(spark, monkeypatch):
    """Links that one shared cluster alone found count once, in both rows."""
    from tablemove.llm import flat_graph
    whole = flat_graph._unit_links

    def forgetful(table, threshold, beam):
        table, links = whole(table, threshold, beam)
        if table.column("shard")[0].as_py() % 2:
            links[:] = False
        return table, links

    monkeypatch.setattr(flat_graph, "_unit_links", forgetful)
    rows, true = sparse(2400, 60, 5)
    seen = []
    got = {r.vec_id: r.n_links for r in flat_graph.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.0, on_audit=seen.append).collect()}
    assert seen[0]["doubt"] > 0 and all(got[i] <= true[i] for i in got)
    assert 0.6 * sum(true.values()) < sum(got.values()) < sum(true.values())
