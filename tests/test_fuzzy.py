"""Fuzzy dedupe on families of near copies."""

from __future__ import annotations


def test_fuzzy_dedupe_pairs_below_a_strange_leader(spark):
    from tablemove.operators.fuzzy import fuzzy_dedupe, signatures
    rows = []
    for f in range(20):  # per family a stranger with the smallest id, and two near copies
        core = [f"f{f}c{i}" for i in range(60)]
        own = [f"f{f}o{i}" for i in range(20)]
        rows += [(3 * f, " ".join([*core, *(f"f{f}s{i}" for i in range(20))])), (3 * f + 1, " ".join([*core, *own])), (3 * f + 2, " ".join([*core, *own, "x"]))]
    docs = spark.createDataFrame(rows, "id long, t string")
    sig = {r.id: (r._sig[0], set(r._set)) for r in signatures(docs, "id", "t", 1, 1, 7).selectExpr("id", "_sig", "_set").collect()}
    near = lambda a, b: sig[a][0] == sig[b][0] and len(sig[a][1] & sig[b][1]) >= 0.8 * len(sig[a][1] | sig[b][1])
    assert not any(near(3 * f, 3 * f + k) for f in range(20) for k in (1, 2))
    gone = {3 * f + 2 for f in range(20) if near(3 * f + 1, 3 * f + 2)}
    assert len({f for f in range(20) if sig[3 * f][0] == sig[3 * f + 1][0] and 3 * f + 2 in gone}) > 3
    kept = {r.id for r in fuzzy_dedupe(docs, "id", "t", bands=1, rows_per_band=1, shingle=1).collect()}
    assert kept == set(range(60)) - gone
