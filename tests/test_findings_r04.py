"""the work of fuzzy dedupe grows with its texts, not with rounds over its buckets."""

from __future__ import annotations

from itertools import combinations

import pytest

from tablemove.operators import fuzzy as Z


def _survivors(spark, rows, kind="id long, t string", **options):
    return sorted(r.id for r in Z.fuzzy_dedupe(spark.createDataFrame(rows, kind), "id", "t", **options).collect())


def _unlike(n):
    """Texts with a third in common, of which many share their smallest hash."""
    return [(i, " ".join([*(f"c{k}" for k in range(30)), *(f"d{i}x{k}" for k in range(15))])) for i in range(n)]


def test_rounds_do_not_grow_with_buckets_of_unlike_texts(spark, monkeypatch):
    cuts, cut = [], Z._cut
    monkeypatch.setattr(Z, "_cut", lambda df: (cuts.append(1), cut(df))[1])
    counts = []
    for n in (12, 120):
        del cuts[:]
        assert _survivors(spark, _unlike(n), bands=1, rows_per_band=1, shingle=1) == list(range(n))
        counts.append(len(cuts))
    assert counts[0] == counts[1]


@pytest.mark.parametrize("block", [4, 1024])
def test_blocks_of_a_bucket_meet(spark, monkeypatch, block):
    """Against all pairs of a bucket: families around a core that all texts share, and two strangers with the smallest ids."""
    monkeypatch.setattr(Z, "BLOCK_SETS", block)
    core = [f"c{i}" for i in range(40)]
    rows = [(0, " ".join([*core, *(f"s{i}" for i in range(40))])), (1, " ".join([*core, *(f"z{i}" for i in range(40))]))]
    rows += [(2 + 6 * f + k, " ".join([*core, *(f"f{f}o{i}" for i in range(20)), *(f"f{f}k{j}" for j in range(3 * k, 3 * k + 6))])) for f in range(4) for k in range(6)]
    sig = {r.id: (r._sig[0], set(r._set)) for r in Z.signatures(spark.createDataFrame(rows, "id long, t string"), "id", "t", 1, 1, 7).collect()}
    comp = {i: i for i in sig}
    for a, b in combinations(sorted(sig), 2):
        (x, s), (y, t) = sig[a], sig[b]
        if x == y and len(s & t) >= 0.8 * len(s | t):
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    want = sorted(set(comp.values()))
    assert 6 < len(want) < len(rows) and _survivors(spark, rows, bands=1, rows_per_band=1, shingle=1) == want


def test_cases_blanks_copies_and_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [("b", f"É {long}"), ("a", f"é  {long}\n"), ("c", f"é {long}"), ("d", ""), ("e", " \n"), ("f", None), ("g", "w1 w2"), ("h", "w2 w1"), ("i", "W1\tw2"), (None, "nobody's own text"), ("j", "kept"), ("j", "kept")]
    assert _survivors(spark, rows, "id string, t string") == ["a", "d", "f", "g", "h", "j", "j"]


def test_ids_with_several_texts_go_as_one(spark):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    assert _survivors(spark, [(1, texts[0]), (2, texts[0] + " x"), (2, texts[1]), (3, texts[1] + " x"), (4, texts[2])]) == [1, 4]


def test_smallest_hashes_agree_as_often_as_sets_are_alike(spark):
    rows = [(2 * i + s, " ".join([*(f"p{i}c{k}" for k in range(80)), *(f"p{i}s{s}k{k}" for k in range(10))])) for i in range(40) for s in (0, 1)]
    sig = {r.id: r for r in Z.signatures(spark.createDataFrame(rows, "id long, t string"), "id", "t", 64, 1, 7).collect()}
    same = [x == y for i in range(40) for x, y in zip(sig[2 * i]._sig, sig[2 * i + 1]._sig)]
    assert len(set(sig[0]._set)) == 90 and abs(sum(same) / len(same) - 0.8) < 0.04
