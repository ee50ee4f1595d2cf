"""Randomised comparisons against straightforward Python models (fixed seeds)."""

from __future__ import annotations

import random

import pytest

from tablemove.operators import relational as R
from tablemove.operators import transforms as X
from tablemove.sinks.merge import merge
from tablemove.sources import cdc


def _rows(rnd, n, keyspace, with_null=True):
    keys = list(range(keyspace)) + ([None] if with_null else [])
    return [(rnd.choice(keys), rnd.randint(0, 5)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_matches_model(spark, seed):
    rnd = random.Random(seed)
    target = _rows(rnd, 40, 30)
    src_keys = rnd.sample(range(45), 20)
    source = [(k, rnd.randint(10, 20)) for k in src_keys] + [(None, 99)]
    t = spark.createDataFrame(target, "k int, v int")
    s = spark.createDataFrame(source, "k int, v int")
    got = sorted(map(tuple, merge(t, s, ["k"]).collect()), key=repr)
    smap = {k: v for k, v in source if k is not None}
    model = [(k, smap[k]) if k in smap else (k, v) for k, v in target]
    model += [(k, v) for k, v in source if k is None or k not in {tk for tk, _ in target}]
    assert got == sorted(model, key=repr)


@pytest.mark.parametrize("seed", [4, 5])
def test_cdc_diff_matches_model(spark, seed):
    rnd = random.Random(seed)
    old = {k: rnd.randint(0, 3) for k in rnd.sample(range(60), 35)}
    new = {k: (v if rnd.random() < 0.6 else rnd.randint(0, 3)) for k, v in old.items() if rnd.random() < 0.8}
    new.update({k: rnd.randint(0, 3) for k in rnd.sample(range(60, 90), 10)})
    o = spark.createDataFrame(list(old.items()), "k int, v int")
    n = spark.createDataFrame(list(new.items()), "k int, v int")
    got = sorted(map(tuple, cdc.cdc_snapshot_diff(o, n, ["k"]).collect()))
    model = [(k, v, "insert") for k, v in new.items() if k not in old]
    model += [(k, v, "delete") for k, v in old.items() if k not in new]
    model += [(k, v, "update") for k, v in new.items() if k in old and old[k] != v]
    assert got == sorted(model)


@pytest.mark.parametrize("seed", [6, 7])
def test_dedupe_matches_model(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 8), rnd.randint(0, 4), i) for i in range(80)]
    got = sorted(map(tuple, X.dedupe(spark.createDataFrame(rows, "k int, t int, id int"), ["k"], "t",
                                     tiebreak=["id"]).collect()))
    best = {}
    for k, t, i in rows:
        if k not in best or (t, i) > best[k][1:]:
            best[k] = (k, t, i)
    assert got == sorted(best.values())


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_joins_match_model(spark, how):
    rnd = random.Random(8)
    a = [(rnd.choice([None, 1, 2, 3, 4]), i) for i in range(25)]
    b = [(rnd.choice([None, 2, 3, 5]), 100 + i) for i in range(15)]
    da, db = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k2 int, y int")
    got = sorted(map(lambda r: tuple(r), R.join(da, db, "k", "k2", how).collect()), key=repr)
    inner = [(k, x, k2, y) for k, x in a for k2, y in b if k is not None and k == k2]
    la = [(k, x, None, None) for k, x in a if not any(k is not None and k == k2 for k2, _ in b)]
    rb = [(None, None, k2, y) for k2, y in b if not any(k2 is not None and k == k2 for k, _ in a)]
    model = {"inner": inner, "left": inner + la, "right": inner + rb, "full": inner + la + rb,
             "left_semi": [(k, x) for k, x in a if any(k is not None and k == k2 for k2, _ in b)],
             "left_anti": [(k, x) for k, x, _, _ in la]}[how]
    assert got == sorted(model, key=repr)


@pytest.mark.parametrize("seed", [9, 10])
def test_scd2_matches_model(spark, seed):
    import datetime as dt
    rnd = random.Random(seed)
    t0, t1 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    base = {k: rnd.randint(0, 3) for k in range(20)}
    src = {k: (base.get(k, 0) if rnd.random() < 0.5 else rnd.randint(0, 3)) for k in rnd.sample(range(30), 15)}
    target = X.scd2(None, spark.createDataFrame(list(base.items()), "k int, v int"), ["k"], ["v"], t0)
    got = sorted(map(tuple, X.scd2(target, spark.createDataFrame(list(src.items()), "k int, v int"),
                                   ["k"], ["v"], t1).collect()), key=repr)
    model = []
    for k, v in base.items():
        if k in src and src[k] != v:
            model += [(k, v, t0, t1, False), (k, src[k], t1, None, True)]
        else:
            model.append((k, v, t0, None, True))
    model += [(k, v, t1, None, True) for k, v in src.items() if k not in base]
    assert got == sorted(model, key=repr)


@pytest.mark.parametrize("seed", [11, 12])
def test_cdc_apply_matches_model(spark, seed):
    rnd = random.Random(seed)
    target = {k: rnd.randint(0, 5) for k in range(25)}
    changes = [(rnd.randint(0, 35), rnd.randint(0, 5), rnd.choice(["insert", "update", "delete"]), seq)
               for seq in range(60)]
    got = sorted(map(tuple, cdc.cdc_apply(spark.createDataFrame(list(target.items()), "k int, v int"),
                                          spark.createDataFrame(changes, "k int, v int, _op string, seq int"),
                                          ["k"], "seq").collect()))
    latest = {}
    for k, v, op, seq in changes:
        if k not in latest or seq > latest[k][2]:
            latest[k] = (v, op, seq)
    model = {k: v for k, v in target.items() if k not in latest}
    model.update({k: v for k, (v, op, _) in latest.items() if op != "delete"})
    assert got == sorted(model.items())


@pytest.mark.parametrize("seed", [13, 14])
def test_quality_checks_match_model(spark, seed):
    from tablemove.operators import quality as Q
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, "a", "b"])) for _ in range(50)]
    parent = [(k,) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "k int, s string")
    res = {(r["check"], r["column"]): r["value"] for r in Q.quality(df, [
        {"type": "row_count", "min": 1}, {"type": "null_pct", "column": "*"},
        {"type": "duplicate", "keys": ["k"]},
        {"type": "referential", "column": "k", "ref": spark.createDataFrame(parent, "id int"), "ref_column": "id"},
    ]).collect()}
    from collections import Counter
    cnt = Counter(k for k, _ in rows)
    assert res[("row_count", None)] == 50
    assert res[("null_pct", "k")] == pytest.approx(sum(k is None for k, _ in rows) / 50)
    assert res[("null_pct", "s")] == pytest.approx(sum(s is None for _, s in rows) / 50)
    assert res[("duplicate", "k")] == sum(n - 1 for n in cnt.values() if n > 1)
    assert res[("referential", "k")] == sum(1 for k, _ in rows if k is not None and k not in (1, 2, 3))
