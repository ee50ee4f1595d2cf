"""Value overlap of all column pairs: common forms, empty columns, hot values, sketches."""

from __future__ import annotations

import datetime
import decimal

from tablemove.operators import overlap as O  # noqa: E741


def _by_pair(df):
    return {(f"{r.table_a}.{r.column_a}", f"{r.table_b}.{r.column_b}"): r for r in df.collect()}


def test_common_forms(spark):
    d = decimal.Decimal
    a = spark.createDataFrame([(1, d("1.00"), 1.0, "1", datetime.date(2024, 1, 1), True, None, [1.0]), (2, d("2.50"), 2.5, "2", datetime.date(2024, 1, 2), False, None, [2.0])],
                              "i int, d decimal(10,2), f double, s string, day date, yes boolean, none int, xs array<double>")
    b = spark.createDataFrame([(1, 2.5, datetime.datetime(2024, 1, 1), [1.0])], "l long, f double, at timestamp_ntz, xs array<double>")
    got = _by_pair(O.value_overlap_all({"a": a, "b": b}))
    assert len(got) == 12 * 11 // 2
    shared = {p: r.n_both for p, r in got.items() if r.n_both}
    assert shared == {("a.d", "a.f"): 2, ("a.d", "a.i"): 1, ("a.f", "a.i"): 1, ("a.d", "b.f"): 1, ("a.f", "b.f"): 1, ("a.d", "b.l"): 1, ("a.f", "b.l"): 1, ("a.i", "b.l"): 1,
                      ("a.day", "b.at"): 1, ("a.xs", "b.xs"): 1}
    none = got["a.i", "a.none"]
    assert (none.n_a, none.n_b, none.jaccard, none.containment) == (2, 0, 0.0, 0.0)


def test_hot_values_and_plan(spark):
    """A value that most rows hold counts once; no side is broadcast by hint."""
    a = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    b = spark.range(1000).selectExpr("id * 2 AS k")
    out = O.value_overlap_all({"a": a, "b": b})
    r = out.first()
    ka = {7 if i % 3 == 0 else i for i in range(3000)}
    kb = {2 * i for i in range(1000)}
    assert (r.n_a, r.n_b, r.n_both) == (len(ka), len(kb), len(ka & kb))
    assert "ResolvedHint" not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_sketches_find_every_pair_above_the_bound(spark):
    """Columns far larger than a sketch, with overlaps on both sides of the bound."""
    n = 40_000
    tables = {f"t{k}": spark.range(k * n // 10, k * n // 10 + n).withColumnRenamed("id", "k") for k in range(0, 10)}
    exact = {p: r.jaccard for p, r in _by_pair(O.value_overlap_all(tables)).items()}
    got = {p: r.jaccard for p, r in _by_pair(O.value_overlap_all(tables, least_jaccard=0.5)).items()}
    assert got == {p: j for p, j in exact.items() if j >= 0.5} and 10 < len(got) < len(exact)
    none = O.value_overlap_all({"x": spark.range(5), "y": spark.range(10, 15)}, least_jaccard=0.5)
    assert none.count() == 0 and "jaccard" in none.columns
