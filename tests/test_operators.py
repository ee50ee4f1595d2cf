"""Edge cases the star schema lacks: NULL keys, ties, duplicates, empty input,
bad casts, schema changes, failures mid-publish, plus golden values."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablemove.operators import quality as Q
from tablemove.operators import relational as R
from tablemove.operators import transforms as X
from tablemove.sinks import snapshots as P
from tablemove.sinks.merge import merge
from tablemove.sources import cdc

# ------------------------------------------------------------------ filters


def test_clause_eq_none_raises():
    with pytest.raises(ValueError):
        R.clause_column({"column": "a", "op": "eq", "value": None})


def test_unknown_filter_op_raises():
    with pytest.raises(ValueError):
        R.clause_column({"column": "a", "op": "between", "value": 1})


def test_in_scalar_is_one_element_list(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert R.where_clauses(df, [{"column": "a", "op": "in", "value": 2}]).count() == 1


def test_neq_drops_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert R.where_clauses(df, [{"column": "a", "op": "neq", "value": 1}]).count() == 1


# -------------------------------------------------------------------- joins

def test_join_missing_key_raises(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        R.join(a, a, "k", None)
    with pytest.raises(ValueError):
        R.join(a, a)


def test_join_clashing_names_get_suffix(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y")], "k int, v string")
    out = R.join(a, b, "k", "k")
    assert out.columns == ["k", "v", "v_r"]
    assert out.collect()[0].asDict() == {"k": 1, "v": "x", "v_r": "y"}


def test_full_join_shared_key_coalesced(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, y string")
    rows = sorted(tuple(r) for r in R.join(a, b, "k", "k", "full").collect())
    assert rows == [(1, "a", None), (2, "b", "c"), (3, None, "d")]


def test_unknown_join_type_raises(spark):
    a = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        R.join(a, a, "k", "k", "sideways")


# --------------------------------------------------------------- aggregates

def test_aggregate_not_allowed(spark):
    with pytest.raises(ValueError):
        R.agg_column("exec", "a")


def test_pivot_default_group_by(spark):
    df = spark.createDataFrame([("g", "p", 1.0), ("g", "q", 2.0), ("h", "p", 3.0)], "g string, k string, value double")
    out = {r["g"]: r.asDict() for r in R.pivot(df, None, "k").collect()}
    assert out["g"]["p"] == 1.0 and out["g"]["q"] == 2.0 and out["h"]["q"] is None


# --------------------------------------------------------------- transforms

def test_dedupe_empty_keys_raises(spark):
    with pytest.raises(ValueError):
        X.dedupe(spark.range(3), [], "id")


def test_dedupe_tiebreak(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 5, 11), (2, 1, 1)], "k int, t int, id int")
    rows = sorted(tuple(r) for r in X.dedupe(df, ["k"], "t", tiebreak=["id"]).collect())
    assert rows == [(1, 5, 11), (2, 1, 1)]


def test_mask_nullify_keeps_type_and_null_stays_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert dict(X.mask(df, ["k"], "nullify").dtypes)["k"] == "int"
    hashed = X.mask(df, ["s"], "hash").orderBy("k").collect()
    assert hashed[1]["s"] is None and len(hashed[0]["s"]) == 64


def test_mask_unknown_strategy_raises(spark):
    with pytest.raises(ValueError):
        X.mask(spark.range(1), ["id"], "shred")


def test_bad_cast_fails_and_try_cast_nulls(spark):
    df = spark.createDataFrame([("12",), ("x",)], "s string")
    with pytest.raises(Exception):
        X.type_cast(df, {"s": "int"}).collect()
    vals = sorted((r["s"] is None, r["s"]) for r in X.type_cast(df, {"s": "int"}, on_error="null").collect())
    assert vals == [(False, 12), (True, None)]


def test_unknown_transform_raises(spark):
    with pytest.raises(ValueError):
        X.apply_transform(spark.range(1), "join", {})


# -------------------------------------------------------------------- merge

def test_merge_null_keys_never_match(spark):
    t = spark.createDataFrame([(None, "t"), (1, "t1")], "k int, v string")
    s = spark.createDataFrame([(None, "s"), (1, "s1"), (2, "s2")], "k int, v string")
    rows = sorted((str(r["k"]), r["v"]) for r in merge(t, s, ["k"]).collect())
    assert rows == [("1", "s1"), ("2", "s2"), ("None", "s"), ("None", "t")]


def test_merge_duplicate_source_keys_raise(spark):
    t = spark.createDataFrame([(1, "t")], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate source key"):
        merge(t, s, ["k"]).collect()


def test_merge_keeps_target_only_columns_and_checks_schema(spark):
    t = spark.createDataFrame([(1, "t", 9)], "k int, v string, extra int")
    s = spark.createDataFrame([(1, "s"), (2, "n")], "k int, v string")
    rows = sorted(tuple(r) for r in merge(t, s, ["k"]).collect())
    assert rows == [(1, "s", 9), (2, "n", None)]
    s2 = spark.createDataFrame([(1, "s", 1.0)], "k int, v string, new double")
    with pytest.raises(ValueError):
        merge(t, s2, ["k"])
    assert "new" in merge(t, s2, ["k"], overwrite_schema=True).columns


def test_merge_first_run_and_no_keys(spark):
    s = spark.createDataFrame([(1, "a")], "k int, v string")
    assert merge(None, s, ["k"]).count() == 1
    with pytest.raises(ValueError):
        merge(s, s, [])


def test_scd2_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t0 = X.scd2(None, base, ["k"], ["v"], "2020-01-01")
    src = spark.createDataFrame([(1, "a2"), (3, "c")], "k int, v string")
    t1 = X.scd2(t0, src, ["k"], ["v"], "2021-01-01")
    t2 = X.scd2(t1, src, ["k"], ["v"], "2021-01-01")
    key = lambda r: (r["k"], str(r["valid_from"]), r["is_current"])
    assert sorted(map(tuple, t1.collect()), key=str) == sorted(map(tuple, t2.collect()), key=str)
    cur = {r["k"]: r["v"] for r in t1.filter("is_current").collect()}
    assert cur == {1: "a2", 2: "b", 3: "c"}
    assert t1.count() == 4 and sorted(map(key, t1.collect()))[0][0] == 1


def test_cdc_duplicate_keys_raise(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate source key"):
        cdc.cdc_snapshot_diff(a, a, ["k"]).collect()


# ------------------------------------------------------------------ quality

def test_quality_gate_fail_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Q.QualityError):
        Q.gate(df, [{"type": "duplicate", "keys": ["k"]}], fail=True)
    res = Q.gate(df, [{"type": "row_count", "min": 1}], fail=True)
    assert res[0]["passed"]


def test_quality_on_empty_input(spark):
    df = spark.createDataFrame([], "k int")
    rows = {(r["check"], r["column"]): r for r in Q.quality(df, [{"type": "row_count", "min": 1},
                                                                 {"type": "null_pct", "column": "*"}]).collect()}
    assert rows[("row_count", None)]["passed"] is False
    assert rows[("null_pct", "k")]["value"] == 0.0


def test_unknown_check_raises(spark):
    with pytest.raises(ValueError):
        Q.quality(spark.range(1), [{"type": "vibes"}])


# ------------------------------------------------------------------ publish

def test_publish_modes_history_rollback(spark, tmp_table):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b")], "k int, v string")
    P.publish(spark, a, tmp_table, "overwrite")
    P.publish(spark, b, tmp_table, "append")
    assert sorted(r["k"] for r in P.read_table(spark, tmp_table).collect()) == [1, 2]
    P.publish(spark, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), tmp_table, "merge",
              merge_keys=["k"])
    assert sorted(tuple(r) for r in P.read_table(spark, tmp_table).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    P.rollback(spark, tmp_table, 1)
    assert [tuple(r) for r in P.read_table(spark, tmp_table).collect()] == [(1, "a")]
    assert [r["version"] for r in P.history_view(spark, tmp_table).orderBy("version").collect()] == [1, 2, 3, 4]
    assert P.read_as_of(spark, tmp_table, 2).count() == 2


def test_publish_schema_change_and_unknown_mode(spark, tmp_table):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    P.publish(spark, a, tmp_table)
    with pytest.raises(ValueError):
        P.publish(spark, a.withColumn("x", F.lit(1)), tmp_table)
    P.publish(spark, a.withColumn("x", F.lit(1)), tmp_table, overwrite_schema=True)
    with pytest.raises(ValueError):
        P.publish(spark, a, tmp_table, mode="upsert")
    with pytest.raises(ValueError):
        P.publish(spark, a, tmp_table, mode="merge")


def test_failed_publish_keeps_old_version(spark, tmp_table):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    P.publish(spark, a, tmp_table)
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom")))
                                 .otherwise(F.col("id")).cast("int").alias("k"), F.lit("z").alias("v"))
    with pytest.raises(Exception):
        P.publish(spark, bad, tmp_table)
    assert P.current_version(spark, tmp_table) == 1
    assert [tuple(r) for r in P.read_table(spark, tmp_table).collect()] == [(1, "a")]
    P.publish(spark, a, tmp_table)  # next publish still works after the failure
    assert P.current_version(spark, tmp_table) == 2


def test_stage_discard_and_publish_run(spark, tmp_table):
    base = tmp_table + "-staging"
    st = P.stage(spark.range(5), base, "r1")
    assert st["rows"] == 5
    res = P.publish_run(spark, st, tmp_table)
    assert res["rows_written"] == 5 and P.read_table(spark, tmp_table).count() == 5
    st2 = P.stage(spark.range(3), base, "r2")
    assert P.discard(spark, base, "r2")
    assert P.read_table(spark, tmp_table).count() == 5
    assert st2["rows"] == 3


def test_write_mode_error_when_exists(spark, tmp_table):
    from tablemove.sinks.files import write_files
    write_files(spark.range(2), tmp_table, "parquet", "error")
    with pytest.raises(PySparkException):
        write_files(spark.range(2), tmp_table, "parquet", "error")
    with pytest.raises(ValueError):
        write_files(spark.range(2), tmp_table, "parquet", "replace")


def test_merge_rewrites_only_touched_files(spark, tmp_table):
    base = spark.range(0, 400).select(F.col("id").cast("int").alias("k"), F.lit("v0").alias("v"))
    P.publish(spark, base.repartitionByRange(4, "k"), tmp_table)
    src = spark.createDataFrame([(5, "new"), (1000, "ins")], "k int, v string")
    P.publish(spark, src, tmp_table, "merge", merge_keys=["k"])
    row = [r for r in P.history(spark, tmp_table).collect() if r["version"] == 2][0]
    kept_files = [p for p in row["parts"] if ":" in p or p.startswith("/")]
    assert len(kept_files) == 3 and len(row["parts"]) == 4  # three untouched files + one rewritten part
    out = {r["k"]: r["v"] for r in P.read_table(spark, tmp_table).collect()}
    assert len(out) == 401 and out[5] == "new" and out[1000] == "ins" and out[6] == "v0"
    assert P.read_as_of(spark, tmp_table, 1).count() == 400


# --------------------------------------------------------------- migrations

def _spec(**kw):
    base = {"operation": "copy", "source_tables": ["orders"], "target_table": "t",
            "filters": [{"column": "o_orderstatus", "op": "eq", "value": "F"}]}
    base.update(kw)
    return base


def test_migration_dry_run_writes_nothing(spark, tmp_table):
    from conftest import SF_SMALL
    from tablemove.plans.migrate import run_migration
    tables = {"orders": f"{SF_SMALL}/orders.parquet"}
    out = run_migration(spark, _spec(dry_run=True, incremental={
        "orders": {"watermark_column": "o_orderdate", "last_watermark": "1998-01-01 00:00:00"}}), tables, tmp_table)
    est = out["estimate"]
    n = spark.read.parquet(tables["orders"]).filter("o_orderdate > TIMESTAMP '1998-01-01 00:00:00'").count()
    assert est["sources"][0]["rows"] == n and est["sources"][0]["partitions"] == 1
    assert [c for c, _ in est["output_schema"]][:2] == ["o_orderkey", "o_custkey"]
    from tablemove.session import path_exists
    assert not path_exists(spark, tmp_table)


def test_migration_failed_gate_publishes_nothing(spark, tmp_table):
    from conftest import SF_SMALL
    from tablemove.operators.quality import QualityError
    from tablemove.plans.migrate import run_migration
    tables = {"orders": f"{SF_SMALL}/orders.parquet"}
    with pytest.raises(QualityError):
        run_migration(spark, _spec(checks=[{"type": "row_count", "min": 10 ** 9}], fail_on_error=True), tables,
                      tmp_table)
    assert P.current_version(spark, f"{tmp_table}/t") is None
    warned = run_migration(spark, _spec(checks=[{"type": "row_count", "min": 10 ** 9}]), tables, tmp_table)
    assert warned["checks"][0]["passed"] is False and warned["commit"]["version"] == 1  # default gate only warns
    out = run_migration(spark, _spec(), tables, tmp_table)
    assert out["commit"]["version"] == 2 and out["frame"].filter("o_orderstatus <> 'F'").count() == 0
    assert {r["check"] for r in out["checks"]} == {"null_pct", "row_count"}


def test_migration_needs_joins_for_several_sources(spark, tmp_table):
    from tablemove.plans.migrate import build_frame
    with pytest.raises(ValueError):
        build_frame(spark, {"operation": "copy", "source_tables": ["a", "b"]},
                    {"a": spark.range(1), "b": spark.range(1)})
    with pytest.raises(ValueError):
        build_frame(spark, {"operation": "rewrite", "source_tables": ["a"]}, {"a": spark.range(1)})


def test_stream_upsert_replay_is_skipped(spark, tmp_table):
    from tablemove.streaming.streams import upsert_batch
    b0 = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b1 = spark.createDataFrame([(2, "B")], "k int, v string")
    assert upsert_batch(b0, tmp_table, ["k"], "q-0")
    assert upsert_batch(b1, tmp_table, ["k"], "q-1")
    assert not upsert_batch(b1.withColumn("v", F.lit("replayed")), tmp_table, ["k"], "q-1")
    assert sorted(tuple(r) for r in P.read_table(spark, tmp_table).collect()) == [(1, "a"), (2, "B")]
    assert P.current_version(spark, tmp_table) == 2


def test_full_join_split_equals_native(spark):
    import random
    rnd = random.Random(4)
    a = spark.createDataFrame([(rnd.choice([None, 1, 2, 3, 3, 3]), rnd.randint(0, 9), "l") for _ in range(60)],
                              "k int, x int, tag string")
    b = spark.createDataFrame([(rnd.choice([None, 2, 3, 4]), rnd.randint(0, 9)) for _ in range(40)], "k int, y int")
    for cond in (None, "l.x < r.y"):
        split = R.join(a, b, "k", "k", "full", condition=cond)
        native = R.join(a, b, "k", "k", "full", condition=cond, skew_split_full=False)
        assert split.columns == native.columns
        assert sorted(map(str, split.collect())) == sorted(map(str, native.collect()))


def test_staged_preview(spark, tmp_table):
    st = P.stage(spark.range(500), tmp_table, "p1")
    assert P.read_preview(spark, st["staging_path"]).count() == 100
    assert [r["id"] for r in P.read_preview(spark, st["staging_path"], 3, ["id desc"]).collect()] == [499, 498, 497]


def test_cdc_null_keys_are_delete_and_insert(spark):
    old = spark.createDataFrame([(None, "o"), (1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "n"), (1, "a"), (2, "B"), (3, "c")], "k int, v string")
    got = sorted((str(r["k"]), r["v"], r["_op"]) for r in cdc.cdc_snapshot_diff(old, new, ["k"]).collect())
    assert got == [("2", "B", "update"), ("3", "c", "insert"), ("None", "n", "insert"), ("None", "o", "delete")]
    applied = cdc.cdc_apply(old.filter("k is not null"),
                            cdc.cdc_snapshot_diff(old, new, ["k"]).filter("k is not null").withColumn("s", F.lit(1)),
                            ["k"], "s")
    assert sorted(tuple(r) for r in applied.collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_merge_into_partitioned_layout(spark, tmp_table):
    a = spark.createDataFrame([(i, "x" if i < 50 else "y", "v0") for i in range(100)], "k int, p string, v string")
    P.publish(spark, a, tmp_table, "overwrite", partition_by=["p"])
    src = spark.createDataFrame([(3, "x", "new"), (500, "z", "ins")], "k int, p string, v string")
    P.publish(spark, src, tmp_table, "merge", merge_keys=["k"])
    out = {r["k"]: (r["p"], r["v"]) for r in P.read_table(spark, tmp_table).collect()}
    assert len(out) == 101 and out[3] == ("x", "new") and out[500] == ("z", "ins") and out[70] == ("y", "v0")
    row = P.history(spark, tmp_table).filter("version = 2").collect()[0]
    assert list(row["partition_columns"]) == ["p"]
    assert any(":" in x or x.startswith("/") for x in row["parts"])   # the y partition's file is kept
    P.publish(spark, spark.createDataFrame([(70, "y", "upd")], "k int, p string, v string"), tmp_table, "merge",
              merge_keys=["k"])
    out = {r["k"]: (r["p"], r["v"]) for r in P.read_table(spark, tmp_table).collect()}
    assert len(out) == 101 and out[70] == ("y", "upd") and out[3] == ("x", "new")
    assert P.read_as_of(spark, tmp_table, 1).count() == 100


def test_jdbc_and_scan_argument_checks(spark):
    from tablemove.sources.scan import scan, scan_jdbc
    with pytest.raises(ValueError):
        scan_jdbc(spark, "jdbc:none:x")                      # neither table nor query
    with pytest.raises(ValueError):
        scan_jdbc(spark, "jdbc:none:x", dbtable="t", query="select 1")
    with pytest.raises(ValueError):
        scan_jdbc(spark, "jdbc:none:x", dbtable="t", partition_column="id")   # no bounds
    with pytest.raises(ValueError):
        scan(spark, "/nowhere", fmt="xlsx")


def test_readme_example_runs(spark, tmp_table):
    from conftest import SF_SMALL
    from tablemove.plans.migrate import run_migration
    spec = {"operation": "transform", "source_tables": ["orders", "customer"], "target_table": "fact_orders",
            "joins": [{"left_table": "orders", "right_table": "customer", "left_key": "o_custkey",
                       "right_key": "c_custkey", "join_type": "inner"}],
            "filters": [{"column": "o_orderstatus", "op": "neq", "value": "P"}],
            "transforms": [{"op": "mask", "params": {"columns": ["c_name"], "strategy": "hash"}},
                           {"op": "type_cast", "params": {"casts": {"o_totalprice": "decimal(18,2)"}}}],
            "checks": [{"type": "row_count", "min": 1}]}
    out = run_migration(spark, spec, {"orders": f"{SF_SMALL}/orders.parquet",
                                      "customer": f"{SF_SMALL}/customer.parquet"}, root=tmp_table)
    assert out["commit"]["rows_written"] == out["frame"].count() > 0
    assert dict(out["frame"].dtypes)["o_totalprice"] == "decimal(18,2)"


def test_two_argument_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 3, 5.0)], "g string, t int, v double")
    out = {r["g"]: r for r in R.aggregate(df, ["g"], [
        {"col": "v", "func": "max_by", "args": ["t"], "alias": "latest"},
        {"col": "v", "func": "percentile_approx", "args": [0.5], "alias": "p50"}]).collect()}
    assert out["a"]["latest"] == 20.0 and out["b"]["p50"] == 5.0


def test_orphan_counts_int_and_text_keys(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z"), (9, None), (None, "a")], "pk int, code string")
    parent_n = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    parent_s = spark.createDataFrame([("a",), ("b",)], "code string")
    res = {(r["column_name"]): r["orphan_rows"] for r in Q.orphan_counts(
        {"c": child, "pn": parent_n, "ps": parent_s},
        [("c", "pk", "pn", "id"), ("c", "code", "ps", "code")]).collect()}
    assert res == {"pk": 2, "code": 1}


def test_incremental_runs_chain_watermarks(spark, tmp_table):
    from conftest import SF_SMALL
    from tablemove.plans.migrate import run_migration
    tables = {"orders": f"{SF_SMALL}/orders.parquet"}
    spec = {"operation": "incremental", "source_tables": ["orders"], "target_table": "o",
            "incremental": {"orders": {"watermark_column": "o_orderdate", "last_watermark": "1999-01-01 00:00:00"}}}
    first = run_migration(spark, spec, tables, tmp_table)
    wm = first["next_watermarks"]["orders"]
    assert wm == spark.read.parquet(tables["orders"]).agg(F.max("o_orderdate")).first()[0]
    spec["incremental"]["orders"]["last_watermark"] = str(wm)
    second = run_migration(spark, spec, tables, tmp_table)   # nothing new: appends no rows
    assert second["commit"]["rows_written"] == 0 and second["next_watermarks"]["orders"] == str(wm)
    assert second["frame"].count() == first["frame"].count()


def test_step_tracer_rows_in_out(spark, tmp_table):
    from tablemove.plans.runinfo import StepTracer
    tr = StepTracer()
    df = tr.traced(spark.range(100), "read")
    df = tr.traced(df.filter("id % 4 = 0"), "filter")
    df.write.mode("error").parquet(tmp_table)
    tr.finish("read")
    tr.finish("filter")
    got = {r["step"]: (r["rows_in"], r["rows_out"], r["status"]) for r in tr.metrics(spark).collect()}
    assert got == {"read": (None, 100, "completed"), "filter": (100, 25, "completed")}


def test_append_and_rollback_on_partitioned_layout(spark, tmp_table):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string")
    b = spark.createDataFrame([(3, "x"), (4, "z")], "k int, p string")
    P.publish(spark, a, tmp_table, "overwrite", partition_by=["p"])
    P.publish(spark, b, tmp_table, "append", partition_by=["p"])
    got = sorted((r["k"], r["p"]) for r in P.read_table(spark, tmp_table).collect())
    assert got == [(1, "x"), (2, "y"), (3, "x"), (4, "z")]
    P.rollback(spark, tmp_table, 1)
    assert sorted((r["k"], r["p"]) for r in P.read_table(spark, tmp_table).collect()) == [(1, "x"), (2, "y")]
