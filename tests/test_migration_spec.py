"""Source formats, destinations, layout, aggregate and union steps of a migration spec."""

from __future__ import annotations

import os

import pytest
from conftest import SF_SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def paths(*names):
    return {n: os.path.join(SF_SMALL, f"{n}.parquet") for n in names}


@pytest.mark.parametrize("fmt", ["json", "orc", "parquet", "csv"])
def test_source_and_destination_formats(spark, tmp_table, fmt):
    from tablemove.plans.migrate import run_migration
    src = spark.createDataFrame([(1, "a|b", None), (2, None, 2.5), (3, "", -1.0)], "id int, name string, x double")
    src.write.format(fmt).option("header", "true").save(tmp_table + "/in")
    source = {"format": fmt, "path": tmp_table + "/in", "schema": "id int, name string, x double"}
    spec = {"operation": "copy", "source_tables": ["t"], "target_table": "t", "sources": {"t": source},
            "destination": {"type": "files", "format": fmt, "path": tmp_table + "/out"}}
    out = run_migration(spark, spec, {}, tmp_table + "/root")
    assert rows(out["frame"]) == rows(spark.read.format(fmt).schema(src.schema).option("header", "true").load(tmp_table + "/in"))
    assert out["commit"] == {"committed": True, "rows_written": 3, "destination": tmp_table + "/out", "mode": "overwrite"}


def test_append_to_a_partitioned_destination(spark, tmp_table):
    from tablemove.plans.migrate import run_migration
    spec = {"operation": "incremental", "source_tables": ["orders"], "target_table": "o",
            "destination": {"type": "files", "path": tmp_table + "/out", "partition_by": ["o_orderstatus"]}}
    for _ in range(2):
        out = run_migration(spark, spec, paths("orders"), tmp_table + "/root")
    once = spark.read.parquet(paths("orders")["orders"])
    assert out["frame"].columns == once.columns and rows(out["frame"]) == rows(once.union(once))
    assert any(f.startswith("o_orderstatus=") for f in os.listdir((tmp_table + "/out").removeprefix("file:")))


def test_versioned_table_laid_out_by_columns(spark, tmp_table):
    from tablemove.plans.migrate import run_migration
    spec = {"operation": "copy", "source_tables": ["orders"], "target_table": "o", "partition_by": ["o_orderstatus"]}
    for _ in range(2):
        out = run_migration(spark, spec, paths("orders"), tmp_table)
    once = spark.read.parquet(paths("orders")["orders"])
    assert rows(out["frame"].select(*once.columns)) == rows(once)


def test_failed_gate_leaves_the_destination_alone(spark, tmp_table):
    from tablemove.plans.migrate import run_migration
    spec = {"operation": "copy", "source_tables": ["t"], "target_table": "t", "fail_on_error": True,
            "checks": [{"type": "row_count", "min": 5}], "destination": {"type": "files", "path": tmp_table + "/out"}}
    with pytest.raises(Exception):
        run_migration(spark, spec, {"t": spark.range(2)}, tmp_table + "/root")
    assert not os.path.exists((tmp_table + "/out").removeprefix("file:"))


@pytest.mark.parametrize("extra", [
    {"destination": {"type": "ftp"}}, {"destination": {"type": "files"}}, {"destination": {"type": "table"}},
    {"destination": {"type": "files", "path": "x", "format": "xls"}}, {"operation": "merge", "destination": {"type": "files", "path": "x"}},
    {"union": {"tables": ["other"]}}, {"union": {"tables": ["t"]}}, {"sources": {"t": {"format": "xls"}}}, {"sources": {"t": {"fmt": "csv"}}}])
def test_specs_that_cannot_run_raise(spark, tmp_table, extra):
    from tablemove.plans.migrate import run_migration
    spec = {"operation": "copy", "source_tables": ["t"], "target_table": "t", **extra}
    with pytest.raises(ValueError):
        run_migration(spark, spec, {"t": "/nowhere"} if "sources" in extra else {"t": spark.range(2)}, tmp_table)


def test_union_step(spark, tmp_table):
    from tablemove.plans.migrate import run_migration
    a, b = spark.createDataFrame([(1, "x"), (1, "x")], "id int, k string"), spark.createDataFrame([("y", 2)], "k string, id int")
    c = spark.createDataFrame([(3,)], "id int")
    spec = {"operation": "copy", "source_tables": ["a", "b", "c"], "target_table": "u", "union": {"tables": ["b", "c"], "allow_missing": True}}
    got = run_migration(spark, spec, {"a": a, "b": b, "c": c}, tmp_table)["frame"]
    assert rows(got) == sorted([(1, "x"), (1, "x"), (2, "y"), (3, None)], key=repr)


def test_global_aggregate_of_no_rows(spark, tmp_table):
    from tablemove.plans.migrate import run_migration
    spec = {"operation": "copy", "source_tables": ["t"], "target_table": "n", "filters": ["id < 0"],
            "aggregate": {"aggs": [{"col": "*", "func": "count", "alias": "n"}, {"col": "id", "func": "max", "alias": "top"}]}}
    assert rows(run_migration(spark, spec, {"t": spark.range(4)}, tmp_table)["frame"]) == [(0, None)]


@pytest.mark.parametrize("extra", [{"partition_by": ["k"]}, {"destination": {"type": "files", "path": "{out}", "partition_by": ["k"]}}])
def test_layout_keeps_the_types_of_its_columns(spark, tmp_table, extra):
    from tablemove.plans.migrate import run_migration
    src = spark.createDataFrame([("007", 1), ("1e3", 2), (None, 3)], "k string, v int")
    if "destination" in extra:
        extra = {"destination": {**extra["destination"], "path": tmp_table + "/out"}}
    got = run_migration(spark, {"operation": "copy", "source_tables": ["t"], "target_table": "t", **extra}, {"t": src}, tmp_table)["frame"]
    assert rows(got.select("k", "v")) == rows(src)
