"""Plan properties of every registered query: no nested-loop or cartesian
joins (except the user's explicit cross join) and no Python UDF evaluation."""

from __future__ import annotations

import contextlib
import io

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

QUERIES = E.queries()
ALLOWED_NESTED = {"join_cross"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_all_pairs_join_or_python(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    if name not in ALLOWED_NESTED:
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan


PUSHDOWN = ["filter_predicate", "filter_eq", "filter_neq", "filter_range", "filter_in", "filter_not_in",
            "filter_like", "filter_conjunction", "incremental_read", "migration_flagship"]


@pytest.mark.parametrize("name", PUSHDOWN)
def test_filters_reach_the_scan(spark, name):
    if name == "migration_flagship":
        from tablemove.plans.migrate import build_frame
        from tablemove.queries.sinks_q import FLAGSHIP_SPEC, _paths
        df = build_frame(spark, FLAGSHIP_SPEC, _paths(SF_SMALL, "orders", "customer"))
    else:
        df = QUERIES[name](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    pushed = [ln for ln in buf.getvalue().splitlines() if "PushedFilters: [" in ln]
    assert pushed and any("PushedFilters: []" not in ln for ln in pushed)


def test_projection_prunes_columns(spark):
    df = QUERIES["project_columns"](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in buf.getvalue() \
        or "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_totalprice:double>" in buf.getvalue()
