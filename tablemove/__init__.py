"""tablemove: table migration operators on Spark DataFrames.

Most used entry points (import from the submodules for the rest)::

    from tablemove import build_session, run_migration
    from tablemove import where_clauses, project, map_columns, join, aggregate, pivot, union
    from tablemove import dedupe, mask, type_cast, scd2, merge, quality
    from tablemove import stage, publish, publish_run, read_as_of, rollback, history
"""

from __future__ import annotations

_EXPORTS = {
    "build_session": "tablemove.session",
    "run_migration": "tablemove.plans.migrate",
    "build_frame": "tablemove.plans.migrate",
    "where": "tablemove.operators.relational",
    "where_clauses": "tablemove.operators.relational",
    "project": "tablemove.operators.relational",
    "map_columns": "tablemove.operators.relational",
    "join": "tablemove.operators.relational",
    "join_chain": "tablemove.operators.relational",
    "aggregate": "tablemove.operators.relational",
    "pivot": "tablemove.operators.relational",
    "union": "tablemove.operators.relational",
    "preview": "tablemove.operators.relational",
    "with_expr": "tablemove.operators.relational",
    "dedupe": "tablemove.operators.transforms",
    "mask": "tablemove.operators.transforms",
    "type_cast": "tablemove.operators.transforms",
    "scd2": "tablemove.operators.transforms",
    "register_transform": "tablemove.operators.transforms",
    "merge": "tablemove.sinks.merge",
    "quality": "tablemove.operators.quality",
    "gate": "tablemove.operators.quality",
    "stage": "tablemove.sinks.snapshots",
    "publish": "tablemove.sinks.snapshots",
    "publish_run": "tablemove.sinks.snapshots",
    "read_as_of": "tablemove.sinks.snapshots",
    "read_table": "tablemove.sinks.snapshots",
    "rollback": "tablemove.sinks.snapshots",
    "history": "tablemove.sinks.snapshots",
    "scan": "tablemove.sources.scan",
    "scan_incremental": "tablemove.sources.scan",
    "cdc_snapshot_diff": "tablemove.sources.cdc",
    "cdc_apply": "tablemove.sources.cdc",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        import importlib
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'tablemove' has no attribute {name!r}")
