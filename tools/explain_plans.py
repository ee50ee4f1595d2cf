"""Print the physical-plan skeleton of headline queries (scans with pushed
filters and read schema, joins with strategy, exchanges, partial/final
aggregates, window limits) for plan review.

Usage: python tools/explain_plans.py [sf_dir] [query ...]
"""
from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["migration_flagship", "join_chain", "dedupe_latest", "merge_upsert", "scd2_merge",
            "cdc_snapshot_diff", "cdc_apply", "value_overlap", "qc_referential", "join_full", "agg_multi"]
KEEP = re.compile(r"(Scan parquet|PushedFilters|ReadSchema|Join|Exchange|WindowGroupLimit|HashAggregate|"
                  r"Window |Union|Expand|Generate|Sort \[|BroadcastExchange)")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or HEADLINE
    from tablemove.plans.migrate import build_frame
    from tablemove.queries import QUERIES
    from tablemove.queries.sinks_q import FLAGSHIP_SPEC, _paths
    from tablemove.session import build_session
    spark = build_session()
    for name in names:
        if name == "migration_flagship":  # the plan before staging
            df = build_frame(spark, FLAGSHIP_SPEC, _paths(sf, "orders", "customer"))
        else:
            df = QUERIES[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        lines = [ln.rstrip() for ln in buf.getvalue().splitlines() if KEEP.search(ln)]
        print(f"## {name}\n```")
        for ln in lines:
            ln = re.sub(r"#\d+L?", "", ln)
            ln = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", ln)
            print(ln[:220])
        print("```\n")


if __name__ == "__main__":
    main()
