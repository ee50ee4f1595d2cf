"""Run registered queries against their DuckDB oracle SQL and report matches.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""
from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def exact(v):
    if isinstance(v, (list, tuple)):
        return tuple(exact(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(((tuple(norm(r[i]) for i in order)) for r in rows), key=repr), sorted(
        ((tuple(repr(exact(r[i])) for i in order)) for r in rows))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    import duckdb

    import __spark_entry__ as E
    from tablemove.session import build_session
    spark = build_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sql = E.queries(), E.oracle_sql()
    keys = keys or list(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if k not in sql:
            print(f"ROWS {k}: {len(srows)} rows ({dt:.1f}s)")
            continue
        try:
            rel = con.sql(sql[k])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {k}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, ae = rows_of(cols, srows)
        b, be = rows_of(ocols, orows)
        if a == b:
            tag = "OK  " if ae == be else "OK~ "
            print(f"{tag}{k}: {len(srows)} rows ({dt:.1f}s)")
        else:
            bad += 1
            diff = [x for x in a if x not in set(b)][:2]
            diff2 = [x for x in b if x not in set(a)][:2]
            print(f"FAIL {k}: rows {len(a)} vs {len(b)}; spark-only {diff}; oracle-only {diff2}")
    print("failures:", bad)


if __name__ == "__main__":
    main()
