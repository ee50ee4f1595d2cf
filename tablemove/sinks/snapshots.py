"""Staging and versioned publish on plain Parquet.

Layout of a published table at ``<root>/<table>``::

    data/v<nnnnn>-<run>/     Parquet written by one publish (mode "error")
    history/                 one JSON row per version, appended by Spark

A version is the list of data parts it reads (``parts``).  Overwrite and merge
write one new part; append adds a part to the previous list (no copy of old
data); rollback republishes an old part list (metadata only).  The history row
is written last, so a failed job leaves no visible version; a leftover part
directory without a history row is never read.  One writer per table.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_path, hadoop_fs, path_exists
from .files import counted, rebalance
from .merge import merge as merge_frames

HISTORY_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("rows_written", T.LongType()),
    T.StructField("spec_version", T.StringType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("parts", T.ArrayType(T.StringType())),
    T.StructField("schema_json", T.StringType()),
    T.StructField("partition_columns", T.ArrayType(T.StringType())),
])

PUBLISH_MODES = ("overwrite", "append", "merge")


def spec_version(spec) -> str:
    """First 12 hex digits of SHA-1 of the spec as canonical JSON."""
    return hashlib.sha1(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:12]


# ------------------------------------------------------------ staging (K5, K6)

def stage(df: DataFrame, base: str, run_id: str, partition_by: Sequence[str] | None = None,
          options: dict | None = None, fmt: str = "parquet") -> dict:
    """Overwrite ``<base>/<run_id>`` with ``df``; rows counted by an Observation."""
    path = f"{base.rstrip('/')}/{run_id}"
    df, obs = counted(df)
    if partition_by:
        df = rebalance(df, partition_by)
    w = df.write.format(fmt).mode("overwrite").options(**{"partitionOverwriteMode": "static", **(options or {})})
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return {"run_id": run_id, "staging_path": path, "rows": int(obs.get["rows"]),
            "partition_by": list(partition_by or []), "schema": df.schema}


def read_staged(spark: SparkSession, staging_path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The staged rows; ``schema`` (``stage`` returns it) keeps the types of partition columns, which Spark would guess from paths."""
    r = spark.read.format(fmt)
    return (r.schema(schema) if schema is not None else r).load(staging_path)


def read_preview(spark: SparkSession, staging_path: str, n: int = 100, order_by=None) -> DataFrame:
    """First ``n`` staged rows for review before approval (G1 on the staged files)."""
    from ..operators.relational import preview
    return preview(read_staged(spark, staging_path), n, order_by)


def discard(spark: SparkSession, base: str, run_id: str) -> bool:
    """Delete one staged run; the destination is never touched."""
    return delete_path(spark, f"{base.rstrip('/')}/{run_id}")


# ------------------------------------------------------------ history

def history(spark: SparkSession, table: str) -> DataFrame:
    """All versions, one row each (empty frame if the table does not exist)."""
    h = f"{table.rstrip('/')}/history"
    if not path_exists(spark, h):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).json(h)


def _latest(spark: SparkSession, table: str):
    """The newest history row (a distributed top-1; the driver gets one row)."""
    rows = history(spark, table).orderBy(F.col("version").desc()).limit(1).collect()
    return rows[0] if rows else None


def _version_row(spark: SparkSession, table: str, version: int):
    rows = history(spark, table).filter(F.col("version") == version).limit(1).collect()
    if not rows:
        raise ValueError(f"version {version} not found at {table}")
    return rows[0]


def current_version(spark: SparkSession, table: str) -> int | None:
    v = _latest(spark, table)
    return v["version"] if v else None


def _part_path(table: str, part: str) -> str:
    """Parts are data directories relative to ``<table>/data`` or absolute file URIs
    (files kept by a merge that did not touch them)."""
    return part if (":" in part or part.startswith("/")) else f"{table.rstrip('/')}/data/{part}"


_PART_ROOT = re.compile(r"^(.*/data/v\d{5,}-[^/]+)/")


def _read_parts(spark: SparkSession, table: str, schema: T.StructType, parts: Sequence[str],
                partitioned: bool = False, with_file: bool = False) -> DataFrame:
    """Read a version's parts (directories and kept files).

    Unpartitioned layouts are one read over all paths.  For partitioned
    layouts each part directory is read on its own and kept files are grouped
    by the part directory they live in, read with it as ``basePath``, so the
    partition values encoded in the paths come back.  ``with_file`` adds the
    source file of every row as ``_file``.
    """
    def fin(df: DataFrame) -> DataFrame:
        return df.withColumn("_file", F.col("_metadata.file_path")) if with_file else df

    paths = [_part_path(table, p) for p in parts]
    if not paths:
        out = spark.createDataFrame([], schema)
        return out.withColumn("_file", F.lit(None).cast("string")) if with_file else out
    if not partitioned:
        return fin(spark.read.schema(schema).parquet(*paths))
    frames = [fin(spark.read.schema(schema).parquet(_part_path(table, p)))
              for p in parts if not (":" in p or p.startswith("/"))]
    groups: dict = {}
    for p in parts:
        if ":" in p or p.startswith("/"):
            m = _PART_ROOT.match(p)
            groups.setdefault(m.group(1) if m else None, []).append(p)
    for root, files in groups.items():
        r = spark.read.schema(schema)
        if root:
            r = r.option("basePath", root)
        frames.append(fin(r.parquet(*files)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _parts_df(spark: SparkSession, table: str, row, with_file: bool = False) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(row["schema_json"]))
    return _read_parts(spark, table, schema, list(row["parts"]), bool(row["partition_columns"]), with_file)


def read_as_of(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table as of ``version`` (latest if None)."""
    latest = _latest(spark, table)
    if latest is None:
        raise FileNotFoundError(f"no published versions at {table}")
    return _parts_df(spark, table, latest if version is None else _version_row(spark, table, version))


def read_table(spark: SparkSession, table: str) -> DataFrame:
    return read_as_of(spark, table, None)


def _append_history(spark: SparkSession, table: str, row: dict) -> None:
    (spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1)
          .write.mode("append").json(f"{table.rstrip('/')}/history"))


def _schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


# ------------------------------------------------------------- publish

def publish(spark: SparkSession, df: DataFrame, table: str, mode: str = "overwrite",
            merge_keys: Sequence[str] | None = None, overwrite_schema: bool = False,
            run_id: str | None = None, spec=None, partition_by: Sequence[str] | None = None) -> dict:
    """Publish ``df`` as the next version of ``table``.

    ``overwrite`` replaces, ``append`` adds rows, ``merge`` upserts on
    ``merge_keys`` (first run creates the table).  A schema change is refused
    unless ``overwrite_schema``.  Returns the commit result (K11).
    """
    if mode not in PUBLISH_MODES:
        raise ValueError(f"unknown publish mode {mode!r}; expected one of {PUBLISH_MODES}")
    if mode == "merge" and not merge_keys:
        raise ValueError("merge publish needs merge_keys")
    table = table.rstrip("/")
    run_id = run_id or uuid.uuid4().hex[:12]
    prev = _latest(spark, table)
    if prev is not None and mode != "merge":
        old = [(f.name, f.dataType.simpleString())
               for f in T.StructType.fromJson(json.loads(prev["schema_json"])).fields]
        if old != _schema_of(df) and not overwrite_schema:
            raise ValueError(f"schema change refused for {table}: {old} -> {_schema_of(df)}")
        if mode == "append" and old != _schema_of(df):
            raise ValueError("append needs the same schema as the current version")

    kept_files: list[str] = []
    if mode == "merge" and prev is not None:
        partition_by = partition_by or list(prev["partition_columns"] or []) or None
        out, kept_files = _merge_touched_files(spark, table, prev, df, list(merge_keys), overwrite_schema)
    else:
        out = df
    version = (prev["version"] + 1) if prev else 1
    part = f"v{version:05d}-{run_id}"
    while path_exists(spark, f"{table}/data/{part}"):  # leftover of a failed run
        part = f"{part}x"
    out, obs = counted(out)
    w = out.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{table}/data/{part}")
    n = int(obs.get["rows"])
    parts = ([*prev["parts"], part] if (mode == "append" and prev) else [*kept_files, part])
    result = {"version": version, "run_id": run_id, "mode": mode, "rows_written": n,
              "spec_version": spec_version(spec) if spec is not None else None,
              "committed_at": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
              "parts": parts, "schema_json": out.schema.json(), "partition_columns": list(partition_by or [])}
    _append_history(spark, table, result)
    return {"committed": True, "run_id": run_id, "rows_written": n, "destination": table,
            "mode": mode, "version": version}


def _merge_touched_files(spark: SparkSession, table: str, prev, source: DataFrame, keys: list[str],
                         overwrite_schema: bool) -> tuple[DataFrame, list[str]]:
    """Copy-on-write merge at file granularity.

    One pass over the *key columns* of the current version finds the files
    holding a key of the source (the source keys are usually small and Spark
    broadcasts them under its size check; otherwise AQE splits hot keys of the
    left join).  Only those files are read in full and rewritten together with
    the source; untouched files are carried into the new version by
    reference.  Any source key present in the table lives in a touched file,
    so merging against the touched files alone gives the same result as
    merging against the whole table.  The driver receives one row per data
    file (file metadata), never table rows.
    """
    cur = _parts_df(spark, table, prev, with_file=True)
    for k in keys:
        if k not in cur.columns:
            raise ValueError(f"merge key {k!r} not in target")
    src_keys = source.select(*keys).distinct().withColumn("_hit", F.lit(True))
    per_file = (cur.select(*keys, "_file")
                   .join(src_keys, keys, "left")
                   .groupBy("_file").agg(F.max(F.col("_hit").isNotNull()).alias("_touched")))
    # The metadata column is URL-encoded; paths for reading are not.
    files = [(unquote(r["_file"]), r["_touched"]) for r in per_file.collect()]
    touched = [f for f, hit in files if hit]
    kept = [f for f, hit in files if not hit]
    schema = T.StructType.fromJson(json.loads(prev["schema_json"]))
    target = _read_parts(spark, table, schema, touched, bool(prev["partition_columns"]))
    return merge_frames(target, source, keys, overwrite_schema), kept


def rollback(spark: SparkSession, table: str, version: int, run_id: str | None = None) -> dict:
    """Make ``version`` current again, recorded as a new version (metadata only)."""
    target = _version_row(spark, table, version)
    new_v = _latest(spark, table)["version"] + 1
    run_id = run_id or f"rollback-{uuid.uuid4().hex[:8]}"
    _append_history(spark, table, {
        "version": new_v, "run_id": run_id, "mode": f"rollback_to_{version}",
        "rows_written": target["rows_written"], "spec_version": target["spec_version"],
        "committed_at": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
        "parts": list(target["parts"]), "schema_json": target["schema_json"],
        "partition_columns": list(target["partition_columns"] or [])})
    return {"committed": True, "run_id": run_id, "rows_written": target["rows_written"],
            "destination": table, "mode": "rollback", "version": new_v}


def history_view(spark: SparkSession, table: str) -> DataFrame:
    """K14 as documented: version, run_id, mode, rows_written, spec_version, committed_at."""
    return history(spark, table).select("version", "run_id", "mode", "rows_written",
                                        "spec_version", "committed_at")


def publish_run(spark: SparkSession, staged: dict, table: str, mode: str = "overwrite",
                merge_keys: Sequence[str] | None = None, overwrite_schema: bool = False,
                spec=None) -> dict:
    """Publish a staged run (approve).

    Overwrite and append adopt the staged directory as the new data part with
    one file-system rename (no second copy of the data); merge has to join
    with the current version and writes a new part.
    """
    if mode == "merge":
        return publish(spark, read_staged(spark, staged["staging_path"], schema=staged.get("schema")), table, mode=mode,
                       merge_keys=merge_keys, overwrite_schema=overwrite_schema,
                       run_id=staged["run_id"], spec=spec)
    if mode not in PUBLISH_MODES:
        raise ValueError(f"unknown publish mode {mode!r}; expected one of {PUBLISH_MODES}")
    table = table.rstrip("/")
    staged_df = read_staged(spark, staged["staging_path"], schema=staged.get("schema"))
    prev = _latest(spark, table)
    if prev is not None:
        old = [(f.name, f.dataType.simpleString())
               for f in T.StructType.fromJson(json.loads(prev["schema_json"])).fields]
        if old != _schema_of(staged_df) and (not overwrite_schema or mode == "append"):
            raise ValueError(f"schema change refused for {table}: {old} -> {_schema_of(staged_df)}")
    version = (prev["version"] + 1) if prev else 1
    part = f"v{version:05d}-{staged['run_id']}"
    while path_exists(spark, f"{table}/data/{part}"):
        part = f"{part}x"
    fs, src = hadoop_fs(spark, staged["staging_path"])
    dfs, dst = hadoop_fs(spark, f"{table}/data/{part}")
    if fs.getUri().toString() != dfs.getUri().toString():
        # Staging and table on different file systems: copy through Spark.
        return publish(spark, staged_df, table, mode=mode, overwrite_schema=overwrite_schema,
                       run_id=staged["run_id"], spec=spec, partition_by=staged.get("partition_by") or None)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise IOError(f"could not move {staged['staging_path']} to {table}/data/{part}")
    parts = [*prev["parts"], part] if (mode == "append" and prev) else [part]
    _append_history(spark, table, {
        "version": version, "run_id": staged["run_id"], "mode": mode, "rows_written": staged["rows"],
        "spec_version": spec_version(spec) if spec is not None else None,
        "committed_at": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
        "parts": parts, "schema_json": staged_df.schema.json(),
        "partition_columns": list(staged.get("partition_by") or [])})
    return {"committed": True, "run_id": staged["run_id"], "rows_written": staged["rows"],
            "destination": table, "mode": mode, "version": version}
