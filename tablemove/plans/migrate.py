"""One migration spec run as one chain of DataFrame operations.

Fixed step order: sources (incremental) -> joins -> union -> filters ->
transforms -> aggregate -> column mapping / projection -> staged write ->
quality gate -> publish or delivery to the destination.
Nothing here plans or schedules: the chain is one lazy DataFrame and Catalyst
optimises it as a whole (filters after a join are pushed below it, unused
columns pruned at the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import auto_join
from ..operators.quality import gate
from ..operators.relational import aggregate, join_chain, map_columns, project, union, where, where_clauses
from ..operators.transforms import apply_transform
from ..sinks import delta, snapshots
from ..sinks.files import write_files, write_jdbc, write_table
from ..sources.scan import FILE_FORMATS, scan, scan_incremental, scan_jdbc, scan_table
from .runinfo import estimate

OPERATIONS = ("copy", "transform", "merge", "dedupe", "incremental")
# Write mode chosen by the operation.
MODE_BY_OPERATION = {"merge": "merge", "incremental": "append"}


def write_mode(operation: str) -> str:
    """Merge -> merge, incremental -> append, everything else -> overwrite."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}; expected one of {OPERATIONS}")
    return MODE_BY_OPERATION.get(operation, "overwrite")


def resolve(spark: SparkSession, tables: dict, name: str, sources: dict | None = None) -> DataFrame:
    """The DataFrame of one source.

    ``sources[name]`` may give its ``format`` (a file format, ``table`` or
    ``jdbc``; default parquet), ``path`` (default ``tables[name]``), ``schema``
    and ``options``; for ``table`` the catalog ``name``; for ``jdbc`` the
    arguments of ``scan_jdbc`` as options.  A DataFrame in ``tables`` is taken as it is.
    """
    src = (sources or {}).get(name) or {}
    unknown = set(src) - {"format", "path", "name", "schema", "options"}
    if unknown:
        raise ValueError(f"source {name!r}: unknown fields {sorted(unknown)}")
    fmt, options = src.get("format", "parquet"), src.get("options") or {}
    if fmt == "table":
        return scan_table(spark, src.get("name", name))
    if fmt == "jdbc":
        return scan_jdbc(spark, **options)
    t = src.get("path") or tables[name]
    if isinstance(t, DataFrame):
        return t
    return scan(spark, t, fmt, schema=src.get("schema"), options=options)


def build_frame(spark: SparkSession, spec: dict, tables: dict, edges: DataFrame | None = None,
                current: DataFrame | None = None, upto: dict | None = None) -> DataFrame:
    """The DataFrame a spec describes, before any write.

    Several sources without ``joins`` are joined through the edge table
    (``edges``, C10: confident edges only); an ``scd_merge`` transform without
    an explicit target merges into ``current`` (the destination's current
    version, None on the first load).  ``upto`` bounds incremental sources
    from above (per source, the watermark this run will report), so rows that
    arrive while it runs are left for the next run.

    ``sources`` says how each source is read (see ``resolve``).  ``union``
    (``{"tables": [...], "distinct": bool, "allow_missing": bool}``) adds the
    rows of further ``source_tables`` by column name after the joins;
    ``aggregate`` (``{"group_by": [...], "aggs": [...], "having": predicate}``)
    groups after the transforms.
    """
    write_mode(spec.get("operation", "copy"))
    sources = spec.get("source_tables") or []
    if not sources:
        raise ValueError("spec needs source_tables")
    inc = spec.get("incremental") or {}
    frames = {}
    for s in sources:
        df = resolve(spark, tables, s, spec.get("sources"))
        w = inc.get(s)
        if w:  # per source (D13)
            col = w.get("watermark_column")
            df = scan_incremental(df, col, w.get("last_watermark"))
            if (upto or {}).get(s) is not None:
                bound = F.col(col) <= F.lit(upto[s]).cast(dict(df.dtypes)[col])
                df = df.filter(bound | F.col(col).isNull())  # a first load has no lower bound and keeps NULLs
        frames[s] = df
    joins, more = spec.get("joins") or [], spec.get("union") or {}
    added = list(more.get("tables") or [])
    absent = [t for t in added if t not in frames]
    if absent:
        raise ValueError(f"union tables {absent} are not in source_tables")
    sources = [s for s in sources if s not in added]
    if not sources:
        raise ValueError("a union needs a source that it adds to")
    if len(sources) > 1 and not joins:
        if edges is None:
            raise ValueError("several sources but neither joins nor an edge table")
        # intermediate tables on the join path come from ``tables`` too
        path_tables = {n: (frames[n] if n in frames else resolve(spark, tables, n, spec.get("sources"))) for n in tables}
        df = auto_join(path_tables, edges, list(sources))
    else:
        df = frames[joins[0]["left_table"]] if joins else frames[sources[0]]
        df = join_chain(df, joins, frames)
    if added:
        df = union([df, *(frames[t] for t in added)], distinct=bool(more.get("distinct")), allow_missing=bool(more.get("allow_missing")))
    filters = spec.get("filters") or []
    structured = [f for f in filters if isinstance(f, dict)]
    df = where_clauses(df, structured)
    for p in (f for f in filters if isinstance(f, str)):
        df = where(df, p)
    for t in spec.get("transforms") or []:
        params = dict(t.get("params") or {})
        if t["op"] == "scd_merge":
            params.setdefault("target", current)
        df = apply_transform(df, t["op"], params)
    if spec.get("aggregate"):
        agg = spec["aggregate"]
        df = aggregate(df, agg.get("group_by") or [], agg["aggs"])
        if agg.get("having"):
            df = where(df, agg["having"])
    if spec.get("column_mappings"):
        df = map_columns(df, spec["column_mappings"])
    else:
        df = project(df, spec.get("output_columns"))
    return df


# The checks of the default quality gate (warn only).
DEFAULT_CHECKS = [{"type": "null_pct", "column": "*", "threshold": 0.95}, {"type": "row_count", "min": 1}]


def next_watermarks(spark: SparkSession, spec: dict, tables: dict) -> dict:
    """Per incremental source, the high-watermark to pass as
    ``last_watermark`` next time (max of the column over the rows this run
    read; the previous watermark when no new rows arrived).  One aggregate
    over the already-filtered source, so Parquet min/max statistics prune it."""
    out = {}
    for s, w in (spec.get("incremental") or {}).items():
        col = (w or {}).get("watermark_column")
        if not col:
            continue
        df = scan_incremental(resolve(spark, tables, s, spec.get("sources")), col, w.get("last_watermark"))
        v = df.agg(F.max(col)).first()[0]
        out[s] = v if v is not None else w.get("last_watermark")
    return out


def check_destination(spec: dict) -> dict | None:
    """The spec's destination, None for a versioned table under the root; raises before anything runs if it can't be written."""
    dest = spec.get("destination")
    if not dest:
        return None
    kind = dest.get("type")
    # What each kind of destination must name.
    needs = {"files": "path", "table": "name", "jdbc": "url", "delta": "path"}
    if kind not in needs:
        raise ValueError(f"unknown destination {kind!r}; expected one of {tuple(needs)}")
    if not dest.get(needs[kind]):
        raise ValueError(f"destination {kind!r} needs {needs[kind]!r}")
    if kind in ("files", "table") and dest.get("format", "parquet") not in FILE_FORMATS:
        raise ValueError(f"unsupported format {dest['format']!r}")
    if write_mode(spec.get("operation", "copy")) == "merge" and kind != "delta":
        raise ValueError(f"destination {kind!r} takes no merge; use delta or the versioned table")
    return dest


def deliver(spark: SparkSession, df: DataFrame, dest: dict, spec: dict) -> tuple[dict, DataFrame | None]:
    """Write ``df`` to the destination: (commit, the destination read back; None for JDBC)."""
    kind, fmt, options = dest["type"], dest.get("format", "parquet"), dest.get("options") or {}
    mode = write_mode(spec.get("operation", "copy"))
    how, parts = dest.get("mode") or mode, dest.get("partition_by") or spec.get("partition_by")
    if kind == "files":
        options = {"header": "true", **options} if fmt == "csv" else options
        rows = write_files(df, dest["path"], fmt, how, parts, options)
        out, place = scan(spark, dest["path"], fmt, schema=df.schema, options=options).select(*df.columns), dest["path"]
    elif kind == "table":
        rows = write_table(df, dest["name"], how, parts, fmt, dest.get("path"), dest.get("bucket_by"))
        out, place = spark.table(dest["name"]).select(*df.columns), dest["name"]
    elif kind == "jdbc":
        rows = write_jdbc(df, dest["url"], dest.get("name") or spec["target_table"], how, options, dest.get("num_partitions"))
        out, place = None, dest.get("name") or spec["target_table"]
    else:
        commit = delta.publish_delta(spark, df, dest["path"], mode, spec.get("merge_keys"), bool(spec.get("overwrite_schema")))
        return commit, delta.read_delta_as_of(spark, dest["path"])
    return {"committed": True, "rows_written": rows, "destination": place, "mode": how}, out


def run_migration(spark: SparkSession, spec: dict, tables: dict, root: str,
                  run_id: str | None = None, publish: bool = True, fail_on_error: bool | None = None,
                  edges: DataFrame | None = None) -> dict:
    """Run a spec: build, stage under ``<root>/_staging``, gate, publish to ``<root>/<target>``.

    The gate runs ``spec["checks"]`` (default: every column at most 95 %
    NULL, at least one row) and only warns unless ``fail_on_error`` (argument
    or spec field) is true, in which case a failed check stops before publish.
    ``dry_run: true`` returns the estimate (I6) and writes nothing.
    ``partition_by`` lays the published table out by columns.  ``destination``
    (``type`` files, table, jdbc or delta; ``path`` or ``name``; ``format``,
    ``options``, ``partition_by``, ``mode``) takes the gated rows elsewhere
    instead of into a versioned table.
    Returns ``{"frame", "staged", "commit", "checks", "table"}``.
    """
    if fail_on_error is None:
        fail_on_error = bool(spec.get("fail_on_error", False))
    dest = check_destination(spec)
    table = f"{root.rstrip('/')}/{spec['target_table']}"
    current = snapshots.read_table(spark, table) if snapshots.current_version(spark, table) else None
    # Taken before the read and bounding it: what arrives later stays above the watermark.
    watermarks = {} if spec.get("dry_run") else next_watermarks(spark, spec, tables)
    df = build_frame(spark, spec, tables, edges=edges, current=current, upto=watermarks)
    if spec.get("dry_run"):
        return {"frame": df, "estimate": estimate(spark, spec, tables, frame=df)}
    import uuid
    run_id = run_id or uuid.uuid4().hex[:12]
    # Stage first, then gate on the staged files: the join/transform lineage
    # runs once; the checks read Parquet (row counts come from footers).
    staged = snapshots.stage(df, f"{root.rstrip('/')}/_staging", run_id, None if dest else spec.get("partition_by"))
    checks = spec.get("checks") or DEFAULT_CHECKS
    results = gate(snapshots.read_staged(spark, staged["staging_path"], schema=staged["schema"]), checks, fail=fail_on_error)
    out = {"staged": staged, "checks": results, "table": table, "next_watermarks": watermarks}
    if publish and dest:
        out["commit"], out["frame"] = deliver(spark, snapshots.read_staged(spark, staged["staging_path"], schema=staged["schema"]), dest, spec)
        out["table"] = out["commit"]["destination"]
    elif publish:
        mode = write_mode(spec.get("operation", "copy"))
        out["commit"] = snapshots.publish_run(
            spark, staged, out["table"], mode=mode, merge_keys=spec.get("merge_keys") or None,
            overwrite_schema=bool(spec.get("overwrite_schema")), spec=spec)
        out["frame"] = snapshots.read_table(spark, out["table"])
    else:
        out["frame"] = snapshots.read_staged(spark, staged["staging_path"], schema=staged["schema"])
    return out
