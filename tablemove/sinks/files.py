"""Plain writers: files, catalog tables, JDBC (K1-K4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

WRITE_MODES = ("overwrite", "append", "error", "errorifexists", "ignore")


def _check_mode(mode: str) -> str:
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown write mode {mode!r}; expected one of {WRITE_MODES}")
    return mode


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row counter that is filled by the next action (no extra scan)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def rebalance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cluster rows by ``columns`` for a partitioned write (Spark's REBALANCE
    hint: AQE splits skewed and merges small output partitions)."""
    return df.hint("rebalance", *columns)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
                partition_by: Sequence[str] | None = None, options: dict | None = None) -> int:
    """K1/K4: write files; returns rows written (from an Observation).

    With ``partition_by`` the data is first rebalanced on the partition
    columns, so each task writes few output directories (no small-file storm);
    the rebalance is AQE-aware, so a partition value holding a third of the
    rows is split over several tasks instead of landing in one.
    """
    _check_mode(mode)
    df, obs = counted(df)
    if partition_by:
        df = rebalance(df, partition_by)
    # An overwrite replaces the whole folder, also old partitions that get no new row.
    w = df.write.format(fmt).mode(mode).options(**{"partitionOverwriteMode": "static", **(options or {})})
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return int(obs.get["rows"])


def write_table(df: DataFrame, name: str, mode: str = "error",
                partition_by: Sequence[str] | None = None, fmt: str = "parquet",
                path: str | None = None, bucket_by: tuple[int, Sequence[str]] | None = None) -> int:
    """K3: write a catalog table (``saveAsTable``); ``path`` makes it an external table.

    ``bucket_by=(n, cols)`` writes ``n`` buckets sorted by ``cols``: later
    joins and aggregations on ``cols`` between tables bucketed the same way
    read co-located buckets and skip the shuffle.
    """
    _check_mode(mode)
    df, obs = counted(df)
    w = df.write.format(fmt).mode(mode)
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        w = w.bucketBy(n, *cols).sortBy(*cols)
    w.saveAsTable(name)
    return int(obs.get["rows"])


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error",
               properties: dict | None = None, num_partitions: int | None = None,
               batchsize: int = 10000) -> int:
    """K2: JDBC write; ``num_partitions`` bounds concurrent connections."""
    _check_mode(mode)
    df, obs = counted(df)
    if num_partitions:
        df = df.coalesce(num_partitions)
    (df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
       .option("batchsize", batchsize).options(**(properties or {})).save())
    return int(obs.get["rows"])
