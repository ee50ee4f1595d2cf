"""Metadata sources (A14-A17): object listing, column catalog, source stats,
value samples.  Data-reading parts run as Spark jobs; schema facts come from
the analysed plan, which costs no scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: file suffixes that object listing reports.
OBJECT_SUFFIXES = ("parquet", "csv", "json", "avro", "orc")
# Fixed value: bytes per estimated partition.
PARTITION_BYTES = 128 * 1024 * 1024

CATALOG_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("dtype", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
])


def type_family(dtype: str) -> str:
    """Coarse type class used for type-mismatch checks and value-overlap blocking."""
    d = dtype.lower()
    if d in ("tinyint", "smallint", "int", "integer", "bigint", "long", "short", "byte"):
        return "integer"
    if d in ("float", "double", "real") or d.startswith("decimal"):
        return "numeric"
    if d.startswith("timestamp"):
        return "timestamp"
    if d in ("string",) or d.startswith("varchar") or d.startswith("char"):
        return "string"
    return d.split("<")[0].split("(")[0]


def list_objects(spark: SparkSession, root: str, suffixes: Sequence[str] = OBJECT_SUFFIXES,
                 recursive: bool = True) -> DataFrame:
    """Files below ``root`` with a known suffix: id, name, path, size, mtime, format.

    Uses the ``binaryFile`` source with ``content`` pruned, so only the file
    listing is read; the listing itself is distributed by Spark.
    """
    globf = "*.{" + ",".join(suffixes) + "}"
    df = (spark.read.format("binaryFile").option("pathGlobFilter", globf)
          .option("recursiveFileLookup", str(recursive).lower()).load(root)
          .select("path", "length", "modificationTime"))
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return df.select(
        F.substring(F.sha1(F.col("path")), 1, 16).alias("object_id"),
        name.alias("name"), F.col("path"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("format"))


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per (table, column) from each DataFrame's analysed schema."""
    rows = []
    for t, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            rows.append((t, f.name, i + 1, f.dataType.simpleString(), bool(f.nullable)))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def source_stats(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """row_count (counted on executors), size_bytes, partition_count per source path.

    partition_count = max(1, size_bytes // 128 MiB).
    """
    out = None
    for name, path in tables.items():
        cnt = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"),
                                           F.lit(0).cast("long").alias("size_bytes"))
        size = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", "*.parquet").load(path)
                .agg(F.lit(0).cast("long").alias("row_count"),
                     F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("size_bytes")))
        both = cnt.unionByName(size).agg(F.sum("row_count").alias("row_count"),
                                         F.sum("size_bytes").alias("size_bytes"))
        one = both.select(
            F.lit(name).alias("table_name"), "row_count", "size_bytes",
            F.greatest(F.lit(1), F.floor(F.col("size_bytes") / PARTITION_BYTES)).cast("long").alias("partition_count"))
        out = one if out is None else out.unionByName(one)
    return out


def sample_values(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """Up to ``n`` distinct non-NULL values of ``column`` (smallest first, deterministic)."""
    return (df.select(F.col(column).alias("value")).dropna().distinct()
              .orderBy("value").limit(n))
