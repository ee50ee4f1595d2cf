"""Schema-relationship operators as DataFrame jobs (inventory section H).

Profiles, value overlap and referential checks read the tables; edges,
drift and resolution run on catalog/edge DataFrames of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import name_key, round_half_even
from ..sources.catalog import type_family
from .overlap import overlaps
from .similarity import similar_pairs

# Thresholds and weights of edge inference and name resolution.
NAME_SIMILARITY_THRESHOLD = 0.70
NAME_CONFIDENCE_WEIGHT = 0.9
VALUE_OVERLAP_THRESHOLD = 0.50
VALUE_NAME_WEIGHT, VALUE_JACCARD_WEIGHT = 0.4, 0.6
CONFIRMATION_THRESHOLD = 0.85
RESOLUTION_THRESHOLD = 0.60
EXACT_CONFIDENCE, CASE_INSENSITIVE_CONFIDENCE = 1.0, 0.95
UNVERIFIED_JOIN_CONFIDENCE = 0.70

EDGE_COLUMNS = ["edge_id", "source_table", "target_table", "kind", "source_column", "target_column",
                "confidence", "reasoning", "needs_confirmation"]


# ------------------------------------------------------------- profile (H1)

def profile_columns(df: DataFrame, table: str | None = None, exact_distinct: bool = True) -> DataFrame:
    """null_pct, distinct_count, min, max for every column in one aggregation pass.

    ``exact_distinct=False`` uses HyperLogLog (fixed memory, no Expand of the
    input per column) -- the choice for very wide or very large tables.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        col = F.col(c)
        dc = F.count_distinct(col) if exact_distinct else F.approx_count_distinct(col)
        simple = isinstance(df.schema[c].dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType,
                                                    T.TimestampNTZType, T.BooleanType))
        aggs += [F.count(col).alias(f"{c}__nn"), dc.alias(f"{c}__dc"),
                 (F.min(col).cast("string") if simple else F.lit(None).cast("string")).alias(f"{c}__min"),
                 (F.max(col).cast("string") if simple else F.lit(None).cast("string")).alias(f"{c}__max")]
    g = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("ordinal"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.when(F.col("_rows") > 0, 1.0 - F.col(f"{c}__nn") / F.col("_rows")).otherwise(0.0)
                      .alias("null_pct"),
                     F.col(f"{c}__dc").cast("long").alias("distinct_count"),
                     F.col(f"{c}__min").alias("min_value"), F.col(f"{c}__max").alias("max_value"))
            for i, c in enumerate(df.columns)]
    out = g.select(F.col("_rows").alias("row_count"), F.explode(F.array(*rows)).alias("p")).select("row_count", "p.*")
    if table is not None:
        out = out.select(F.lit(table).alias("table_name"), "*")
    return out


# ---------------------------------------------------- fingerprint, drift (H2-H4)

def schema_fingerprint(cols: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint per table of a catalog (table_name, column_name, dtype)."""
    return cols.groupBy("table_name").agg(
        F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("column_name", "dtype"))))).alias("fingerprint"))


def node_id(connector: Column, qualified_name: Column) -> Column:
    """Stable node id: first 16 hex digits of sha1("<connector>:<qualified name>")."""
    return F.substring(F.sha1(F.concat_ws(":", connector, qualified_name)), 1, 16)


def graph_nodes(spark: SparkSession, tables: dict[str, DataFrame], connector: str = "files",
                kind: str = "table") -> DataFrame:
    """One node row per table: id, name, connector, kind, column count,
    schema fingerprint and row count (counted on the executors, one
    aggregate per table)."""
    from ..sources.catalog import catalog_columns
    cols = catalog_columns(spark, tables)
    fp = schema_fingerprint(cols)
    ncols = cols.groupBy("table_name").agg(F.count(F.lit(1)).cast("int").alias("column_count"))
    counts = None
    for t, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return (fp.join(ncols, "table_name").join(counts, "table_name")
              .select(node_id(F.lit(connector), F.col("table_name")).alias("node_id"),
                      F.col("table_name").alias("name"), F.lit(connector).alias("connector"),
                      F.lit(kind).alias("kind"), "column_count", "fingerprint", "row_count"))


def schema_drift(old_cols: DataFrame, new_cols: DataFrame) -> DataFrame:
    """Added / removed / type-changed columns per table whose fingerprint changed.

    Tables present on one side only are not drift.  One full outer join on
    (table, column); the result is grouped per table.
    """
    o = old_cols.select("table_name", "column_name", F.col("dtype").alias("old_t"))
    n = new_cols.select("table_name", "column_name", F.col("dtype").alias("new_t"))
    both_tables = o.select("table_name").distinct().join(n.select("table_name").distinct(), "table_name")
    j = o.join(n, ["table_name", "column_name"], "full").join(both_tables, "table_name")
    g = j.groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("old_t").isNull(), F.col("column_name")))).alias("added_columns"),
        F.array_sort(F.collect_list(F.when(F.col("new_t").isNull(), F.col("column_name")))).alias("removed_columns"),
        F.array_sort(F.collect_list(F.when(F.col("old_t").isNotNull() & F.col("new_t").isNotNull()
                                           & (F.col("old_t") != F.col("new_t")), F.col("column_name"))))
         .alias("type_changed_columns"))
    of, nf = schema_fingerprint(old_cols), schema_fingerprint(new_cols)
    fp = of.withColumnRenamed("fingerprint", "old_fingerprint").join(
        nf.withColumnRenamed("fingerprint", "new_fingerprint"), "table_name")
    return (g.join(fp, "table_name").filter(F.col("old_fingerprint") != F.col("new_fingerprint"))
             .select("table_name", "old_fingerprint", "new_fingerprint", "added_columns", "removed_columns",
                     "type_changed_columns"))


def schema_diff(staged: DataFrame, dest: DataFrame) -> DataFrame:
    """Per-column difference of a staged output against its destination."""
    spark = staged.sparkSession
    s = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in staged.schema.fields],
                              "column string, staged_type string")
    d = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in dest.schema.fields],
                              "column string, dest_type string")
    j = s.join(d, "column", "full")
    change = (F.when(F.col("dest_type").isNull(), "added").when(F.col("staged_type").isNull(), "removed")
               .when(F.col("staged_type") != F.col("dest_type"), "type_changed"))
    return j.withColumn("change", change).filter(F.col("change").isNotNull()) \
            .select("column", "change", "staged_type", "dest_type")


# ---------------------------------------------------------------- edges (H5-H7)

def _edge_id(*cols: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("||", *cols), 256), 1, 32)


def explicit_edges(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Declared foreign keys ``(table_name, column_name, foreign_key="table.column")``
    joined to the known tables; unknown targets are skipped; confidence 1.0.

    Multi-column keys stay separate rows but share the constraint's edge id
    when a ``constraint`` column is given (D10).
    """
    fk = fks.filter(F.col("foreign_key").isNotNull())
    tgt = F.regexp_extract("foreign_key", r"^(.*)\.([^.]+)$", 1)
    tcol = F.regexp_extract("foreign_key", r"^(.*)\.([^.]+)$", 2)
    fk = fk.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"),
                   tgt.alias("target_table"), tcol.alias("target_column"),
                   (F.col("constraint") if "constraint" in fks.columns else F.col("column_name")).alias("_c"))
    known = tables.select(F.col("table_name").alias("target_table")).distinct()
    e = fk.join(known, "target_table")
    return e.select(
        _edge_id("source_table", "target_table", "_c").alias("edge_id"), "source_table", "target_table",
        F.lit("explicit").alias("kind"), "source_column", "target_column", F.lit(1.0).alias("confidence"),
        F.concat_ws("", F.lit("foreign key: "), F.col("source_table"), F.lit("."), F.col("source_column"),
                    F.lit(" references "), F.col("target_table"), F.lit("."), F.col("target_column")).alias("reasoning"),
        F.lit(False).alias("needs_confirmation"))


def _drop_existing(pairs: DataFrame, existing: DataFrame | None, a: str, b: str) -> DataFrame:
    """Drop table pairs that already have an edge, in either direction."""
    if existing is None:
        return pairs
    ex = existing.select(F.col("source_table").alias("_x"), F.col("target_table").alias("_y"))
    ex = ex.unionByName(ex.select(F.col("_y").alias("_x"), F.col("_x").alias("_y"))).distinct()
    return pairs.join(ex, (pairs[a] == ex["_x"]) & (pairs[b] == ex["_y"]), "left_anti")


def name_edges(cols: DataFrame, threshold: float = NAME_SIMILARITY_THRESHOLD,
               connector_col: str | None = "connector", existing: DataFrame | None = None) -> DataFrame:
    """Name-similarity edges between tables (on different connectors, if given).

    Per table pair the single best column pair wins (first pair by ordinal on
    ties); confidence = round(0.9·ratio, 3) with Python-style rounding.
    Table pairs that already have an edge in ``existing`` (either direction)
    are skipped.  Similar names come from the exact prefix-filtered
    similarity join, so column pairs are never enumerated per table pair.
    """
    c = cols.withColumn("_k", name_key("column_name"))
    pairs = similar_pairs(c.select(F.col("_k").alias("name")), c.select(F.col("_k").alias("name")), threshold)
    keep = ["table_name", "column_name", "ordinal", "_k"] + ([connector_col] if connector_col and connector_col in cols.columns else [])
    a = c.select(*[F.col(x).alias(f"a_{x}") for x in keep])
    b = c.select(*[F.col(x).alias(f"b_{x}") for x in keep])
    j = pairs.join(a, F.col("a") == F.col("a__k")).join(b, F.col("b") == F.col("b__k"))
    if connector_col and connector_col in cols.columns:
        # Source side = the table on the connector that sorts first.
        j = j.filter(F.col(f"a_{connector_col}") < F.col(f"b_{connector_col}"))
    else:
        j = j.filter(F.col("a_table_name") < F.col("b_table_name"))
    j = _drop_existing(j, existing, "a_table_name", "b_table_name")
    j = j.withColumn("confidence", round_half_even(F.col("ratio") * F.lit(NAME_CONFIDENCE_WEIGHT), 3))
    w = Window.partitionBy("a_table_name", "b_table_name").orderBy(
        F.col("confidence").desc(), F.col("a_ordinal"), F.col("b_ordinal"))
    best = j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return best.select(
        _edge_id("a_table_name", "b_table_name").alias("edge_id"),
        F.col("a_table_name").alias("source_table"), F.col("b_table_name").alias("target_table"),
        F.lit("inferred_name").alias("kind"),
        F.col("a_column_name").alias("source_column"), F.col("b_column_name").alias("target_column"),
        "confidence",
        F.concat_ws("", F.lit("similar names "), F.col("a_table_name"), F.lit("."), F.col("a_column_name"),
                    F.lit(" ~ "), F.col("b_table_name"), F.lit("."), F.col("b_column_name"),
                    F.lit(" (ratio "), F.format_number(F.col("ratio"), 2), F.lit(")")).alias("reasoning"),
        (F.col("confidence") < CONFIRMATION_THRESHOLD).alias("needs_confirmation"))


def value_overlap(tables: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Exact Jaccard and containment of distinct values for the given column pairs.

    ``pairs`` = (table_a, column_a, table_b, column_b); every pair has its row,
    pairs of different type families share nothing (see ``overlap``).
    """
    if not pairs:
        raise ValueError("no column pairs")
    columns = sorted({(t, c) for ta, ca, tb, cb in pairs for t, c in ((ta, ca), (tb, cb))})
    at = {key: i for i, key in enumerate(columns)}
    return overlaps({t: tables[t] for t, _ in columns}, columns, [(at[ta, ca], at[tb, cb]) for ta, ca, tb, cb in pairs])


def value_edges(overlap: DataFrame, name_conf: DataFrame | None = None) -> DataFrame:
    """Edges from value overlap: jaccard >= 0.5 gives round(0.4·name + 0.6·jaccard, 3)
    when that beats the name confidence (0 if there is no name edge)."""
    o = overlap
    if name_conf is not None:
        o = o.join(name_conf.select(F.col("source_table").alias("table_a"), F.col("source_column").alias("column_a"),
                                    F.col("target_table").alias("table_b"), F.col("target_column").alias("column_b"),
                                    F.col("confidence").alias("name_conf")),
                   ["table_a", "column_a", "table_b", "column_b"], "left")
    else:
        o = o.withColumn("name_conf", F.lit(None).cast("double"))
    nc = F.coalesce(F.col("name_conf"), F.lit(0.0))
    conf = round_half_even(F.lit(VALUE_NAME_WEIGHT) * nc + F.lit(VALUE_JACCARD_WEIGHT) * F.col("jaccard"), 3)
    o = o.withColumn("confidence", conf).filter((F.col("jaccard") >= VALUE_OVERLAP_THRESHOLD) & (F.col("confidence") > nc))
    return o.select(
        _edge_id("table_a", "table_b").alias("edge_id"), F.col("table_a").alias("source_table"),
        F.col("table_b").alias("target_table"), F.lit("inferred_value").alias("kind"),
        F.col("column_a").alias("source_column"), F.col("column_b").alias("target_column"), "confidence",
        F.concat_ws("", F.lit("shared values: jaccard "), F.format_number(F.col("jaccard"), 2),
                    F.lit(", containment "), F.format_number(F.col("containment"), 2)).alias("reasoning"),
        (F.col("confidence") < CONFIRMATION_THRESHOLD).alias("needs_confirmation"))


def infer_edges(tables: dict[str, DataFrame], cols: DataFrame,
                connector_col: str | None = "connector", existing: DataFrame | None = None) -> DataFrame:
    """H6 + H7 together: per table pair the best name-similarity edge, upgraded
    to a value edge when the Jaccard overlap of the two columns' full
    distinct values is >= 0.5 and the combined confidence beats the name
    confidence.  Only the best name pairs are value-checked (one row per table
    pair -- edge metadata reaches the driver, values never do)."""
    names = name_edges(cols, connector_col=connector_col, existing=existing)
    pairs = [(r["source_table"], r["source_column"], r["target_table"], r["target_column"])
             for r in names.select("source_table", "source_column", "target_table", "target_column").collect()]
    if not pairs:
        return names
    comparable = []
    for ta, ca, tb, cb in pairs:
        if type_family(dict(tables[ta].dtypes)[ca]) == type_family(dict(tables[tb].dtypes)[cb]) and \
                type_family(dict(tables[ta].dtypes)[ca]) in ("integer", "string"):
            comparable.append((ta, ca, tb, cb))
    if not comparable:
        return names
    upgraded = value_edges(value_overlap(tables, comparable), names)
    keys = ["source_table", "target_table"]
    kept = names.join(upgraded.select(*keys), keys, "left_anti")
    return kept.unionByName(upgraded.select(*EDGE_COLUMNS))


# ------------------------------------------------------- edge queries

def low_confidence(edges: DataFrame, threshold: float = CONFIRMATION_THRESHOLD,
                   min_confidence: float | None = None) -> DataFrame:
    """Edges below ``threshold`` with the confirmation flag; optional minimum filter."""
    e = edges
    if min_confidence is not None:
        e = e.filter(F.col("confidence") >= min_confidence)
    return e.filter(F.col("confidence") < threshold).withColumn(
        "needs_confirmation", (F.col("confidence") < threshold) & (F.col("kind") != "explicit"))


def neighbors(edges: DataFrame, node: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes adjacent to ``node`` with the direction of the connecting edge."""
    out = edges.filter(F.col(src) == node).select(F.col(dst).alias("neighbor"), F.lit("out").alias("direction"))
    inn = edges.filter(F.col(dst) == node).select(F.col(src).alias("neighbor"), F.lit("in").alias("direction"))
    return out.unionByName(inn).distinct()


# ------------------------------------------------------ name resolution

def resolve_names(names: DataFrame, candidates: DataFrame, name_col: str = "entity",
                  cand_name: str = "name", cand_qualified: str = "qualified_name") -> DataFrame:
    """Best candidate per entity: exact 1.0; case-insensitive 0.95; else best
    ratio over (name, last dotted part of qualified name) >= 0.60, flagged
    below 0.85; else unresolved with 0.0.

    Tiers 1-2 are equi-joins; tier 3 uses the exact prefix-filtered similarity
    join, so entities are never compared with every candidate.
    """
    e = names.select(F.col(name_col).alias("entity")).distinct()
    cq = F.col(cand_qualified) if cand_qualified in candidates.columns else F.col(cand_name)
    c = candidates.select(F.col(cand_name).alias("cname"), cq.alias("cqual"))
    def tier(key_e, key_c_name, key_c_qual, score: float, level: int) -> DataFrame:
        # Two equi-joins (name, qualified name) instead of one OR-join, which
        # would need a nested-loop join over every pair.
        ee = e.withColumn("_k", key_e)
        by_name = ee.join(c.withColumn("_k", key_c_name), "_k")
        by_qual = ee.join(c.withColumn("_k", key_c_qual), "_k")
        return (by_name.unionByName(by_qual).select("entity", "cname", "cqual").distinct()
                .select("entity", "cname", "cqual", F.lit(score).alias("score"), F.lit(level).alias("tier")))

    exact = tier(F.col("entity"), F.col("cname"), F.col("cqual"), EXACT_CONFIDENCE, 1)
    ci = tier(F.lower("entity"), F.lower("cname"), F.lower("cqual"), CASE_INSENSITIVE_CONFIDENCE, 2)
    el = e.select("entity", F.lower("entity").alias("el"))
    cl = c.select("cname", "cqual", F.lower("cname").alias("k1"),
                  F.element_at(F.split(F.lower("cqual"), r"\."), -1).alias("k2"))
    keys = cl.select(F.col("k1").alias("name")).unionByName(cl.select(F.col("k2").alias("name")))
    sim = similar_pairs(el.select(F.col("el").alias("name")), keys, RESOLUTION_THRESHOLD)
    s1 = sim.join(el, F.col("a") == F.col("el")).join(cl, F.col("b") == F.col("k1")).select(
        "entity", "cname", "cqual", F.col("ratio").alias("score"))
    s2 = sim.join(el, F.col("a") == F.col("el")).join(cl, F.col("b") == F.col("k2")).select(
        "entity", "cname", "cqual", F.col("ratio").alias("score"))
    fuzzy = s1.unionByName(s2).groupBy("entity", "cname", "cqual").agg(F.max("score").alias("score")) \
              .withColumn("tier", F.lit(3))
    allc = exact.unionByName(ci).unionByName(fuzzy)
    w = Window.partitionBy("entity").orderBy("tier", F.col("score").desc(), "cname", "cqual")
    best = allc.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    res = e.join(best, "entity", "left")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return res.select(
        "entity", F.col("cname").alias("resolved_name"), F.col("cqual").alias("resolved_qualified_name"),
        F.when(F.col("tier") == 3, round_half_even(score, 3)).otherwise(score).alias("confidence"),
        (F.col("tier").isNull() | ((F.col("tier") == 3) & (score < CONFIRMATION_THRESHOLD))).alias("needs_confirmation"))


# ------------------------------------------------------- join support

def check_joins(joins: DataFrame, edges: DataFrame) -> DataFrame:
    """Confidence of requested joins (left_table, right_table, left_key, right_key):
    an edge in either direction with matching keys gives its confidence;
    otherwise 0.70 and the join is flagged."""
    e = edges.select("source_table", "target_table", "source_column", "target_column", "confidence",
                     "needs_confirmation", "reasoning")
    fwd = e.select(F.col("source_table").alias("lt"), F.col("target_table").alias("rt"),
                   F.col("source_column").alias("lk"), F.col("target_column").alias("rk"), "confidence",
                   "needs_confirmation", "reasoning")
    rev = e.select(F.col("target_table").alias("lt"), F.col("source_table").alias("rt"),
                   F.col("target_column").alias("lk"), F.col("source_column").alias("rk"), "confidence",
                   "needs_confirmation", "reasoning")
    both = fwd.unionByName(rev).groupBy("lt", "rt", "lk", "rk").agg(
        F.max_by(F.struct("confidence", "needs_confirmation", "reasoning"), "confidence").alias("_e"))
    j = joins.join(both, (joins["left_table"] == both["lt"]) & (joins["right_table"] == both["rt"])
                   & (joins["left_key"] == both["lk"]) & (joins["right_key"] == both["rk"]), "left")
    return j.select("left_table", "right_table", "left_key", "right_key",
                    F.coalesce(F.col("_e.confidence"), F.lit(UNVERIFIED_JOIN_CONFIDENCE)).alias("confidence"),
                    F.coalesce(F.col("_e.needs_confirmation"), F.lit(True)).alias("needs_confirmation"),
                    F.coalesce(F.col("_e.reasoning"), F.concat(
                        F.lit("no edge supports "), F.col("left_table"), F.lit("."), F.col("left_key"), F.lit(" = "),
                        F.col("right_table"), F.lit("."), F.col("right_key"), F.lit("; confirm before use"))).alias("reasoning"))


# ----------------------------------------------------- mapping report

def type_family_col(dtype: Column) -> Column:
    """SQL-side twin of ``type_family`` for a column of type strings."""
    d = F.lower(dtype)
    return (F.when(d.isin("tinyint", "smallint", "int", "integer", "bigint", "long", "short", "byte"), "integer")
             .when(d.isin("float", "double", "real") | d.startswith("decimal"), "numeric")
             .when(d.startswith("timestamp"), "timestamp")
             .when((d == "string") | d.startswith("varchar") | d.startswith("char"), "string")
             .otherwise(F.regexp_extract(d, r"^([a-z_]+)", 1)))


def mapping_report(mappings: DataFrame, src_cols: DataFrame, dst_cols: DataFrame) -> DataFrame:
    """Per mapping (source_column, target_column, score): source and target
    types and a type-family mismatch flag, plus the overall confidence = mean
    of all scores of the mapping set (per ``target_table`` if given; 3
    decimals) on every row."""
    s = src_cols.select(F.col("column_name").alias("source_column"), F.col("dtype").alias("source_type"))
    d = dst_cols.select(F.col("column_name").alias("target_column"), F.col("dtype").alias("target_type"))
    j = mappings.join(s, "source_column", "left").join(d, "target_column", "left")
    j = j.withColumn("type_mismatch", F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
                     & (type_family_col(F.col("source_type")) != type_family_col(F.col("target_type"))))
    # Mean over the mapping set (one target table's columns: bounded metadata),
    # as a window instead of a join with the one-row aggregate.
    group = [F.col(c) for c in ("target_table",) if c in mappings.columns] or [F.lit(0)]
    return j.withColumn("overall_confidence",
                        round_half_even(F.avg("score").over(Window.partitionBy(*group)), 3))
