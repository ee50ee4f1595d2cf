"""Value overlap of columns (H7): every pair of columns at once, without copying values per pair.

A value of any column becomes its comparable form (a digest of it if long), so
that equal numbers meet whatever their type.  One hash aggregate by value, combined
map-side, finds the set of columns that hold it as a bit mask; sets that occur are
counted, and only these counts, not the values, are expanded to pairs.  Each value
is shuffled once however many pairs there are (twice, in a catalogue too wide for masks).

For wide catalogues mergeable theta sketches, one per column from the same pass, rule
out pairs whose Jaccard index cannot reach a bound; exact counts then run over
the columns that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Theta sketches of 2**12 entries: a standard error of 1/64 of the union, and as many of them as slack.
SKETCH_LOG_SIZE, SLACK = 12, 5 / 64
#: Up to this many columns, the columns that hold a value are bits of 64-bit words.
MASKED_COLUMNS = 256
#: Forms from this length on become digests of this length.
DIGEST_BYTES = 32


def value_family(dtype: T.DataType) -> str:
    """What a column's values can be compared with: numbers, times, texts, truth values, or values of the same type."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "boolean" if isinstance(dtype, T.BooleanType) else dtype.simpleString()


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A value's family and common form in bytes, as they are while shorter than a digest, else their SHA-256; NULL for NULL.

    Whole numbers compare by their digits, other numbers as doubles; dates as
    the timestamp of their midnight.
    """
    family, text = value_family(dtype), value.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < F.lit(9e18))
        text = F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))
    elif isinstance(dtype, T.DecimalType):
        text = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("double").cast("string"))
    elif family == "time":
        text = value.cast("timestamp_ntz").cast("string")
    form = F.concat(F.lit(family + ":"), text).cast("binary")
    return F.when(F.octet_length(form) < DIGEST_BYTES, form).otherwise(F.unhex(F.sha2(form, 256)))


def column_values(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Non-NULL rows (c, v): the number of a column in ``columns`` (table, column), and a value's comparable form; one scan per table."""
    number = {key: i for i, key in enumerate(columns)}
    out = None
    for t in dict.fromkeys(t for t, _ in columns):
        df = tables[t]
        own = [F.struct(F.lit(number[t, c]).alias("c"), comparable(F.col(f"`{c}`"), df.schema[c].dataType).alias("v")) for tt, c in columns if tt == t]
        one = df.select(F.explode(F.array(*own)).alias("x")).select("x.c", "x.v").where(F.col("v").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def pair_counts(values: DataFrame, n_columns: int) -> DataFrame:
    """(a, b, n): how many distinct values columns a <= b < ``n_columns`` share; with a = b a column's own."""
    if n_columns <= MASKED_COLUMNS:
        words = [f"w{k}" for k in range(-(-n_columns // 64))]
        bit = F.expr("shiftleft(1L, c % 64)")
        held = values.groupBy("v").agg(*[F.bit_or(F.when(F.floor(F.col("c") / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(w) for k, w in enumerate(words)])
        bits = [F.when(F.col(words[c // 64]).bitwiseAND(F.expr(f"shiftleft(1L, {c % 64})")) != 0, F.lit(c)) for c in range(n_columns)]
        sets = held.groupBy(*words).agg(F.count("*").alias("n")).select(F.array_compact(F.array(*bits)).alias("columns"), "n")
    else:
        held = values.distinct().groupBy("v").agg(F.sort_array(F.collect_set("c")).alias("columns"))
        sets = held.groupBy("columns").agg(F.count("*").alias("n"))
    first = sets.select("columns", "n", F.posexplode("columns").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(columns, i + 1, size(columns))")).alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def column_sketches(values: DataFrame) -> DataFrame:
    """(c, sketch): a mergeable theta sketch of each column's values."""
    return values.groupBy("c").agg(F.theta_sketch_agg("v", SKETCH_LOG_SIZE).alias("sketch"))


def likely_pairs(values: DataFrame, families: DataFrame, least_jaccard: float) -> DataFrame:
    """(a, b) of columns of one family that may reach ``least_jaccard``; ``families`` is (c, family).

    A sketch that holds all of a column's values is exact; beyond that the
    bound is lowered by five standard errors.
    """
    known = column_sketches(values).join(families, "c")
    a, b = known.select(F.col("c").alias("a"), "family", F.col("sketch").alias("x")), known.select(F.col("c").alias("b"), "family", F.col("sketch").alias("y"))
    both = a.join(b, "family").where("a < b")  # a row per column on either side
    share = F.theta_sketch_estimate(F.theta_intersection("x", "y")) / F.greatest(F.lit(1), F.theta_sketch_estimate(F.theta_union("x", "y", SKETCH_LOG_SIZE)))
    return both.where(share >= least_jaccard - SLACK).select("a", "b")


def overlaps(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(table_a, column_a, table_b, column_b, n_a, n_b, n_both, jaccard, containment) of the given pairs of ``columns``.

    A row for every pair: values of different families are never equal, a column without values shares none.
    """
    spark = next(iter(tables.values())).sparkSession
    counts = pair_counts(column_values(tables, columns), len(columns))
    wanted = spark.createDataFrame([(i, min(p), max(p), *columns[p[0]], *columns[p[1]], p[0] > p[1]) for i, p in enumerate(pairs)],
                                   "pair long, a int, b int, table_a string, column_a string, table_b string, column_b string, turned boolean")
    sides = F.explode(F.array(F.struct(F.col("a"), F.col("a").alias("b"), F.lit(0).alias("what")), F.struct(F.col("b").alias("a"), "b", F.lit(1).alias("what")),
                              F.struct("a", "b", F.lit(2).alias("what"))))
    asked = wanted.select("pair", sides.alias("s")).select("pair", "s.*").join(counts, ["a", "b"], "left")
    n = lambda k: F.coalesce(F.max(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).cast("long")
    found = wanted.join(asked.groupBy("pair").agg(n(0).alias("n_low"), n(1).alias("n_high"), n(2).alias("n_both")), "pair")
    out = found.select("table_a", "column_a", "table_b", "column_b", F.when(F.col("turned"), F.col("n_high")).otherwise(F.col("n_low")).alias("n_a"),
                       F.when(F.col("turned"), F.col("n_low")).otherwise(F.col("n_high")).alias("n_b"), "n_both")
    union, least = F.col("n_a") + F.col("n_b") - F.col("n_both"), F.least("n_a", "n_b")
    return out.withColumns({"jaccard": F.when(union > 0, F.col("n_both") / union).otherwise(F.lit(0.0)),
                            "containment": F.when(least > 0, F.col("n_both") / least).otherwise(F.lit(0.0))})


def value_overlap_all(tables: dict[str, DataFrame], least_jaccard: float | None = None) -> DataFrame:
    """Overlap of all pairs of columns of ``tables``; with ``least_jaccard`` only pairs that reach it.

    With a bound, sketches choose the pairs first (a row per pair chosen comes to
    the driver, column metadata), and only their columns are counted.
    """
    columns = sorted((t, c) for t, df in tables.items() for c in df.columns)
    if least_jaccard is None:
        return overlaps(tables, columns, [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))])
    spark = next(iter(tables.values())).sparkSession
    families = spark.createDataFrame([(i, value_family(tables[t].schema[c].dataType)) for i, (t, c) in enumerate(columns)], "c int, family string")
    chosen = sorted((r["a"], r["b"]) for r in likely_pairs(column_values(tables, columns), families, least_jaccard).collect())
    used = sorted({i for p in chosen for i in p})
    at = {c: i for i, c in enumerate(used)}
    if not chosen:
        chosen, used, at = [(0, 1)], [0, 1], {0: 0, 1: 1}  # no pair: an empty result with the same columns
    return overlaps(tables, [columns[i] for i in used], [(at[a], at[b]) for a, b in chosen]).where(F.col("jaccard") >= least_jaccard)
