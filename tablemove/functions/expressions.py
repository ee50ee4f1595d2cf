"""Column-expression helpers.  All of them are built-in Spark expressions, so
they stay inside whole-stage codegen (no Python UDF on the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the placeholder used by column-mapping templates, e.g.
# "UPPER({{source}})" or "CAST({{source}} AS DATE)".
SOURCE_PLACEHOLDER = "{{source}}"


def template_expr(template: str, source: str) -> Column:
    """Substitute the source column into a mapping template and parse it."""
    return F.expr(template.replace(SOURCE_PLACEHOLDER, f"`{source}`"))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two strings.

    Classic O(|a|·|b|) dynamic programme written with Spark's higher-order
    array functions: the outer ``aggregate`` walks the characters of ``a``, the
    inner one builds the next DP row over the positions of ``b``.  Runs in the
    JVM per row; no Python.
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    nb = F.length(b)
    init = F.array_repeat(F.lit(0), nb + 1)

    def step(row, ch):
        def inner(nr, j):
            same = F.substring(b, j, 1) == ch
            val = F.when(same, F.element_at(row, j) + 1).otherwise(
                F.greatest(F.element_at(row, j + 1), F.element_at(nr, j)))
            return F.array_append(nr, val)
        return F.aggregate(F.sequence(F.lit(1), F.greatest(nb, F.lit(1))), F.array(F.lit(0)),
                           lambda nr, j: F.when(j <= nb, inner(nr, j)).otherwise(nr))

    chars = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))
    final = F.aggregate(chars, init, step)
    return F.when(nb == 0, F.lit(0)).otherwise(F.element_at(final, nb + 1))


def similarity_ratio(a: Column | str, b: Column | str) -> Column:
    """Indel similarity ratio ``2·LCS(a,b) / (|a| + |b|)``; 1.0 for two empty strings.

    This is the normalised similarity of the Levenshtein "ratio" family (not
    Spark's ``levenshtein()`` edit distance).
    """
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs_length(a, b) / total)


def name_key(c: Column | str) -> Column:
    """Column-name normal form for name similarity: lower case, underscores removed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), "_", "")


def null_safe_differs(cols: list[str], left: str, right: str) -> Column:
    """True if any of ``cols`` differs between two aliases, NULL-safely."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def round_half_even(x: Column | str, digits: int = 3) -> Column:
    """Round a double like Python's ``round(x, digits)``: half-even on the exact binary value.

    Spark's ``round``/``bround`` look at the shortest decimal form, so
    0.875 * 0.9 (stored as 0.78749999999999997...) becomes 0.788 there but
    0.787 in Python.  Here the part after the point is scaled by 2^61 (exact
    for |x| >= 2^-9) to an integer and rounded with integer arithmetic; the
    whole part is added afterwards.  From 2^43 on, and for infinities and NaN,
    the value is returned as it is.
    """
    x = F.col(x) if isinstance(x, str) else x
    big = F.abs(x) >= F.lit(float(2 ** 43))  # NaN counts as larger than any number
    size = F.when(big, 0.0).otherwise(F.abs(x))
    whole = F.floor(size)
    two61 = F.lit(2 ** 61).cast("decimal(38,0)")
    scale = F.lit(10 ** digits).cast("decimal(38,0)")
    m = ((size - whole) * F.lit(float(2 ** 61))).cast("long").cast("decimal(38,0)")
    num = m * scale
    q = F.floor(num / two61).cast("decimal(38,0)")
    rem2 = (num - q * two61) * 2
    odd = F.pmod(q.cast("long") + whole * F.lit(10 ** digits), F.lit(2)) == 1
    up = (rem2 > two61) | ((rem2 == two61) & odd)
    n = q.cast("long") + F.when(up, 1).otherwise(0) + whole * F.lit(10 ** digits)
    res = n.cast("double") / F.lit(float(10 ** digits))
    return F.when(x.isNull(), None).when(big, x).otherwise(F.when(x < 0, -res).otherwise(res))
