"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def squared_distance(left, right) -> Column:
    """Sum of squared differences of two equally long lists of columns."""
    terms = [(as_col(a) - as_col(b)) * (as_col(a) - as_col(b)) for a, b in zip(left, right)]
    return reduce(lambda a, b: a + b, terms)


def half_even(value) -> Column:
    """Rounding half to even, as a long."""
    return F.rint(as_col(value)).cast("long")


def six_digits(value) -> Column:
    """Six decimals by the same floating point steps any engine can repeat."""
    return F.floor(as_col(value) * 1e6 + 0.5) / F.lit(1e6)


def ratio(num, den, when_zero=0.0) -> Column:
    num, den = as_col(num), as_col(den)
    return F.when(den != 0, num / den).otherwise(F.lit(when_zero))


def argmax(scores) -> Column:
    """Position of the first maximum of an array column."""
    scores = as_col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def matrix_entry(matrix, row: int, col: int) -> Column:
    return as_col(matrix)[row][col]


def matrix_from_flat(flat, rows: int, cols: int) -> Column:
    flat = as_col(flat)
    return F.array(*[F.slice(flat, 1 + cols * i, cols) for i in range(rows)])


def matrix_product(a, b, n: int = 4) -> Column:
    a, b = as_col(a), as_col(b)
    return F.array(*[
        F.array(*[reduce(lambda p, q: p + q, [a[i][k] * b[k][j] for k in range(n)]) for j in range(n)])
        for i in range(n)
    ])


def rigid_inverse(m) -> Column:
    """Inverse of a 4x4 turn-and-shift matrix."""
    m = as_col(m)
    rows = []
    for i in range(3):
        shift = -(m[0][i] * m[0][3] + m[1][i] * m[1][3] + m[2][i] * m[2][3])
        rows.append(F.array(m[0][i], m[1][i], m[2][i], shift))
    rows.append(F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))
    return F.array(*rows)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda u, v: u.cast("double") * v.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def ladder(value, bounds) -> Column:
    """How many of the ascending bounds lie at or below the value."""
    return sum((F.when(as_col(value) >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def bind(df: DataFrame, struct: Column | None = None, **cols) -> DataFrame:
    """Add columns whose values are computed once per row.

    Plain projections are merged and filters are pushed through them by
    substitution, which repeats long formulas in every place that uses them. A
    one-row generator keeps the formula and its uses apart.
    """
    struct = struct if struct is not None else F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select("*", F.inline(F.array(struct)))
