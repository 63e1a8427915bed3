"""Numbering and running sums inside groups of any size.

A window over the whole group would sort the group in one task. Here each
group is cut into ordered buckets: the sums of the buckets are prefix-summed
(a small table), and only the rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .maths import as_col

ID_BITS = 16
HASH_BITS = 20


def running(df: DataFrame, keys, levels, order, sums: dict, how: str = "sum") -> DataFrame:
    """Add inclusive running sums within ``keys`` in the order given by ``levels`` then ``order``.

    ``levels`` are expressions that cut the order into ever finer buckets; each
    must be non-decreasing along the order inside the bucket above it. With
    ``how`` 'max' the running maximum of non-null columns is kept instead.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    merge = (lambda a, b: a + b) if how == "sum" else F.greatest
    empty = F.lit(0) if how == "sum" else F.lit(float("-inf"))
    keys = list(keys)
    lv = [f"__l{i}" for i in range(len(levels))]
    vals = {name: f"__v{i}" for i, name in enumerate(sums)}
    for name, expr in zip(lv, levels):
        df = df.withColumn(name, as_col(expr))
    for name, expr in sums.items():
        df = df.withColumn(vals[name], as_col(expr))

    tables = [None] * len(lv)
    part = df
    for i in reversed(range(len(lv))):
        part = part.groupBy(*keys, *lv[: i + 1]).agg(*[fold(v).alias(v) for v in vals.values()])
        tables[i] = part

    offsets = None
    for i, table in enumerate(tables):
        w = W.partitionBy(*[F.col(k) for k in keys], *[F.col(c) for c in lv[:i]]) if keys or i else W.partitionBy(F.lit(0))
        w = w.orderBy(lv[i]).rowsBetween(W.unboundedPreceding, -1)
        here = table.select(
            *keys, *lv[: i + 1],
            *[F.coalesce(fold(v).over(w), empty).alias(f"{v}o{i}") for v in vals.values()])
        if offsets is None:
            offsets = here.withColumnsRenamed({f"{v}o0": f"{v}o" for v in vals.values()})
        else:
            offsets = _null_safe(here, offsets, keys + lv[:i])
            for v in vals.values():
                offsets = offsets.withColumn(f"{v}o", merge(F.col(f"{v}o"), F.col(f"{v}o{i}"))).drop(f"{v}o{i}")

    out = _null_safe(df, offsets, keys + lv)
    w = W.partitionBy(*keys, *lv).orderBy(*[as_col(o) for o in order]).rowsBetween(W.unboundedPreceding, 0)
    for name, v in vals.items():
        out = out.withColumn(name, merge(fold(v).over(w), F.col(f"{v}o")))
    return out.drop(*lv, *vals.values(), *[f"{v}o" for v in vals.values()])


def _null_safe(left: DataFrame, right: DataFrame, on) -> DataFrame:
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = None
    for c in on:
        term = left[c].eqNullSafe(right[f"__r_{c}"])
        cond = term if cond is None else cond & term
    return left.join(right, cond).drop(*[f"__r_{c}" for c in on])


def id_levels(column, bits: int = ID_BITS) -> list[Column]:
    """Bucket of a unique integer: at most 2**bits rows each."""
    return [F.shiftright(as_col(column).cast("long"), bits)]


def hash_levels(column, bits: int = HASH_BITS) -> list[Column]:
    """Bucket of a 32-bit hash: rows spread evenly over 2**(32-bits) buckets."""
    return [F.shiftright(as_col(column).cast("long"), bits)]


def score_levels(score, row_id, steps: int = 4096, descending: bool = True, bits: int = ID_BITS) -> list[Column]:
    """Buckets for an order by score, ties by id: coarse score, exact score, id bucket."""
    s = as_col(score).cast("double")
    s = -s if descending else s
    return [F.floor(s * steps), s, F.shiftright(as_col(row_id).cast("long"), bits)]


def number_rows(df: DataFrame, keys, order_id, name: str = "rn", levels=None, order=None) -> DataFrame:
    """1-based position of each row inside its group, in the order of a unique integer column."""
    return running(df, keys, levels or id_levels(order_id), order or [as_col(order_id)], {name: F.lit(1).cast("long")})


def number_by_hash(df: DataFrame, keys, hash_col, tie, name: str = "rn") -> DataFrame:
    """1-based position in the order of a hash column, ties by another column."""
    return running(df, keys, hash_levels(hash_col), [as_col(hash_col), as_col(tie)], {name: F.lit(1).cast("long")})
