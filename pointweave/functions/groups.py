"""Group statistics put next to the rows they came from.

The statistics are one row per group and come from a partial aggregate, so a
group of any size is never gathered. No broadcast is forced: adaptive
execution broadcasts the statistics when they are small and splits the large
groups of the row side when they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_stats(df: DataFrame, keys, **aggs) -> DataFrame:
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    if not keys:
        return df.withColumns({name: stats.select(name).scalar() for name in aggs})
    return df.join(stats, keys)


def top_per_group(df: DataFrame, keys, order, n: int = 1, rank: str | None = None) -> DataFrame:
    """The n first rows per group; Spark limits each map side before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order)
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def majority(df: DataFrame, keys, label: str, out: str | None = None) -> DataFrame:
    """Most frequent label per group, ties to the smallest label."""
    out = out or label
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(out))
