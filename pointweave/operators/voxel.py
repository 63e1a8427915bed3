"""Voxel and grid aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.groups import majority
from ..functions.maths import half_even
from ..functions.rand import key_hash

SCAN = ("scan_id",)
VOXEL = ("vx", "vy", "vz")


def quantize(df: DataFrame, size: float) -> DataFrame:
    """Integer voxel coordinates, half to even; the table itself keeps the full resolution."""
    return df.withColumns({f"v{a}": half_even(F.col(a) / size) for a in "xyz"})


def grid_sample(df: DataFrame, size: float, mode: str = "mean", by=SCAN, means=("x", "y", "z"), votes=("label",),
                flags=(), point_id="point_id", seed=None, coords: bool = False) -> DataFrame:
    """One row per voxel and scan.

    mean: means of the mean columns, majority of the vote columns (ties to the
    smallest), flags true when all are, and the largest id as representative.
    last: one whole point per voxel, the one with the largest id or, with a
    seed, the largest hash.
    """
    keys = [*by, *VOXEL]
    cells = quantize(df, size)
    if mode == "last":
        rank = F.col(point_id) if seed is None else F.struct(key_hash(seed, *by, point_id), F.col(point_id))
        rest = [c for c in df.columns if c not in by]
        out = cells.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__p")).select(*keys, "__p.*")
        return out if coords else out.drop(*VOXEL)
    if mode != "mean":
        raise ValueError(f"mode {mode!r} is neither 'mean' nor 'last'")
    out = _mean_and_votes(cells, keys, means, votes, flags, point_id)
    return out if coords else out.drop(*VOXEL)


def _mean_and_votes(cells, keys, means, votes, flags, point_id):
    if len(votes) == 1:
        # One pass: sums per (voxel, label), then the label sums are merged.
        label = votes[0]
        inner = cells.groupBy(*keys, label).agg(
            F.count("*").alias("__n"), *[F.sum(c).alias(c) for c in means],
            *[F.bool_and(c).alias(c) for c in flags], *([F.max(point_id).alias(point_id)] if point_id else []))
        return inner.groupBy(*keys).agg(
            *[(F.sum(c) / F.sum("__n")).alias(c) for c in means],
            F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(label),
            *[F.bool_and(c).alias(c) for c in flags], *([F.max(point_id).alias(point_id)] if point_id else []),
            F.sum("__n").alias("n"))
    out = cells.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in means], *[F.bool_and(c).alias(c) for c in flags],
        *([F.max(point_id).alias(point_id)] if point_id else []), F.count("*").alias("n"))
    for label in votes:
        out = out.join(majority(cells, keys, label), keys)
    return out


def grid_pool(df: DataFrame, size: float, by=SCAN, means=("x", "y", "z")) -> DataFrame:
    """Means per voxel with the voxel taken by floor."""
    cells = df.withColumns({f"v{a}": F.floor(F.col(a) / size) for a in "xyz"})
    return cells.groupBy(*by, *VOXEL).agg(*[F.avg(c).alias(c) for c in means], F.count("*").alias("n"))


def sampling_centres(df: DataFrame, res: float, by=SCAN) -> DataFrame:
    """Sampling centres of a window: the grid mean in xy with the majority label."""
    flat = df.withColumn("z", F.lit(0.0))
    return grid_sample(flat, res, by=by, coords=True).drop("vz", "z").withColumnRenamed("n", "n_points")


def label_counts(df: DataFrame, by=SCAN, label="label", totals: bool = False) -> DataFrame:
    """Rows per group and label, with totals by rollup on request."""
    keys = [*by, label]
    if totals:
        return df.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
