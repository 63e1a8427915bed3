"""Pooling of view values to points, and fusion with point features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.maths import as_col
from ..functions.rand import uniform

_HOW = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def pool(df: DataFrame, keys, cols, how="mean", all_keys: DataFrame | None = None) -> DataFrame:
    """sum, mean, min or max per group; keys without rows give 0."""
    out = df.groupBy(*keys).agg(*[_HOW[how](c).alias(c) for c in cols])
    if all_keys is None:
        return out
    return all_keys.select(*keys).join(out, list(keys), "left").na.fill(0.0, list(cols))


def pool_by(df: DataFrame, keys, feature: str, cols, how="max", tie="image_id", all_keys=None) -> DataFrame:
    """Values of the view with the largest or smallest feature, ties to the lowest image; unseen is 0."""
    f = F.col(feature)
    order = F.struct(f.alias("f"), (-F.col(tie)).alias("t")) if how == "max" else F.struct((-f).alias("f"), (-F.col(tie)).alias("t"))
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("__v")).select(*keys, "__v.*")
    if all_keys is None:
        return out
    return all_keys.select(*keys).join(out, list(keys), "left").na.fill(0.0, list(cols))


def softmax_over(df: DataFrame, score: str, keys, scaling=False, out="weight") -> DataFrame:
    """exp(s - max)/(sum + 1e-12) in the group, s divided by the root of the group size first when asked.

    A group is the views of one point.
    """
    w = W.partitionBy(*keys)
    s = F.col(score)
    df = df.withColumns({"__top": F.max(score).over(w), "__n": F.count("*").over(w)})
    shift = s - F.col("__top")
    df = df.withColumn("__e", F.exp(shift / F.sqrt("__n") if scaling else shift))
    return df.withColumn(out, F.col("__e") / (F.sum("__e").over(w) + 1e-12)).drop("__top", "__n", "__e")


def dot_scores(df: DataFrame, query, key, out="score") -> DataFrame:
    """Dot product of two vector columns over the root of their length."""
    q, k = as_col(query), as_col(key)
    s = F.aggregate(F.zip_with(q, k, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return df.withColumn(out, s / F.sqrt(F.size(q).cast("double")))


def attention_pool(df: DataFrame, keys, scores, values, gate: tuple | None = None) -> DataFrame:
    """Softmax-weighted sums; g score columns share the channels by floor sizes, the first groups taking the rest.

    gate = (w, b) multiplies each group's result by tanh(relu(w * max score + b)).
    """
    g, c = len(scores), len(values)
    size, rest = divmod(c, g)
    groups = [i for i in range(g) for _ in range(size + (1 if i < rest else 0))]
    for i, s in enumerate(scores):
        df = softmax_over(df, s, keys, out=f"__w{i}")
    out = df.groupBy(*keys).agg(
        *[F.sum(F.col(f"__w{i}") * F.col(v)).alias(v) for v, i in zip(values, groups)],
        *[F.max(s).alias(f"__t{i}") for i, s in enumerate(scores)])
    if gate:
        w, b = gate
        open_ = lambda i: F.tanh(F.greatest(F.col(f"__t{i}") * w + b, F.lit(0.0)))
        out = out.withColumns({v: F.col(v) * open_(i) for v, i in zip(values, groups)})
    return out.drop(*[f"__t{i}" for i in range(g)])


def set_features(df: DataFrame, cols, keys) -> DataFrame:
    """Distance to the minimum and maximum of the set and the root of 1/(n + 0.001)."""
    w = W.partitionBy(*keys)
    new = {f"{c}_above_min": F.col(c) - F.min(c).over(w) for c in cols}
    new |= {f"{c}_below_max": F.col(c) - F.max(c).over(w) for c in cols}
    return df.withColumns({**new, "set_size": F.sqrt(1.0 / (F.count("*").over(w) + 0.001))})


def fuse_features(a: DataFrame, b: DataFrame, keys, a_cols, b_cols, mode="residual") -> DataFrame:
    """Join point features a with modality features b: residual a+b, concatenation, both, or modality only."""
    right = b.select(*keys, *[F.col(c).alias(f"__b{i}") for i, c in enumerate(b_cols)])
    j = a.join(right, list(keys), "left").na.fill(0.0, [f"__b{i}" for i in range(len(b_cols))])
    cat = {f"mod_{c}": F.col(f"__b{i}") for i, c in enumerate(b_cols)}
    add = {c: F.col(c) + F.col(f"__b{i}") for i, c in enumerate(a_cols)} if len(a_cols) == len(b_cols) else {}
    if mode == "residual":
        new, keep = add, list(a_cols)
    elif mode == "concatenation":
        new, keep = cat, [*a_cols, *cat]
    elif mode == "both":
        new, keep = {**add, **cat}, [*a_cols, *cat]
    elif mode == "modality":
        new, keep = cat, list(cat)
    else:
        raise ValueError(f"unknown fusion {mode!r}")
    return j.withColumns(new).select(*keys, *keep)


def multi_view_features(points: DataFrame, maps: DataFrame, pixels: DataFrame, point_cols, values=("r", "g", "b"),
                        by=("scan_id",), mode="concatenation") -> DataFrame:
    """Pixels to views (max), views to points (mean), fused with the point features; unseen points take zeros."""
    from .images import gather

    keys = [*by, "point_id"]
    at = gather(maps, pixels, values)
    view = pool(at, [*keys, "image_id"], values, "max")
    point = pool(view, keys, values, "mean")
    return fuse_features(points.select(*keys, *point_cols), point, keys, list(point_cols), list(values), mode)


def drop_side(df: DataFrame, cols, p: float, seed, keys=("scan_id",)) -> DataFrame:
    """Zero all listed columns of a scan with chance p."""
    gone = uniform(seed, *keys) < p
    return df.withColumns({c: F.when(gone, F.lit(0.0)).otherwise(F.col(c)) for c in cols})
