"""Clusters of points: overlap, growth, scoring and panoptic statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.graphs import components, greedy_keep
from ..functions.groups import majority
from .neighbours import radius_join

SCAN = ("scan_id",)
XYZ = ("x", "y", "z")


def instance_iou(clusters: DataFrame, truth: DataFrame, by=SCAN, cluster="cluster", instance="instance") -> DataFrame:
    """Overlap of point sets (by, cluster, point_id) and (by, instance, point_id), pairs that share a point."""
    by = list(by)
    n_c = clusters.groupBy(*by, cluster).agg(F.count("*").alias("__nc"))
    n_t = truth.groupBy(*by, instance).agg(F.count("*").alias("__nt"))
    both = clusters.select(*by, cluster, "point_id").join(truth.select(*by, instance, "point_id"), by + ["point_id"])
    both = both.groupBy(*by, cluster, instance).agg(F.count("*").alias("__i"))
    both = both.join(n_c, by + [cluster]).join(n_t, by + [instance])
    return both.select(*by, cluster, instance, (F.col("__i") / (F.col("__nc") + F.col("__nt") - F.col("__i"))).alias("iou"))


def cluster_nms(clusters: DataFrame, points: DataFrame, t: float, min_points: int, min_score: float, by=SCAN) -> DataFrame:
    """Clusters by falling score, dropped when a kept one overlaps by more than t; then size and score limits.

    clusters(by, cluster, score), points(by, cluster, point_id).
    """
    by = list(by)
    other = points.withColumnRenamed("cluster", "other")
    pairs = instance_iou(points, other, by, "cluster", "other").where((F.col("iou") > t) & (F.col("cluster") != F.col("other")))
    s = clusters.select(*by, "cluster", "score")
    pairs = pairs.join(s, by + ["cluster"]).join(s.select(*by, F.col("cluster").alias("other"), F.col("score").alias("os")), by + ["other"])
    better = (F.col("score") > F.col("os")) | ((F.col("score") == F.col("os")) & (F.col("cluster") < F.col("other")))
    edges = pairs.where(better).select(F.struct(*by, "cluster").alias("winner"), F.struct(*by, F.col("other").alias("cluster")).alias("loser"))
    kept = clusters.join(greedy_keep(edges).select("id.*"), by + ["cluster"], "left_anti")
    size = points.groupBy(*by, "cluster").agg(F.count("*").alias("n_points"))
    return kept.join(size, by + ["cluster"]).where((F.col("n_points") >= min_points) & (F.col("score") > min_score))


def grow_regions(df: DataFrame, r: float, ignore=(), by=SCAN, label="label", point_id="point_id", parts: int = 4) -> DataFrame:
    """(by, point_id, region): points of one class linked within r, the region named by its smallest point id.

    Cells whose diagonal is r hold points that are all linked, so the graph is
    one of cells. Links between cells are first read off the boxes of sub-cells
    (all pairs closer than r, or none); only cell pairs left open compare points.
    """
    by = list(by)
    keys = by + [label]
    size = r / math.sqrt(3) * (1 - 1e-9)
    pts = df.where(~F.col(label).isin(*ignore)) if ignore else df
    pts = pts.select(*keys, point_id, *XYZ, *[F.floor(F.col(a) / size).alias(f"c{a}") for a in XYZ],
                     *[F.floor(F.col(a) / (size / parts)).alias(f"s{a}") for a in XYZ])
    cell, sub = [f"c{a}" for a in XYZ], [f"s{a}" for a in XYZ]
    name = pts.groupBy(*keys, *cell).agg(F.min(point_id).alias("cell"))
    pts = pts.join(name, keys + cell)

    boxes = pts.groupBy(*keys, "cell", *sub).agg(*[f(a).alias(f"{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    boxes = boxes.withColumns({a: (F.col(f"lo{a}") + F.col(f"hi{a}")) / 2 for a in XYZ})
    bounds = [f"{n}{a}" for a in XYZ for n in ("lo", "hi")]
    left = boxes.select(*keys, *XYZ, F.col("cell").alias("q"), *[F.col(c).alias(f"q{c}") for c in bounds])
    near = radius_join(left, boxes.select(*keys, *XYZ, "cell", *bounds), r + math.sqrt(3) * size / parts, keys, "q", "cell",
                       carry=bounds, q_carry=[f"q{c}" for c in bounds], size=r).where("q < cell")
    far = sum((F.greatest(F.col(f"hi{a}") - F.col(f"qlo{a}"), F.col(f"qhi{a}") - F.col(f"lo{a}")) ** 2 for a in XYZ), F.lit(0.0))
    gap = sum((F.greatest(F.col(f"lo{a}") - F.col(f"qhi{a}"), F.col(f"qlo{a}") - F.col(f"hi{a}"), F.lit(0.0)) ** 2 for a in XYZ), F.lit(0.0))
    near = near.withColumns({"__far": far, "__gap": gap}).where(F.col("__gap") <= r * r)
    pairs = near.groupBy(*keys, "q", "cell").agg(F.bool_or(F.col("__far") <= r * r).alias("sure"))
    sure = pairs.where("sure").select("q", "cell")
    open_ = pairs.where("NOT sure")
    a = open_.join(pts.select(*keys, F.col("cell").alias("q"), *[F.col(x).alias(f"q{x}") for x in XYZ]).distinct(), keys + ["q"])
    ab = a.join(pts.select(*keys, "cell", *XYZ).distinct(), keys + ["cell"])
    d2 = sum(((F.col(f"q{x}") - F.col(x)) * (F.col(f"q{x}") - F.col(x)) for x in XYZ), F.lit(0.0))
    checked = ab.where(d2 <= r * r).select("q", "cell").distinct()

    roots = components(sure.unionByName(checked), "q", "cell").withColumnRenamed("id", "cell")
    return pts.join(roots, "cell", "left").select(*by, point_id, label, F.coalesce("root", "cell").alias("region"))


def score_clusters(points: DataFrame, scores: DataFrame, by=SCAN, n: int = 6) -> DataFrame:
    """Score of a cluster: the largest class of its mean scores."""
    j = points.join(scores.select(*by, "point_id", "scores"), [*by, "point_id"])
    mean = j.groupBy(*by, "cluster").agg(*[F.avg(F.col("scores")[i]).alias(f"__m{i}") for i in range(n)])
    return mean.select(*by, "cluster", F.greatest(*[f"__m{i}" for i in range(n)]).alias("score"))


def instance_tables(pred_points: DataFrame, clusters: DataFrame, truth: DataFrame, by=SCAN) -> tuple[DataFrame, DataFrame]:
    """Predictions (by, cluster, class, score, point_id) and truth (by, instance, class, point_id); an instance has the class of its first point."""
    p = pred_points.join(clusters.select(*by, "cluster", "class", "score"), [*by, "cluster"])
    first = truth.groupBy(*by, "instance").agg(F.min_by("label", "point_id").alias("class"))
    t = truth.select(*by, "instance", "point_id").join(first, [*by, "instance"])
    return p.select(*by, "cluster", "class", "score", "point_id"), t.select(*by, "instance", "class", "point_id")


def panoptic_stats(pred_points: DataFrame, truth: DataFrame, t: float, by=SCAN) -> DataFrame:
    """acc: share of clusters whose best instance overlaps by t or more and has their majority class; pos, neg: hits and misses per true instance."""
    by = list(by)
    iou = instance_iou(pred_points, truth, by)
    best = iou.groupBy(*by, "cluster").agg(F.max(F.struct("iou", (-F.col("instance")).alias("i"))).alias("__b"))
    label = majority(pred_points.join(truth.select(*by, "point_id", "label"), by + ["point_id"]), by + ["cluster"], "label", "pred_class")
    first = truth.groupBy(*by, "instance").agg(F.min_by("label", "point_id").alias("true_class"))
    all_clusters = pred_points.select(*by, "cluster").distinct()
    c = all_clusters.join(best.select(*by, "cluster", "__b.iou", (-F.col("__b.i")).alias("instance")), by + ["cluster"], "left")
    c = c.join(label, by + ["cluster"], "left").join(first, by + ["instance"], "left")
    ok = F.coalesce((F.col("iou") >= t) & (F.col("pred_class") == F.col("true_class")), F.lit(False))
    n = truth.select(*by, "instance").distinct().groupBy(*by).agg(F.count("*").alias("__n"))
    out = c.groupBy(*by).agg(F.avg(ok.cast("double")).alias("acc"), F.sum(ok.cast("int")).alias("__tp"), F.count("*").alias("__c"))
    return out.join(n, by).select(*by, "acc", (F.col("__tp") / F.col("__n")).alias("pos"), ((F.col("__c") - F.col("__tp")) / F.col("__n")).alias("neg"))


def offset_errors(df: DataFrame, by=SCAN) -> DataFrame:
    """Mean L1 of predicted (px, py, pz) against true (tx, ty, tz) offsets and mean negative cosine."""
    p, t = [F.col(f"p{a}") for a in "xyz"], [F.col(f"t{a}") for a in "xyz"]
    l1 = F.abs(p[0] - t[0]) + F.abs(p[1] - t[1]) + F.abs(p[2] - t[2])
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) + 1e-8
    cos = (p[0] * t[0] + p[1] * t[1] + p[2] * t[2]) / (norm(p) * norm(t))
    return df.groupBy(*by).agg(F.avg(l1).alias("norm_loss"), F.avg(-cos).alias("dir_loss"))
