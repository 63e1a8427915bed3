"""Regions, crops and drops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.groups import top_per_group, with_stats
from ..functions.lineage import cut
from ..functions.maths import bind
from ..functions.prefix import number_by_hash, number_rows, running
from ..functions.rand import key_hash, uniform
from .neighbours import ball_join, knn_join, radius_join
from .voxel import grid_sample

SCAN = ("scan_id",)
XYZ = ("x", "y", "z")


def sphere_sample(points: DataFrame, centres: DataFrame, r: float, align=False, by=SCAN, cylinder=False, strict_inside=False, q_carry=()) -> DataFrame:
    """Points within r of each centre (by, centre_id, x, y, z): all centres in one join, with their columns ``q_carry`` last.

    ``align`` moves the centre to the origin; ``strict_inside`` leaves out points at distance 0.
    """
    axes = ("x", "y") if cylinder else XYZ
    carry = [c for c in points.columns if c not in by]
    cols = axes if align else ()
    c = centres.select(*by, "centre_id", *axes, *q_carry, *[F.col(a).alias(f"__o{a}") for a in cols])
    other = [x for x in carry if x not in axes]
    out = radius_join(c, points.withColumns({f"__p{a}": F.col(a) for a in axes}), r, by, "centre_id", "point_id", axes,
                      carry=[x for x in other if x != "point_id"] + [f"__p{a}" for a in axes], q_carry=[*q_carry, *(f"__o{a}" for a in cols)])
    if strict_inside:
        out = out.where("d2 > 0")
    out = out.withColumns({a: F.col(f"__p{a}") - F.col(f"__o{a}") if align else F.col(f"__p{a}") for a in axes})
    return out.select(*by, "centre_id", *carry, *q_carry)


def cylinder_sample(points, centres, r, align=False, by=SCAN) -> DataFrame:
    return sphere_sample(points, centres, r, align, by, cylinder=True)


def random_centre(points: DataFrame, seed, by=SCAN, balanced=False, label="label") -> DataFrame:
    """One random point per scan, uniform or with its class drawn by the root of its rarity."""
    rank = F.struct(key_hash(seed, *by, "point_id").alias("h"), F.col("point_id"))
    if not balanced:
        return points.groupBy(*by).agg(F.min_by(F.struct("point_id", *XYZ), rank).alias("c")).select(*by, F.col("c.point_id").alias("centre_id"), "c.x", "c.y", "c.z")
    # Largest log(u)/w picks a class with probability proportional to w = sqrt(mean/count), that is to 1/sqrt(count).
    per = points.groupBy(*by, label).agg(F.count("*").alias("n"), F.min_by(F.struct("point_id", *XYZ), rank).alias("c"))
    score = F.log(F.greatest(uniform(f"{seed}/class", *by, label), F.lit(1e-12))) * F.sqrt(F.col("n").cast("double"))
    return per.groupBy(*by).agg(F.max_by("c", F.struct(score.alias("s"), F.col(label))).alias("c")).select(*by, F.col("c.point_id").alias("centre_id"), "c.x", "c.y", "c.z")


def random_sphere(points, r, seed, balanced=False, by=SCAN, align=False) -> DataFrame:
    return sphere_sample(points, random_centre(points, seed, by, balanced), r, align, by)


def grid_centres(points: DataFrame, grid: float, by=SCAN) -> DataFrame:
    """Grid means as centres, each with the label of the nearest point."""
    c = grid_sample(points, grid, by=by).select(*by, F.col("point_id").alias("centre_id"), *XYZ)
    near = knn_join(c.withColumnRenamed("centre_id", "query_id"), points, 1, by)
    label = near.join(points.select(*by, "point_id", "label"), [*by, "point_id"]).select(*by, F.col("query_id").alias("centre_id"), F.col("label").alias("centre_label"))
    return c.join(label, [*by, "centre_id"])


def grid_spheres(points, r, grid, align=False, by=SCAN) -> DataFrame:
    """The points about each grid mean, with the label of its centre, which goes with the centre into the one join."""
    c = grid_centres(points, grid, by)
    labels = c.groupBy(*by, "centre_id").agg(F.collect_list(F.struct("centre_label")).alias("__labels"))
    c = c.drop("centre_label").join(labels, [*by, "centre_id"])
    out = sphere_sample(points, c, r, align, by, q_carry=("__labels",))
    return out.withColumn("__labels", F.explode("__labels")).select(*out.columns[:-1], "__labels.centre_label")


def grid_cylinders(points, r, grid, align=False, by=SCAN) -> DataFrame:
    """As grid_spheres about the distinct xy of the grid means."""
    c = grid_sample(points, grid, by=by).groupBy(*by, "x", "y").agg(F.min("point_id").alias("centre_id"))
    return cylinder_sample(points, c, r, align, by)


def cylinder_index(centres: DataFrame, window="window_id", centre="centre_id") -> DataFrame:
    """Global index of every (window, centre)."""
    out = running(centres.select(window, centre), [], [F.col(window), F.shiftright(centre, 16)], [F.col(centre)], {"index": F.lit(1).cast("long")})
    return out.withColumn("index", F.col("index") - 1)


# ------------------------------------------------------------------ counts

def random_points(df: DataFrame, n: int, seed, replace=False, by=SCAN) -> DataFrame:
    """n random points per scan; with replacement, n draws even from a smaller scan."""
    if not replace:
        keyed = df.withColumn("__h", key_hash(seed, *by, "point_id"))
        return number_by_hash(keyed, by, "__h", "point_id", "__rn").where(F.col("__rn") <= n).drop("__rn", "__h")
    size = df.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = size.withColumn("__rn", key_hash(seed, *by, "draw") % F.col("__n") + 1).drop("__n")
    return draws.join(number_rows(df, by, "point_id", "__rn"), [*by, "__rn"]).drop("__rn")


def random_drop(df: DataFrame, ratio: float, p: float, seed, by=SCAN) -> DataFrame:
    """With chance p per scan keep int(N (1 - ratio)) random points."""
    keyed = with_stats(df, by, __n=F.count("*")).withColumn("__h", key_hash(seed, *by, "point_id"))
    ranked = number_by_hash(keyed, by, "__h", "point_id", "__rn")
    hit = uniform(f"{seed}/scan", *by) < p
    return ranked.where(~hit | (F.col("__rn") <= F.floor(F.col("__n") * (1 - ratio)))).drop("__n", "__h", "__rn")


def select_points(df: DataFrame, ids: DataFrame, by=SCAN) -> DataFrame:
    """Rows by a table (by, new_id, point_id), repeats allowed."""
    return df.join(ids, [*by, "point_id"])


def fps(df: DataFrame, n: int, by=SCAN, width: int = 1024) -> DataFrame:
    """Farthest point sampling, n per scan from the lowest id on: (by, turn, point_id).

    A round takes the ``width`` farthest points of each scan and runs the greedy
    choice among them as long as the best is farther than all points outside
    that set, so its picks are exactly those of the one-by-one form. The picks
    of a round, at most ``width`` per scan, then update all distances at once.
    """
    by = list(by)
    pts = df.select(*by, "point_id", *XYZ)
    first = pts.groupBy(*by).agg(F.min(F.struct("point_id", *XYZ)).alias("c"), F.count("*").alias("__n"))
    first = cut(first.select(*by, F.lit(0).alias("turn"), F.col("c.point_id").alias("point_id"), "c.x", "c.y", "c.z", "__n"))
    picked = first.drop("__n")
    want = first.select(*by, F.least(F.col("__n"), F.lit(n)).alias("__want"))
    fresh, d = picked, pts.withColumn("__d", F.lit(float("inf")))
    names = by

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__d", "point_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        xyz, dist, ids = pdf[["x", "y", "z"]].to_numpy(), pdf["__d"].to_numpy().copy(), pdf["point_id"].to_numpy()
        floor = dist[-1] if len(pdf) >= width else -1.0
        done, goal, out = int(pdf["__done"].iloc[0]), int(pdf["__want"].iloc[0]), []
        while done + len(out) < goal:
            best = np.flatnonzero(dist == dist.max())
            i = best[ids[best].argmin()]
            if out and dist[i] <= floor or dist[i] < 0:
                break
            out.append(i)
            step = xyz - xyz[i]
            dist = np.minimum(dist, step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1] + step[:, 2] * step[:, 2])
            dist[i] = -1.0
        r = pdf.iloc[out][names + ["point_id", "x", "y", "z"]].copy()
        r["turn"] = np.arange(done, done + len(out), dtype="int32")
        return r[names + ["turn", "point_id", "x", "y", "z"]]

    schema = picked.schema
    while True:
        new = fresh.groupBy(*by).agg(F.collect_list(F.struct("point_id", *XYZ)).alias("__new"))
        gap = lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"]) + (F.col("z") - c["z"]) * (F.col("z") - c["z"])
        d = d.join(new, by)
        taken = F.exists("__new", lambda c: c["point_id"] == F.col("point_id"))
        d = d.where(~taken).withColumn("__d", F.least("__d", F.array_min(F.transform("__new", gap)))).drop("__new")
        done = picked.groupBy(*by).agg(F.count("*").alias("__done"))
        d = cut(d.join(done.join(want, by).where("__done < __want").select(*by), by, "left_semi"))
        top = top_per_group(d, by, [F.col("__d").desc(), F.col("point_id")], width).join(done, by).join(want, by)
        fresh = cut(top.groupBy(*by).applyInPandas(greedy, schema))
        if fresh.isEmpty():
            return picked.select(*by, "turn", "point_id")
        picked = cut(picked.unionByName(fresh))


# ------------------------------------------------------------------ drops and crops

def sphere_dropout(df: DataFrame, centres: DataFrame, r: float, fixed=False, by=SCAN) -> DataFrame:
    """Drop points inside the spheres; the fixed form spares a point exactly at a centre."""
    hit = radius_join(centres.select(*by, "centre_id", *XYZ), df, r, by, "centre_id")
    hit = hit.where("d2 > 0") if fixed else hit
    return df.join(hit.select(*by, "point_id").distinct(), [*by, "point_id"], "left_anti")


def sphere_crop(df: DataFrame, r: float, seed, by=SCAN) -> DataFrame:
    """Keep points within r of a random point, the point itself excepted."""
    c = random_centre(df, seed, by).select(*by, *[F.col(a).alias(f"__{a}") for a in XYZ])
    j = df.join(c, list(by))
    d2 = sum(((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in XYZ), F.lit(0.0))
    j = bind(j, __d=d2).where((F.col("__d") > 0) & (F.col("__d") <= r * r))
    return j.drop("__d", *[f"__{a}" for a in XYZ])


def _about_random_point(df, rot_deg, seed, by):
    """Coordinates __x.. relative to a random point of the scan, turned by random angles up to rot_deg."""
    c = random_centre(df, seed, by)
    ang = [(uniform(f"{seed}/{a}", *by) - 0.5) * 2 * math.radians(rot_deg) for a in XYZ]
    ca, sa = [F.cos(t) for t in ang], [F.sin(t) for t in ang]
    m = {"m11": ca[2] * ca[1], "m12": ca[2] * sa[1] * sa[0] - sa[2] * ca[0], "m13": ca[2] * sa[1] * ca[0] + sa[2] * sa[0],
         "m21": sa[2] * ca[1], "m22": sa[2] * sa[1] * sa[0] + ca[2] * ca[0], "m23": sa[2] * sa[1] * ca[0] - ca[2] * sa[0],
         "m31": -sa[1], "m32": ca[1] * sa[0], "m33": ca[1] * ca[0]}
    c = c.select(*by, *[F.col(a).alias(f"__o{a}") for a in XYZ], *[e.alias(f"__{n}") for n, e in m.items()])
    j = df.join(c, list(by))
    d = [F.col(a) - F.col(f"__o{a}") for a in XYZ]
    j = bind(j, **{f"__{a}": F.col(f"__m{i}1") * d[0] + F.col(f"__m{i}2") * d[1] + F.col(f"__m{i}3") * d[2] for i, a in zip((1, 2, 3), XYZ)})
    return j, [f"__o{a}" for a in XYZ] + [f"__{n}" for n in m] + [f"__{a}" for a in XYZ]


def cube_crop(df, c: float, rot_deg: float, seed, by=SCAN) -> DataFrame:
    """Points strictly inside a turned cube of half side c about a random point."""
    j, extra = _about_random_point(df, rot_deg, seed, by)
    return j.where((F.abs("__x") < c) & (F.abs("__y") < c) & (F.abs("__z") < c)).drop(*extra)


def ellipsoid_crop(df, a: float, b: float, c: float, rot_deg: float, seed, by=SCAN) -> DataFrame:
    """Points inside a turned ellipsoid about a random point."""
    j, extra = _about_random_point(df, rot_deg, seed, by)
    s = F.col("__x") * F.col("__x") / (a * a) + F.col("__y") * F.col("__y") / (b * b) + F.col("__z") * F.col("__z") / (c * c)
    return j.where(s < 1).drop(*extra)


def density_filter(df: DataFrame, r: float, m: int, by=SCAN) -> DataFrame:
    """Points with more than m others within r; copies at the same place do not count.

    Points of one cell whose diagonal is r are all within r of each other, so a cell with enough of them settles its
    points by its count. Only the others, at most m places a cell, meet their neighbours one by one.
    """
    by = list(by)
    on = by + [f"__c{a}" for a in XYZ]
    finite = [F.abs(a) < F.lit(float("inf")) for a in XYZ]
    places = df.where(finite[0] & finite[1] & finite[2]).groupBy(*by, *XYZ).agg(F.count("*").alias("__m"))
    places = places.withColumns({f"__c{a}": F.floor(F.col(a) / (r / math.sqrt(3) * (1 - 1e-6))).cast("long") for a in XYZ})
    places = cut(places.join(places.groupBy(*on).agg(F.sum("__m").alias("__all")), on).withColumn("__same", F.col("__m")))
    settled = F.col("__all") - F.col("__same") > m
    few = places.where(~settled).select(*by, F.struct(*XYZ).alias("__at"), *XYZ, "__same")
    near = radius_join(few, places.select(*by, *XYZ, "__m"), r, by, "__at", "__m", q_carry=("__same",))
    near = near.groupBy(*by, "__at", "__same").agg(F.sum("__m").alias("n")).where(F.col("n") - F.col("__same") > m)
    good = places.where(settled).select(*by, *XYZ).unionByName(near.select(*by, "__at.*"))
    ids = df.join(good, [*by, *XYZ], "left_semi").select(*by, "point_id")
    return df.join(ids, [*by, "point_id"], "left_semi")


def irregular_sample(df: DataFrame, d_half: float, p: float, seed, by=SCAN) -> DataFrame:
    """Keep with probability exp(-sum |d|^p / (2 s2)), s2 = d_half^p / (2 ln 2), about a random point."""
    c = random_centre(df, f"{seed}/centre", by).select(*by, *[F.col(a).alias(f"__{a}") for a in XYZ])
    j = df.join(c, list(by))
    s2 = d_half ** p / (2 * math.log(2))
    d = sum((F.pow(F.abs(F.col(a) - F.col(f"__{a}")), F.lit(float(p))) for a in XYZ), F.lit(0.0))
    return j.where(uniform(seed, *by, "point_id") < F.exp(-d / (2 * s2))).drop(*[f"__{a}" for a in XYZ])


def periodic_sample(df: DataFrame, period: float, prop: float, box: float, seed, by=SCAN) -> DataFrame:
    """Keep where cos(2 pi d / period) > cos(pi prop), d to a random centre in a box about the origin."""
    c = [(uniform(f"{seed}/{a}", *by) - 0.5) * 2 * box for a in XYZ]
    d2 = sum(((F.col(a) - e) * (F.col(a) - e) for a, e in zip(XYZ, c)), F.lit(0.0))
    return df.where(F.cos(F.sqrt(d2) * (2 * math.pi / period)) > math.cos(math.pi * prop))


def random_walk_drop(df: DataFrame, num_iter: int, ratio: float, r: float, seed, by=SCAN, max_n: int | None = None) -> DataFrame:
    """Drop the points met by a walk of num_iter steps on the radius graph that restarts with chance ratio.

    A restart forgets where the walk was, so it is cut at as many places as it is expected to restart, and the parts of
    all scans take their steps side by side. Points without neighbours restart at once. Of the graph only the edges of the
    points where a walk stands are made, step by step.
    """
    by = list(by)
    pts = df.select(*by, "point_id", *XYZ)
    places = cut(number_rows(pts.select(*by, "point_id"), by, "point_id", "__no"))
    size = cut(places.groupBy(*by).agg(F.max("__no").alias("__n")))
    walks = max(1, math.ceil(num_iter * ratio))

    def jump(rows, step):
        at = rows.join(size, by).withColumn("__no", key_hash(f"{seed}/jump/{step}", *by, "walk") % F.col("__n") + 1)
        return at.join(places, by + ["__no"]).select(*by, "walk", "point_id")

    def edges_of(here):
        asked = pts.join(here.select(*by, "point_id").distinct(), by + ["point_id"], "left_semi")
        edges = ball_join(asked.withColumnRenamed("point_id", "query_id"), pts, r, max_n, by).where("d2 > 0")
        ranked = number_by_hash(edges.withColumn("__h", key_hash("edge", "query_id", "point_id")), by + ["query_id"], "__h", "point_id", "rank")
        return cut(ranked.select(*by, "query_id", "rank", "point_id"))

    here = cut(jump(size.select(*by, F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk")), 0))
    met = here.select(*by, "point_id").distinct()
    for step in range(1, -(-num_iter // walks)):
        edges = edges_of(here)
        degree = edges.groupBy(*by, "query_id").agg(F.max("rank").alias("__deg"))
        at = here.withColumnRenamed("point_id", "query_id").join(degree, by + ["query_id"], "left")
        again = (uniform(f"{seed}/stop/{step}", *by, "walk") < ratio) | F.col("__deg").isNull()
        on = at.where(~again).withColumn("rank", key_hash(f"{seed}/{step}", *by, "walk") % F.col("__deg") + 1)
        moved = on.join(edges, by + ["query_id", "rank"]).select(*by, "walk", "point_id")
        here = cut(moved.unionByName(jump(at.where(again).select(*by, "walk"), step)))
        met = met.unionByName(here.select(*by, "point_id"))
        if step % 16 == 0:
            met = cut(met.distinct())
    return df.join(met.distinct(), by + ["point_id"], "left_anti")


def patches(df: DataFrame, keypoints: DataFrame, r: float, by=SCAN) -> DataFrame:
    """The points around each key point, the key point itself excepted, with all columns."""
    return sphere_sample(df, keypoints, r, by=by, strict_inside=True)
