"""Selecting, cropping and rolling images by their mapping; pixel columns."""

from __future__ import annotations

import itertools

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.groups import top_per_group, with_stats
from ..functions.lineage import cut
from ..functions.rand import key_hash, uniform
from .mapping import mapping_boxes
from .voxel import grid_sample

SCAN = ("scan_id",)


def images_in_box(points: DataFrame, images: DataFrame, margin: float = 0.0, ignore_z=False, by=SCAN) -> DataFrame:
    """Cameras strictly inside the box of the cloud, grown by half the margin on each side."""
    axes = "xy" if ignore_z else "xyz"
    box = points.groupBy(*by).agg(*[f(a).alias(f"__{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    inside = reduce(lambda p, q: p & q, [
        (F.col(f"c{a}") > F.col(f"__lo{a}") - margin / 2) & (F.col(f"c{a}") < F.col(f"__hi{a}") + margin / 2) for a in axes])
    return images.join(box, list(by)).where(inside).drop(*[f"__{n}{a}" for a in axes for n in ("lo", "hi")])


def grid_thin_images(images: DataFrame, size: float, by=SCAN) -> DataFrame:
    """One camera per grid cell."""
    at = images.withColumns({a: F.col(f"c{a}") for a in "xyz"})
    return grid_sample(at, size, mode="last", by=by, point_id="image_id").drop("x", "y", "z")


def pick_images(images: DataFrame, k: int, random=False, replace=False, seed=0, by=SCAN) -> DataFrame:
    """Every k-th image of a scan, or k random ones."""
    w = W.partitionBy(*by)
    if not random:
        out = images.withColumn("__rn", F.row_number().over(w.orderBy("image_id")) - 1)
        return out.where(F.col("__rn") % k == 0).drop("__rn")
    if not replace:
        return top_per_group(images, by, [key_hash(seed, *by, "image_id"), F.col("image_id")], k)
    ranked = images.withColumn("__rn", F.row_number().over(w.orderBy("image_id")).cast("long"))
    draws = images.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("__rn", key_hash(seed, *by, "draw") % F.col("__n") + 1).drop("__n")
    return draws.join(ranked, [*by, "__rn"]).drop("__rn")


def pick_by_area(maps: DataFrame, images: DataFrame, ratio: float, n_max: int, bbox=False, by=SCAN) -> DataFrame:
    """Images whose mapped area exceeds ratio W H, largest first, at most n_max per scan."""
    keys = [*by, "image_id"]
    if bbox:
        area = mapping_boxes(maps, keys).withColumn("area", (F.col("max_px") - F.col("min_px")) * (F.col("max_py") - F.col("min_py")))
    else:
        area = maps.groupBy(*keys).agg(F.count("*").alias("area"))
    out = images.join(area.select(*keys, "area"), keys).where(F.col("area") > ratio * F.col("px_w") * F.col("px_h"))
    return top_per_group(out, by, [F.col("area").desc(), F.col("image_id")], n_max)


def pick_by_credit(images: DataFrame, views: DataFrame, credit: int, k: float = 1.0, seed=0, mode="random", by=SCAN) -> DataFrame:
    """Draw images per scan until a pixel budget is spent: (by, image_id, turn).

    weight = size / max size + k * unseen / (max unseen + 1) over the images
    that still fit. Every round draws one image in each scan at once, marks its
    points as seen and takes its size off the budget, until no image fits.
    """
    by = list(by)
    keys = by + ["image_id"]
    pool = cut(images.select(*keys, F.col("size").cast("long").alias("size")))
    views = cut(views.select(*keys, "point_id").distinct())
    spent = pool.select(*by).distinct().withColumn("left", F.lit(int(credit)).cast("long"))
    picked = None
    for turn in itertools.count():  # ends when no image fits
        taken = pool if picked is None else pool.join(picked.select(*keys), keys, "left_anti")
        open_ = taken.join(spent, by).where(F.col("size") <= F.col("left"))
        unseen = views.groupBy(*keys).agg(F.count("*").alias("unseen"))
        open_ = open_.join(unseen, keys, "left").na.fill(0, ["unseen"])
        open_ = with_stats(open_, by, __ms=F.max("size"), __mu=F.max("unseen"))
        weight = F.col("size") / F.col("__ms") + k * F.col("unseen") / (F.col("__mu") + 1)
        # The largest log(u)/w is a draw with probability proportional to w.
        draw = weight if mode == "greedy" else F.log(F.greatest(uniform(seed, *keys, F.lit(turn)), F.lit(1e-12))) / weight
        step = open_.groupBy(*by).agg(F.max(F.struct(draw.alias("d"), (-F.col("image_id")).alias("i"), "size")).alias("m"))
        step = cut(step.select(*by, (-F.col("m.i")).alias("image_id"), F.col("m.size").alias("size"), F.lit(turn).alias("turn")))
        if step.isEmpty():
            break
        picked = step if picked is None else cut(picked.unionByName(step))
        # Only views of points that no picked image has seen go on.
        seen = views.join(step.select(*keys), keys, "left_semi").select(*by, "point_id").distinct()
        views = cut(views.join(seen, by + ["point_id"], "left_anti"))
        used = picked.groupBy(*by).agg(F.sum("size").alias("used"))
        spent = pool.select(*by).distinct().join(used, by, "left").select(*by, (F.lit(int(credit)) - F.coalesce("used", F.lit(0))).alias("left"))
    return (picked if picked is not None else pool.withColumn("turn", F.lit(0)).limit(0)).select(*keys, "turn")


def centre_roll(maps: DataFrame, images: DataFrame, n: int = 16, keys=("scan_id", "image_id")) -> DataFrame:
    """The roll that centres the mapped pixels of a panorama best: (keys, roll, px_w)."""
    keys = list(keys)
    step = 256 // n
    rolls = F.array(*[F.lit(r).cast("long") for r in range(0, 256, step)])
    w = images.select(*keys, "px_w")
    px = maps.join(w, keys).select(*keys, "px_w", F.floor(F.col("px") * 256 / F.col("px_w")).alias("b")).distinct()
    rolled = px.withColumn("r", F.explode(rolls)).withColumn("b", (F.col("b") + F.col("r")) % 256)
    span = rolled.groupBy(*keys, "px_w", "r").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    off = F.floor(F.abs((F.col("hi") + F.col("lo")) / 2.0 - 128))
    best = span.groupBy(*keys, "px_w").agg(F.min(F.struct((F.col("hi") - F.col("lo") + off).alias("c"), F.col("r"))).alias("m"))
    return best.select(*keys, F.floor(F.col("m.r") / 256.0 * F.col("px_w")).alias("roll"), "px_w")


def _crop_sizes(m: int, w: int, h: int):
    """Step t of the ladder: the width has doubled ceil(t/2) times and the height floor(t/2) times, neither beyond the image."""
    if m > min(w, h):
        return [(w, h)]
    doublings = lambda full: (-(-full // m) - 1).bit_length()
    last = max(2 * doublings(w) - 1, 2 * doublings(h), 0)
    return list(dict.fromkeys((min(m << (t + 1) // 2, w), min(m << t // 2, h)) for t in range(last + 1)))


def crop_groups(maps: DataFrame, width: int, height: int, padding: int = 0, m: int = 64, keys=("scan_id", "image_id")) -> DataFrame:
    """Crop size and offset per image: the first size of the growing ladder that holds its padded box."""
    box = mapping_boxes(maps, keys)
    box = box.select(*keys, *[F.greatest(F.col(f"min_{c}") - padding, F.lit(0)).alias(f"lo_{c}") for c in ("px", "py")],
                     *[F.least(F.greatest(F.col(f"max_{c}") + padding, F.lit(0)), F.lit(s)).alias(f"hi_{c}") for c, s in (("px", width), ("py", height))])
    dw, dh = F.col("hi_px") - F.col("lo_px"), F.col("hi_py") - F.col("lo_py")
    choice = F.lit(None)
    for cw, ch in reversed(_crop_sizes(m, width, height)):
        choice = F.when((dw <= cw) & (dh <= ch), F.struct(F.lit(cw).alias("crop_w"), F.lit(ch).alias("crop_h"))).otherwise(choice)
    out = box.withColumn("__c", choice).withColumns({"crop_w": F.col("__c.crop_w"), "crop_h": F.col("__c.crop_h")})
    off = lambda lo, size, extent, full: F.greatest(F.lit(0), F.least((F.col(lo) - (size - extent) / 2.0).cast("long"), full - size))
    return out.select(*keys, "crop_w", "crop_h",
                      off("lo_px", F.col("crop_w"), dw, F.lit(width)).cast("long").alias("off_x"),
                      off("lo_py", F.col("crop_h"), dh, F.lit(height)).cast("long").alias("off_y"))


# ------------------------------------------------------------------ pixel columns

def to_float(pixels: DataFrame, channels=("r", "g", "b")) -> DataFrame:
    return pixels.withColumns({c: F.col(c) / 255 for c in channels})


def standardise(pixels: DataFrame, mean, std, channels=("r", "g", "b")) -> DataFrame:
    return pixels.withColumns({c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(channels, mean, std)})


def pixel_position(pixels: DataFrame, width: int, height: int) -> DataFrame:
    return pixels.withColumns({"pos_y": F.col("py") / float(height - 1), "pos_x": F.col("px") / float(width - 1)})


def gather(maps: DataFrame, pixels: DataFrame, values=("r", "g", "b")) -> DataFrame:
    """Values of the mapped pixels."""
    return maps.join(pixels.select("image_id", "px", "py", *values), ["image_id", "px", "py"])


def gather_bilinear(coords: DataFrame, pixels: DataFrame, width: int, height: int, values=("r", "g", "b"), padding="zeros", row_id="row_id") -> DataFrame:
    """Values at fractional coordinates tx, ty in 0..1 from the four pixels around; borders by zeros, replicate or reflect."""
    u, v = F.col("tx") * width - 0.5, F.col("ty") * height - 0.5
    base = coords.select(row_id, "image_id", u.alias("__u"), v.alias("__v"))
    x0, y0 = F.floor("__u"), F.floor("__v")
    fx, fy = F.col("__u") - x0, F.col("__v") - y0
    four = F.array(*[
        F.struct((x0 + i).alias("px"), (y0 + j).alias("py"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
        for i in (0, 1) for j in (0, 1)])
    out = base.select(row_id, "image_id", F.inline(four))
    if padding == "replicate":
        edge = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), F.lit(n - 1)))
        out = out.withColumns({"px": edge("px", width), "py": edge("py", height)})
    elif padding == "reflect":
        fold = lambda c, n: F.when(F.col(c) < 0, -F.col(c) - 1).when(F.col(c) >= n, 2 * n - 1 - F.col(c)).otherwise(F.col(c))
        out = out.withColumns({"px": fold("px", width), "py": fold("py", height)})
    elif padding != "zeros":
        raise ValueError(f"unknown padding {padding!r}")
    hit = out.join(pixels.select("image_id", "px", "py", *values), ["image_id", "px", "py"], "left").na.fill(0.0, list(values))
    return hit.groupBy(row_id).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in values])


def resize_pixels(pixels: DataFrame, fx: int, fy: int, values=("r", "g", "b")) -> DataFrame:
    """Area mean over fx by fy blocks."""
    at = pixels.withColumns({"px": F.floor(F.col("px") / fx), "py": F.floor(F.col("py") / fy)})
    return at.groupBy("image_id", "px", "py").agg(*[F.avg(c).alias(c) for c in values])


def roll_pixels(pixels: DataFrame, roll: int, width: int) -> DataFrame:
    return pixels.withColumn("px", F.pmod(F.col("px") + roll, F.lit(width)))


def crop_pixels(pixels: DataFrame, off_x: int, off_y: int, w: int, h: int) -> DataFrame:
    out = pixels.withColumns({"px": F.col("px") - off_x, "py": F.col("py") - off_y})
    return out.where((F.col("px") >= 0) & (F.col("px") < w) & (F.col("py") >= 0) & (F.col("py") < h))


def image_summary(images: DataFrame, maps: DataFrame, by=SCAN) -> DataFrame:
    """Images with the number of points they see and of pixels that are mapped."""
    keys = [*by, "image_id"]
    per_view = maps.groupBy(*keys, "point_id").agg(F.count("*").alias("n"))
    n = per_view.groupBy(*keys).agg(F.count("*").alias("n_points"), F.sum("n").alias("n_pixels"))
    return images.select(*keys).join(n, keys, "left").na.fill(0)


def flip_images(pixels: DataFrame, width: int, p: float, seed, on=("image_id",)) -> DataFrame:
    """With chance p per image, px becomes width - 1 - px; pixels and mappings with the same seed agree."""
    return pixels.withColumn("px", F.when(uniform(seed, *on) < p, width - 1 - F.col("px")).otherwise(F.col("px")))
