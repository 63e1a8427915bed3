"""Algebra of the point-image-pixel mapping.

A mapping is a table (scan_id, image_id, point_id, px, py) with view features;
a view is a (scan_id, image_id, point_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.prefix import number_rows

SCAN = ("scan_id",)
VIEW = ("scan_id", "image_id", "point_id")


def views_from_pixels(maps: DataFrame, features, points: DataFrame | None = None, keys=VIEW) -> DataFrame:
    """One row per view: number of pixels and mean features; with points given, unseen points keep a row without image."""
    views = maps.groupBy(*keys).agg(F.count("*").alias("n_pixels"), *[F.avg(f).alias(f) for f in features])
    if points is None:
        return views
    by = [k for k in keys if k != "image_id"]
    return points.select(*by).join(views, by, "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0).cast("long")))


def mapping_boxes(maps: DataFrame, keys=("scan_id", "image_id")) -> DataFrame:
    return maps.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("px", "py") for n, f in (("min", F.min), ("max", F.max))])


def downscale_mapping(maps: DataFrame, r: int, dedupe: bool = False) -> DataFrame:
    out = maps.withColumns({c: F.floor(F.col(c) / r) for c in ("px", "py")})
    return out.dropDuplicates([*VIEW, "px", "py"]) if dedupe else out


def upscale_mapping(maps: DataFrame, r: int, centre: bool = True) -> DataFrame:
    add = r / 2 if centre else 0.0
    return maps.withColumns({c: (F.col(c) * r + add).cast("long") for c in ("px", "py")})


def _renumber_images(df: DataFrame, by=SCAN, out="image_no") -> DataFrame:
    """New image numbers 0.. per scan over the images that are left; a table of images, not of rows, is ranked."""
    left = df.select(*by, "image_id").distinct()
    left = left.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy("image_id")).cast("long") - 1)
    return df.join(left, [*by, "image_id"])


def select_images(maps: DataFrame, ids, out="image_no") -> DataFrame:
    """Keep the listed images in the given order."""
    ids = list(ids)
    if len(set(ids)) != len(ids):
        raise ValueError("an image is listed twice")
    table = maps.sparkSession.createDataFrame([(int(v), i) for i, v in enumerate(ids)], f"image_id long, {out} long")
    return maps.join(table, "image_id")


def select_views(views: DataFrame, condition, by=SCAN) -> DataFrame:
    return _renumber_images(views.where(condition), by)


def filter_views(views: DataFrame, bounds: dict, by=SCAN) -> DataFrame:
    """lower < feature < upper for each listed feature, strict."""
    inside = reduce(lambda a, b: a & b, [(F.col(f) > lo) & (F.col(f) < hi) for f, (lo, hi) in bounds.items()])
    return select_views(views, inside, by)


def pick_points(maps: DataFrame, ids: DataFrame, by=SCAN) -> DataFrame:
    """Follow a selection (by, new_id, point_id), repeats allowed; points take the new ids, images are renumbered."""
    out = maps.join(ids.select(*by, "new_id", "point_id"), [*by, "point_id"])
    return _renumber_images(out.drop("point_id").withColumnRenamed("new_id", "point_id"), by)


def merge_points(maps: DataFrame, voxel_of: DataFrame, features, by=SCAN) -> DataFrame:
    """Follow a voxel map (by, point_id, voxel_id): features are the mean per (voxel, image) over its views, pixels are distinct."""
    joined = maps.join(voxel_of.select(*by, "point_id", "voxel_id"), [*by, "point_id"])
    keys = [*by, "image_id", "voxel_id"]
    per_view = joined.groupBy(*keys, "point_id").agg(*[F.max(f).alias(f) for f in features])
    mean = per_view.groupBy(*keys).agg(*[F.avg(f).alias(f) for f in features])
    pixels = joined.select(*keys, "px", "py").distinct()
    return pixels.join(mean, keys).withColumnRenamed("voxel_id", "point_id")


def covers_all(voxel_of: DataFrame, by=SCAN) -> DataFrame:
    """Whether the voxel ids of each scan are exactly 0..max."""
    return voxel_of.groupBy(*by).agg((F.count_distinct("voxel_id") == F.max("voxel_id") + 1).alias("complete"))


def crop_mapping(maps: DataFrame, offsets: DataFrame, on=("image_id",)) -> DataFrame:
    """Subtract each image's offset and keep the pixels inside its crop (off_x, off_y, crop_w, crop_h)."""
    out = maps.join(offsets.select(*on, "off_x", "off_y", "crop_w", "crop_h"), list(on))
    out = out.withColumns({"px": F.col("px") - F.col("off_x"), "py": F.col("py") - F.col("off_y")})
    return out.where((F.col("px") >= 0) & (F.col("px") < F.col("crop_w")) & (F.col("py") >= 0) & (F.col("py") < F.col("crop_h")))


def roll_mapping(maps: DataFrame, rolls: DataFrame, on=("image_id",)) -> DataFrame:
    """px moves by the roll of its image, modulo the width (image_id, roll, px_w)."""
    out = maps.join(rolls.select(*on, "roll", F.col("px_w").cast("long").alias("__w")), list(on))
    return out.withColumn("px", F.pmod(F.col("px") + F.col("roll"), F.col("__w"))).drop("__w", "roll")


def seen_points(points: DataFrame, views: DataFrame, by=SCAN) -> DataFrame:
    n = views.groupBy(*by, "point_id").agg(F.count("*").alias("n_views"))
    out = points.select(*by, "point_id").join(n, [*by, "point_id"], "left")
    return out.select(*by, "point_id", F.coalesce("n_views", F.lit(0).cast("long")).alias("n_views"), F.col("n_views").isNotNull().alias("seen"))


def check_tables(points: DataFrame, images: DataFrame, maps: DataFrame, by=SCAN) -> DataFrame:
    """Violations per check: point ids twice, mapping to no point or no image, pixels outside, images that see nothing."""
    by = list(by)

    def count(df, name):
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    twice = points.groupBy(*by, "point_id").agg(F.count("*").alias("n")).where("n > 1")
    no_point = maps.join(points, by + ["point_id"], "left_anti")
    sized = maps.join(images.select(*by, "image_id", "px_w", "px_h"), by + ["image_id"], "left")
    outside = sized.where("px < 0 OR py < 0 OR px >= px_w OR py >= px_h")
    parts = [count(twice, "point id twice"), count(no_point, "mapping without point"),
             count(sized.where("px_w IS NULL"), "mapping without image"), count(outside, "pixel outside image"),
             count(images.join(maps, by + ["image_id"], "left_anti"), "image sees nothing")]
    return reduce(lambda a, b: a.unionByName(b), parts)
