"""Camera poses of sequences and scans, and their pairing with images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.maths import matrix_from_flat, matrix_product, rigid_inverse
from ..operators.camera import adjust_intrinsics
from ..operators.tables import rigid_transform
from .text import numbers, path_part, read_axis_alignment, read_pose_matrix


def _four(flat):
    """12 numbers to a 4x4 matrix."""
    return F.concat(matrix_from_flat(flat, 3, 4), F.array(F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])))


def sequence_poses(poses: DataFrame, calib: DataFrame, listing: DataFrame | None = None, fisheye=False) -> DataFrame:
    """cam_to_world = pose . cam_to_pose (. R_rect inverse unless fisheye); poses without an image on disk go.

    poses(sequence, camera, frame, pose), calib(camera, cam_to_pose, r_rect), listing(sequence, camera, frame).
    """
    j = poses.join(calib, "camera")
    world = matrix_product(F.col("pose"), F.col("cam_to_pose"))
    j = j.withColumn("pose", world)
    if not fisheye:
        j = j.withColumn("pose", matrix_product(F.col("pose"), rigid_inverse("r_rect")))
    j = j.drop("cam_to_pose", "r_rect")
    if listing is not None:
        j = j.join(listing.select("sequence", "camera", "frame"), ["sequence", "camera", "frame"], "left_semi")
    return j.withColumns({f"c{a}": F.col("pose")[i][3] for i, a in enumerate("xyz")})


def read_sequence_poses(spark: SparkSession, root: str, sequence: str, camera: str) -> DataFrame:
    """data_poses/<sequence>/poses.txt, calibration/calib_cam_to_pose.txt, calibration/perspective.txt and the image listing."""
    p = spark.read.text(f"{root}/data_poses/{sequence}/poses.txt").select(numbers(F.col("value")).alias("v")).where(F.size("v") == 13)
    p = p.select(F.lit(sequence).alias("sequence"), F.lit(camera).alias("camera"), F.col("v")[0].cast("long").alias("frame"), _four(F.slice("v", 2, 12)).alias("pose"))
    c = spark.read.text(f"{root}/calibration/calib_cam_to_pose.txt").where(F.col("value").startswith(f"{camera}:"))
    c = c.select(F.lit(camera).alias("camera"), _four(numbers(F.element_at(F.split("value", ":"), 2))).alias("cam_to_pose"))
    fisheye = camera in ("image_02", "image_03")
    if not fisheye:
        r = spark.read.text(f"{root}/calibration/perspective.txt").where(F.col("value").startswith(f"R_rect_{camera[-2:]}:"))
        flat = numbers(F.element_at(F.split("value", ":"), 2))
        z = F.lit(0.0)
        rows = [F.array(flat[3 * i], flat[3 * i + 1], flat[3 * i + 2], z) for i in range(3)] + [F.array(z, z, z, F.lit(1.0))]
        c = c.join(r.select(F.lit(camera).alias("camera"), F.array(*rows).alias("r_rect")), "camera")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(f"{root}/data_2d_raw/{sequence}/{camera}")
    files = files.select(F.lit(sequence).alias("sequence"), F.lit(camera).alias("camera"), F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("frame"))
    out = sequence_poses(p, c, files, fisheye)
    if out.isEmpty():
        raise ValueError(f"no pose of {sequence}/{camera} has an image")
    return out


def pair_images_with_poses(images: DataFrame, poses: DataFrame, skip=(), name="name") -> tuple[DataFrame, DataFrame]:
    """Images joined to poses on the base name, and the orphan counts of both sides; listed names are skipped."""
    keep = lambda d: d.where(~F.col(name).isin(*skip)) if skip else d
    i, p = keep(images), keep(poses)
    orphans = (i.join(p, name, "left_anti").agg(F.lit("image").alias("side"), F.count("*").alias("n"))
               .unionByName(p.join(i, name, "left_anti").agg(F.lit("pose").alias("side"), F.count("*").alias("n"))))
    return i.join(p, name), orphans


def parse_image_path(df: DataFrame, rooms: DataFrame | None = None, path="path") -> DataFrame:
    """<area>/<kind>/<sub>/camera_<name>_<room>_<n>_... to area, room and image name; images of dropped rooms go."""
    parts = F.split(F.col(path), "/")
    file = F.element_at(parts, -1)
    words = F.split(file, "_")
    out = df.withColumns({"area": F.element_at(parts, -4), "room": F.concat_ws("_", words[2], words[3]), "image": words[1]})
    return out if rooms is None else out.join(rooms.select("area", "room").distinct(), ["area", "room"], "left_semi")


def read_odometry(spark, root: str, sequence: str, points: DataFrame) -> DataFrame:
    """Points of a sequence moved by calibration Tr, then by the pose of their frame; the sensor position is kept.

    points(sequence, frame, ...) with frame names; the n-th frame in name order has the n-th line of poses.txt.
    """
    tr = spark.read.text(f"{root}/{sequence}/calib.txt").where(F.col("value").startswith("Tr:"))
    tr = tr.select(F.lit(sequence).alias("sequence"), _four(numbers(F.element_at(F.split("value", ":"), 2))).alias("tr"))
    p = spark.read.text(f"{root}/{sequence}/poses.txt", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("rank", "text")).where(F.trim("text") != "")
    p = p.select(F.lit(sequence).alias("sequence"), "rank", _four(numbers(F.col("text"))).alias("pose")).join(tr, "sequence")
    p = p.select("sequence", "rank", matrix_product(F.col("pose"), F.col("tr")).alias("pose"))
    from pyspark.sql import Window as W

    f = points.select("sequence", "frame").distinct().withColumn("rank", F.row_number().over(W.partitionBy("sequence").orderBy("frame")) - 1)
    return rigid_transform(points, f.join(p, ["sequence", "rank"]), ["sequence", "frame"], sensor=True)


def read_scan_images(spark, root: str, width: int, height: int) -> DataFrame:
    """Photographs of indoor scans: pose files, turned by the scan's axis alignment when it has one,
    with the depth camera's intrinsics adjusted to the asked size.

    scan/pose/<n>.txt, scan/intrinsic/intrinsic_depth.txt (4x4), scan/<scan>.txt with colorWidth-free axisAlignment.
    """
    pose = spark.read.text(f"{root}/*/pose/*.txt", wholetext=True)
    pose = pose.select(path_part(3).alias("scan"), F.regexp_replace(path_part(1), r"\.txt$", "").cast("long").alias("image_id"), matrix_from_flat(numbers(F.col("value")), 4, 4).alias("pose"))
    k = spark.read.text(f"{root}/*/intrinsic/intrinsic_depth.txt", wholetext=True).select(path_part(3).alias("scan"), numbers(F.col("value")).alias("k"))
    align = read_axis_alignment(spark, f"{root}/*/*.txt").withColumnRenamed("pose", "align")
    j = pose.join(k, "scan").join(align, "scan", "left")
    j = j.withColumn("pose", F.when(F.col("align").isNotNull(), matrix_product(F.col("align"), F.col("pose"))).otherwise(F.col("pose")))
    j = j.select("scan", "image_id", "pose", *[F.col("pose")[i][3].alias(f"c{a}") for i, a in enumerate("xyz")],
                 F.col("k")[0].alias("fx"), F.col("k")[5].alias("fy"), F.col("k")[2].alias("mx"), F.col("k")[6].alias("my"), F.lit(640).alias("px_w"), F.lit(480).alias("px_h"))
    return adjust_intrinsics(j, width, height)
