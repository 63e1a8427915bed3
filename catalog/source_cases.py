"""Readers and writers: rows of the given tables are written as files and read back."""

import math
import uuid

from pyspark.sql import functions as F

from pointweave.functions.lineage import ensure_checkpoint_dir
from pointweave.functions.maths import six_digits
from pointweave.functions.rand import key_hash
from pointweave.sources import binary, poses, sinks, text

from . import fixtures as fx
from .registry import case

six, h = fx.six, fx.h
D = lambda v: f"CAST({v} AS DOUBLE)"


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/pointweave-files/{uuid.uuid4().hex}"


def folder(df, spark, value, partitions, together=False):
    """One text file tree: partition columns become folders, the name of the part files is Spark's.

    With ``together`` a folder has one file, where each task would else write a file into each folder.
    """
    path = scratch(spark)
    if together:
        df = df.repartition(*partitions)
    df.select(*partitions, value.alias("value")).write.partitionBy(*partitions).text(path)
    return path


@case("A1_read_room_text", """WITH b AS (SELECT scan_id, instance, bool_or(point_id%97=5) AS bad FROM points GROUP BY 1,2)
SELECT 'area='||scan_id AS area, 'room='||instance AS room, x, z, CASE WHEN bad THEN 0 ELSE r END AS r FROM points JOIN b USING (scan_id, instance)""", "points")
def read_room_text(spark, sf):
    p = fx.points(spark, sf).select(F.col("scan_id").alias("area"), F.col("instance").alias("room"), F.concat_ws(
        " ", "x", "y", "z", F.when(F.col("point_id") % 97 == 5, "18x5").otherwise(F.col("r").cast("string")), "g", "b").alias("value"))
    out = text.read_room_text(spark, folder(p, spark, F.col("value"), ["area", "room"], together=True))
    return out.select("area", "room", "x", "z", "r")


@case("A2_label_from_annotations", f"""WITH a AS (SELECT scan_id, point_id, x+CASE WHEN {h('mv', 'point_id')}%4=0 THEN {D(0.0078125)} ELSE 0 END AS x, y, z, label, instance FROM points WHERE {h('an', 'point_id')}%3<>0),
m AS (SELECT a.scan_id, a.point_id AS a_id, a.label, a.instance, arg_min(p.point_id, row((a.x-p.x)*(a.x-p.x)+(a.y-p.y)*(a.y-p.y)+(a.z-p.z)*(a.z-p.z), p.point_id)) AS point_id FROM a JOIN points p ON a.scan_id=p.scan_id GROUP BY 1,2,3,4),
b AS (SELECT scan_id, point_id, max(row(instance, label)) AS l FROM m GROUP BY 1,2)
SELECT p.scan_id, p.point_id, CAST(coalesce(l[2], 0) AS INTEGER) AS label, coalesce(l[1], 0) AS instance FROM points p LEFT JOIN b ON b.scan_id=p.scan_id AND b.point_id=p.point_id""", "points")
def label_from_annotations(spark, sf):
    p = fx.points(spark, sf)
    a = p.where(key_hash("an", "point_id") % 3 != 0).withColumn("x", F.col("x") + F.when(key_hash("mv", "point_id") % 4 == 0, 0.0078125).otherwise(0.0))
    room = p.select("scan_id", "point_id", "x", "y", "z")
    return text.label_from_annotations(room, a).select("scan_id", "point_id", "label", "instance")


def _ply(spark, sf):
    path = scratch(spark)
    parts = sinks.ply_parts(fx.points(spark, sf), chunk=1000)

    # Each part is written as one file by the task that packed it.
    def put(batches):
        import os
        import pandas as pd
        for b in batches:
            for s, n, c in zip(b["scan_id"], b["part"], b["content"]):
                os.makedirs(f"{local}/{s}", exist_ok=True)
                with open(f"{local}/{s}/{n:06d}.ply", "wb") as f:
                    f.write(c)
            yield pd.DataFrame({"n": [len(b)]})

    local = path.replace("file:", "")
    parts.mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return path


PLY = "SELECT '{}' AS kind, scan_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, r{} AS r FROM points"


@case("A3_read_ply_windows", "SELECT x, r/255 AS r, label IS NULL AS unlabelled FROM (SELECT x, r, NULL AS label FROM points)", "points")
def read_ply_windows(spark, sf):
    d = binary.read_ply_windows(spark, f"{_ply(spark, sf)}/*/*.ply", ("x", "red", "semantic"))
    return d.select("x", "r", F.col("label").isNull().alias("unlabelled"))


@case("A4_read_mesh_vertices", "SELECT x, y, r AS red FROM points", "points")
def read_mesh(spark, sf):
    return binary.read_mesh_vertices(spark, f"{_ply(spark, sf)}/*/*.ply", rgb=True).select("x", "y", "red")


@case("A5_label_bits", f"""SELECT event_id, CAST(v & 65535 AS INTEGER) AS label, CAST(floor(v/65536) AS INTEGER) AS instance FROM
 (SELECT event_id, CASE WHEN w>=2147483648 THEN w-4294967296 ELSE w END AS v FROM (SELECT event_id, {h('bits', 'event_id')} AS w FROM events))""")
def label_bits(spark, sf):
    w = key_hash("bits", "event_id")
    e = fx.read(spark, sf, "events").select("event_id", F.when(w >= 2147483648, w - 4294967296).otherwise(w).cast("int").alias("raw"))
    return binary.split_label(e).drop("raw")


def _lines(df, spark, keys, order, value):
    """One file per key with the lines in the given order: the text is joined per key, so a key must be small."""
    path = scratch(spark)
    t = df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("t")))), lambda s: s["t"]), "\n").alias("value"))
    t.write.partitionBy(*keys).text(path)
    return path


@case("A7_read_classified_shapes", "SELECT 'category=c'||(event_id%4) AS category, CAST(event_id%4 AS INTEGER) AS label, x, z, CAST(1 AS DOUBLE) AS nz FROM points JOIN events ON event_id=point_id", "points")
def classified_shapes(spark, sf):
    p = fx.points(spark, sf).select(F.concat(F.lit("c"), F.col("point_id") % 4).alias("category"), F.concat_ws(",", "x", "y", "z", F.lit("0"), F.lit("0"), F.lit("1")).alias("value"))
    return text.read_classified_shapes(spark, folder(p, spark, F.col("value"), ["category"])).select("category", "label", "x", "z", "nz")


@case("A8_read_scene_annotations", """SELECT 'g' AS part, scan_id, instance+1 AS a, 'class '||(instance%7) AS raw, instance*10+label AS segment FROM (SELECT DISTINCT scan_id, instance, label FROM points)
UNION ALL SELECT 'v', scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id)-1, '', instance*10+label FROM points""", "points")
def scene_annotations(spark, sf):
    p = fx.points(spark, sf).select("scan_id", "point_id", "instance", (F.col("instance") * 10 + F.col("label")).alias("segment"))
    root = scratch(spark)
    o = p.groupBy("scan_id", "instance").agg(F.collect_set("segment").alias("segments"))
    g = o.groupBy("scan_id").agg(F.collect_list(F.struct(F.col("instance").alias("objectId"), F.concat(F.lit("class "), F.col("instance") % 7).alias("label"), "segments")).alias("segGroups"))
    v = p.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_id", "segment"))), lambda s: s["segment"]).alias("segIndices"))
    for name, d in (("aggregation", g), ("segs", v)):
        _json_files(d, root, name)
    gg, vv = text.read_scene_annotations(spark, root)
    scan = F.regexp_extract("scan", r"(\d+)", 1).cast("long").alias("scan_id")
    return gg.select(F.lit("g").alias("part"), scan, F.col("object").alias("a"), "raw", "segment").union(
        vv.select(F.lit("v"), scan, F.col("vertex").cast("long"), F.lit(""), "segment"))


def _json_files(df, root, name):
    """One json document per scan, named as the reader expects."""
    local = root.replace("file:", "")

    def put(batches):
        import os
        import pandas as pd
        for b in batches:
            for s, doc in zip(b["scan_id"], b["doc"]):
                os.makedirs(f"{local}/{s}", exist_ok=True)
                with open(f"{local}/{s}/{s}.{name}.json", "w") as f:
                    f.write(doc)
            yield pd.DataFrame({"n": [len(b)]})

    cols = [c for c in df.columns if c != "scan_id"]
    df.select("scan_id", F.to_json(F.struct(*cols)).alias("doc")).mapInPandas(put, "n long").agg(F.sum("n")).collect()


@case("A9_read_label_map", "SELECT CAST(s_suppkey AS VARCHAR) AS raw, CAST(s_suppkey AS INTEGER) AS raw_id, s_nationkey AS label FROM supplier UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier")
def label_map(spark, sf):
    s = fx.read(spark, sf, "supplier")
    t = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").alias("nyu40id")).union(s.select("s_name", "s_nationkey"))
    path = scratch(spark)
    t.write.option("sep", "\t").option("header", True).csv(path)
    return text.read_label_map(spark, path, "id", "nyu40id")


def _mat(tag, key, n):
    return [(key_hash(f"{tag}{i}", key) % 1024).cast("double") / 1024 for i in range(n)]


def _mats(tag, key, i):
    return f"CAST({h(f'{tag}{i}', key)}%1024 AS DOUBLE)/1024"


@case("A10_read_axis_alignment", f"SELECT {_mats('al', 's_suppkey', 0)} AS a, {_mats('al', 's_suppkey', 7)} AS b FROM supplier WHERE s_suppkey%5<>0")
def axis_alignment(spark, sf):
    k = F.col("s_suppkey")
    line = F.when(k % 5 == 0, "nothing = 1").otherwise(F.concat(F.lit("axisAlignment = "), F.concat_ws(" ", *_mat("al", k, 16)), F.lit("\naxisAlignment = 9")))
    s = fx.read(spark, sf, "supplier").select(k.alias("id"), F.concat_ws("\n", F.concat(F.lit("scan = "), k), line).alias("value"))
    path = scratch(spark)
    # One folder per scan, so that one file is one scan; the reader names a scan by its file.
    s.repartition(200, "id").write.partitionBy("id").text(path)
    m = text.read_axis_alignment(spark, f"{path}/*/*.txt", scan_part=2)
    return m.select(F.col("pose")[0][0].alias("a"), F.col("pose")[1][3].alias("b"))


POSE = f"""SELECT s_suppkey, CASE WHEN b THEN y-4.1 ELSE x END AS cx, CASE WHEN b THEN -x+6.25 ELSE y END AS cy, om-{D(math.pi / 2)} AS omega, CASE WHEN b THEN -om ELSE -om-{D(math.pi / 2)} END AS kappa
 FROM (SELECT s_suppkey, s_suppkey%3=0 AS b, {_mats('pj', 's_suppkey', 0)} AS x, {_mats('pj', 's_suppkey', 1)} AS y, {_mats('pj', 's_suppkey', 2)} AS om FROM supplier)"""


@case("A11_read_pose_json", f"SELECT s_suppkey, {six('cx')} AS cx, {six('cy')} AS cy, {six('omega')} AS omega, {six('kappa')} AS kappa FROM ({POSE})")
def pose_json(spark, sf):
    k = F.col("s_suppkey")
    x, y, om = _mat("pj", k, 3)
    s = fx.read(spark, sf, "supplier").select(F.when(k % 3 == 0, "area_5b").otherwise("area_1").alias("area"), k, F.array(x, y, F.lit(0.0)).alias("camera_location"), F.array(om, om, om).alias("final_camera_rotation"))
    path = scratch(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a file per pose: no task writes them alone
    s.repartition(n, "s_suppkey").write.partitionBy("area", "s_suppkey").json(path)
    d = text.read_pose_json(spark, f"{path}/*/*/*.json")
    return d.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), *[six_digits(c).alias(c) for c in ("cx", "cy", "omega", "kappa")])


@case("A14_pair_images_with_poses", "SELECT 'pair' AS part, i.s_name AS name, 1 AS n FROM supplier i WHERE s_suppkey%5<>0 AND s_suppkey%7<>0 UNION ALL SELECT 'image', '', count(*) FROM supplier WHERE s_suppkey%5=0 AND s_suppkey%7<>0 UNION ALL SELECT 'pose', '', count(*) FROM supplier WHERE s_suppkey%7=0 AND s_suppkey%5<>0")
def pair_images(spark, sf):
    s = fx.read(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    pair, orphans = poses.pair_images_with_poses(s.where("s_suppkey % 7 <> 0").select("name"), s.where("s_suppkey % 5 <> 0").select("name"), ["no such image"])
    return pair.select(F.lit("pair").alias("part"), "name", F.lit(1).cast("long").alias("n")).union(orphans.select("side", F.lit(""), "n"))


@case("A15_parse_image_path", "SELECT 'area_'||(s_suppkey%6) AS area, 'office_'||s_nationkey AS room, 'id'||s_suppkey AS image FROM supplier WHERE s_nationkey<20")
def parse_path(spark, sf):
    s = fx.read(spark, sf, "supplier")
    p = s.select(F.concat(F.lit("/data/area_"), F.col("s_suppkey") % 6, F.lit("/pano/rgb/camera_id"), F.col("s_suppkey"), F.lit("_office_"), F.col("s_nationkey"), F.lit("_frame_equirectangular_domain_rgb.png")).alias("path"))
    rooms = s.where("s_nationkey < 20").select(F.concat(F.lit("area_"), F.col("s_suppkey") % 6).alias("area"), F.concat(F.lit("office_"), F.col("s_nationkey")).alias("room"))
    return poses.parse_image_path(p, rooms).select("area", "room", "image")


@case("A12_read_pose_matrix", f"SELECT p_partkey%50 AS seq, {_mats('pm', 'p_partkey%50', 0)} AS a, {_mats('pm', 'p_partkey%50', 6)} AS b FROM (SELECT DISTINCT p_partkey%50 AS p_partkey FROM part)")
def pose_matrix(spark, sf):
    k = F.col("seq")
    m = _mat("pm", k, 16)
    lines = F.concat_ws("\n", *[F.concat_ws(" ", *m[4 * i: 4 * i + 4]) for i in range(4)])
    t = fx.read(spark, sf, "part").select((F.col("p_partkey") % 50).alias("seq")).distinct().select("seq", lines.alias("value"), k.alias("id"))
    path = scratch(spark)
    t.select("seq", "value").write.partitionBy("seq").text(path)
    d = spark.read.text(f"{path}/*/*.txt", wholetext=True).select(text.path_part(2).alias("d"), text.matrix_from_flat(text.numbers(F.col("value")), 4, 4).alias("pose"))
    check = text.read_pose_matrix(spark, f"{path}/*/*.txt").select(F.col("pose")[0][0].alias("a"), F.col("pose")[1][2].alias("b"))
    seq = F.regexp_extract("d", r"(\d+)", 1).cast("long").alias("seq")
    return d.select(seq, F.col("pose")[0][0].alias("a"), F.col("pose")[1][2].alias("b")).join(check, ["a", "b"], "left_semi")


LOGB = f"SELECT p_partkey//100 AS scene, p_partkey%100 AS src, p_partkey%100+1 AS dst, {_mats('lg', 'p_partkey', 0)} AS a, {_mats('lg', 'p_partkey', 11)} AS b FROM part"


@case("A16_read_pair_log", f"SELECT 'log' AS kind, * FROM ({LOGB}) UNION ALL SELECT 'file', * FROM ({LOGB})")
def pair_log(spark, sf):
    k = F.col("p_partkey")
    m = _mat("lg", k, 12)
    part = fx.read(spark, sf, "part").select(F.floor(k / 100).alias("scene"), k, *[c.alias(f"m{i}") for i, c in enumerate(m)])
    rows = [F.concat_ws(" ", *[F.col(f"m{j}") for j in range(4 * i, 4 * i + 4)]) for i in range(3)]
    block = F.concat_ws("\n", F.concat_ws("\t", k % 100, k % 100 + 1, F.lit(100)), *rows, F.lit("0 0 0 1"))
    log = text.read_pair_log(spark, f"{_lines(part, spark, ['scene'], k, block)}/*/*.txt")
    flat = F.concat_ws(" ", k, k % 100, k % 100 + 1, F.lit("0.5"), *[F.col(f"m{j}") for j in range(12)])
    file = text.read_pair_file(spark, f"{_lines(part, spark, ['scene'], k, flat)}/*/*.txt")
    scene = F.regexp_extract("scene", r"(\d+)", 1).cast("long").alias("scene")
    pick = lambda d, kind: d.select(F.lit(kind).alias("kind"), scene, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("pose")[0][0].alias("a"), F.col("pose")[2][3].alias("b"))
    return pick(log, "log").union(pick(file, "file"))


@case("A17_read_pcd_ascii", "SELECT row_number() OVER (PARTITION BY scan_id, instance ORDER BY point_id)-1 AS point_id, x, y, z FROM points QUALIFY points.point_id%50<>3", "points")
def pcd(spark, sf):
    p = fx.points(spark, sf)
    z = F.when(F.col("point_id") % 50 == 3, "nan").otherwise(F.col("z").cast("string"))
    head = "\n".join(["# .PCD v.7", "VERSION .7", "FIELDS y x z", "SIZE 4 4 4", "TYPE F F F", "COUNT 1 1 1", "WIDTH 1", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", "POINTS 1", "DATA ascii"])
    t = p.groupBy("scan_id", "instance").agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_id", F.concat_ws(" ", "y", "x", z).alias("t")))), lambda s: s["t"]), "\n")).alias("value"))
    path = scratch(spark)
    t.write.partitionBy("scan_id", "instance").text(path)
    return text.read_pcd_ascii(spark, f"{path}/*/*/*.txt").select("point_id", "x", "y", "z")


@case("A18_read_cloud_csv", "SELECT x, y, z FROM points", "points")
def cloud_csv(spark, sf):
    path = scratch(spark)
    fx.points(spark, sf).select("point_id", "x", "y", "z", "r").write.option("header", True).csv(path)
    return text.read_cloud_csv(spark, path).select("x", "y", "z")


@case("A13_sequence_poses", """WITH f AS (SELECT p_partkey//16 AS seq, p_partkey%16 AS frame, p_partkey FROM part) SELECT seq, frame, CAST(0.5 AS DOUBLE)+frame AS cx, CAST(0.25 AS DOUBLE) AS cy FROM f WHERE frame%5<>2""")
def sequence_poses(spark, sf):
    k = F.col("p_partkey")
    z, o = F.lit(0.0), F.lit(1.0)
    shift = lambda x, y: F.array(F.array(o, z, z, x), F.array(z, o, z, y), F.array(z, z, o, z), F.array(z, z, z, o))
    turn = F.array(F.array(z, -o, z, z), F.array(o, z, z, z), F.array(z, z, o, z), F.array(z, z, z, o))
    f = fx.read(spark, sf, "part").select(F.floor(k / 16).alias("sequence"), F.lit("image_00").alias("camera"), (k % 16).alias("frame"))
    p = f.withColumn("pose", shift(F.col("frame").cast("double"), z))
    calib = f.select("camera").distinct().select("camera", shift(F.lit(0.5), F.lit(0.25)).alias("cam_to_pose"), turn.alias("r_rect"))
    out = poses.sequence_poses(p, calib, f.where("frame % 5 <> 2"))
    return out.select(F.col("sequence").alias("seq"), "frame", "cx", "cy")


@case("B1_write_points", "SELECT scan_id, x, y, CASE label WHEN 0 THEN 255 WHEN 1 THEN 10 ELSE 0 END AS r FROM points", "points")
def write_points(spark, sf):
    path = scratch(spark)
    sinks.write_points(fx.points(spark, sf), path, [(255, 0, 0), (10, 20, 30)])
    return spark.read.parquet(path).select(F.col("scan_id").cast("long").alias("scan_id"), "x", "y", "r")


@case("B2_write_window_predictions", "SELECT printf('%04d_%010d_%010d', scan_id, instance, instance+100) AS file, point_id, ([7, 8, 11, 12, 13, 17])[label+1] AS raw FROM points", "points")
def window_predictions(spark, sf):
    path = scratch(spark)
    p = fx.points(spark, sf).select(F.col("scan_id").alias("sequence"), F.col("instance").alias("start"), (F.col("instance") + 100).alias("stop"), "point_id", F.col("label").alias("pred"))
    sinks.export_predictions(p, [7, 8, 11, 12, 13, 17], path)
    return spark.read.schema("point_id long, raw int, file string").parquet(path)


@case("B3_write_scan_predictions", "SELECT scan_id, CAST(([7, 8, 11, 12, 13, 17])[label+1] AS VARCHAR) AS value, count(*) AS n FROM points GROUP BY 1,2", "points")
def scan_predictions(spark, sf):
    path = scratch(spark)
    sinks.export_scan_text(fx.points(spark, sf).select("scan_id", "point_id", F.col("label").alias("pred")), [7, 8, 11, 12, 13, 17], path)
    return spark.read.schema("value string, scan_id long").text(path).groupBy("scan_id", "value").agg(F.count("*").alias("n"))


@case("B4_write_staged", "SELECT scan_id, CAST(round_even(x/0.5,0) AS BIGINT) AS vx, count(*) AS n FROM points GROUP BY 1,2", "points")
def staged(spark, sf):
    s = sinks.Stages(spark, scratch(spark))
    raw = s.stage("raw", lambda: fx.points(spark, sf), ["scan_id"])
    from pointweave.operators.voxel import quantize
    return s.stage("counts", lambda: quantize(raw, 0.5).groupBy("scan_id", "vx").agg(F.count("*").alias("n"))).withColumn("scan_id", F.col("scan_id").cast("long"))
