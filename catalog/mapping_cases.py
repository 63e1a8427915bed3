"""Mapping algebra, image selection and pooling queries."""

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.functions.rand import key_hash
from pointweave.operators import images as im, mapping as op, pooling as po, voxel

from . import fixtures as fx
from .registry import case

six, h, u = fx.six, fx.h, fx.u
D = "CAST({} AS DOUBLE)".format


@case("I1_build_mapping", """SELECT p.scan_id, p.point_id, image_id, coalesce(n, 0) AS n_pixels, d AS depth FROM points p LEFT JOIN
 (SELECT scan_id, point_id, image_id, count(*) AS n, avg(depth) AS d FROM maps GROUP BY ALL) v ON v.scan_id=p.scan_id AND v.point_id=p.point_id""", "points maps")
def build_mapping(spark, sf):
    return op.views_from_pixels(fx.maps(spark, sf), ["depth"], fx.points(spark, sf))


@case("I2_bounding_boxes", "SELECT scan_id, image_id, min(px) AS min_px, max(px) AS max_px, min(py) AS min_py, max(py) AS max_py FROM maps GROUP BY 1,2", "maps")
def bounding_boxes(spark, sf):
    return op.mapping_boxes(fx.maps(spark, sf))


PIX = "scan_id, image_id, point_id, px, py"


@case("I3_rescale_down", "SELECT DISTINCT scan_id, image_id, point_id, px//3 AS px, py//3 AS py FROM maps", "maps")
def rescale_down(spark, sf):
    return op.downscale_mapping(fx.maps(spark, sf), 3, dedupe=True).select(*PIX.split(", "))


@case("I4_rescale_up", "SELECT scan_id, image_id, point_id, CAST(trunc(px*3+1.5) AS BIGINT) AS px, CAST(trunc(py*3+1.5) AS BIGINT) AS py FROM maps", "maps")
def rescale_up(spark, sf):
    return op.upscale_mapping(fx.maps(spark, sf), 3).select(*PIX.split(", "))


@case("I5_select_images", f"SELECT {PIX}, CASE image_id WHEN 9 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS image_no FROM maps WHERE image_id IN (9, 2, 5)", "maps")
def select_images(spark, sf):
    return op.select_images(fx.maps(spark, sf), [9, 2, 5]).select(*PIX.split(", "), "image_no")


NUMBERED = "dense_rank() OVER (PARTITION BY scan_id ORDER BY image_id)-1 AS image_no"


@case("I6_select_views", f"SELECT scan_id, image_id, point_id, {NUMBERED} FROM views WHERE image_id%5<>0 AND height>0.5", "views")
def select_views(spark, sf):
    return op.select_views(fx.views(spark, sf), "image_id % 5 <> 0 AND height > 0.5").select("scan_id", "image_id", "point_id", "image_no")


@case("I7_pick_points", f"""WITH s AS (SELECT scan_id, point_id, point_id*2+c AS new_id FROM points, range(0,2) t(c) WHERE label<3)
SELECT m.scan_id, image_id, new_id AS point_id, px, py, dense_rank() OVER (PARTITION BY m.scan_id ORDER BY image_id)-1 AS image_no FROM maps m JOIN s ON s.scan_id=m.scan_id AND s.point_id=m.point_id""", "points maps")
def pick_points(spark, sf):
    s = fx.points(spark, sf).where("label < 3").select("scan_id", "point_id", F.explode(F.array(F.col("point_id") * 2, F.col("point_id") * 2 + 1)).alias("new_id"))
    return op.pick_points(fx.maps(spark, sf), s).select(*PIX.split(", "), "image_no")


@case("I8_merge_points", """WITH j AS (SELECT m.*, m.point_id//5 AS vox FROM maps m), v AS (SELECT scan_id, image_id, vox, point_id, max(depth) AS depth FROM j GROUP BY 1,2,3,4),
a AS (SELECT scan_id, image_id, vox, avg(depth) AS depth FROM v GROUP BY 1,2,3)
SELECT scan_id, image_id, vox AS point_id, px, py, depth FROM (SELECT DISTINCT scan_id, image_id, vox, px, py FROM j) JOIN a USING (scan_id, image_id, vox)""", "maps")
def merge_points(spark, sf):
    v = fx.points(spark, sf).select("scan_id", "point_id", F.floor(F.col("point_id") / 5).alias("voxel_id"))
    return op.merge_points(fx.maps(spark, sf), v, ["depth"])


@case("I9_crop_mapping", """SELECT scan_id, image_id, point_id, px-image_id%4 AS px, py-2 AS py FROM maps WHERE px-image_id%4 BETWEEN 0 AND 15 AND py-2 BETWEEN 0 AND 7""", "maps")
def crop_mapping(spark, sf):
    off = fx.images(spark, sf).select("image_id", (F.col("image_id") % 4).alias("off_x"), F.lit(2).alias("off_y"), F.lit(16).alias("crop_w"), F.lit(8).alias("crop_h"))
    return op.crop_mapping(fx.maps(spark, sf), off).select(*PIX.split(", "))


@case("I10_roll_mapping", "SELECT scan_id, image_id, point_id, (px+image_id%32)%32 AS px, py FROM maps", "maps")
def roll_mapping(spark, sf):
    rolls = fx.images(spark, sf).select("image_id", (F.col("image_id") % 32).alias("roll"), F.lit(32).alias("px_w"))
    return op.roll_mapping(fx.maps(spark, sf), rolls).select(*PIX.split(", "))


@case("I11_filter_by_feature", f"SELECT scan_id, image_id, point_id, {NUMBERED} FROM views WHERE depth>0.25 AND depth<0.75 AND height>0.1 AND height<0.9", "views")
def filter_by_feature(spark, sf):
    return op.filter_views(fx.views(spark, sf), {"depth": (0.25, 0.75), "height": (0.1, 0.9)}).select("scan_id", "image_id", "point_id", "image_no")


@case("I12_seen_points", """SELECT p.scan_id, p.point_id, coalesce(n, 0) AS n_views, n IS NOT NULL AS seen FROM points p LEFT JOIN
 (SELECT scan_id, point_id, count(*) AS n FROM views GROUP BY 1,2) v ON v.scan_id=p.scan_id AND v.point_id=p.point_id""", "points views")
def seen_points(spark, sf):
    return op.seen_points(fx.points(spark, sf), fx.views(spark, sf))


@case("I13_check_mapping", """SELECT 'point id twice' AS "check", count(*) AS violations FROM (SELECT scan_id, point_id FROM points GROUP BY 1,2 HAVING count(*)>1)
UNION ALL SELECT 'mapping without point', count(*) FROM maps m ANTI JOIN points p ON p.scan_id=m.scan_id AND p.point_id=m.point_id
UNION ALL SELECT 'mapping without image', count(*) FROM maps m ANTI JOIN (SELECT * FROM images WHERE image_id%10<>1) p ON p.scan_id=m.scan_id AND p.image_id=m.image_id
UNION ALL SELECT 'pixel outside image', count(*) FROM maps WHERE px>=20 AND image_id%10<>1
UNION ALL SELECT 'image sees nothing', count(*) FROM (SELECT * FROM images WHERE image_id%10<>1) p ANTI JOIN maps m ON p.scan_id=m.scan_id AND p.image_id=m.image_id""", "points images maps")
def check_mapping(spark, sf):
    i = fx.images(spark, sf).where("image_id % 10 <> 1").withColumn("px_w", F.lit(20))
    return op.check_tables(fx.points(spark, sf), i, fx.maps(spark, sf))


# ------------------------------------------------------------------ images

@case("J1_drop_far_images", """SELECT image_id FROM images i JOIN (SELECT scan_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM points GROUP BY 1) USING (scan_id)
WHERE cx>a+1 AND cx<b-1 AND cy>c+1 AND cy<d-1""", "points images")
def drop_far(spark, sf):
    return im.images_in_box(fx.points(spark, sf), fx.images(spark, sf), -2.0, True).select("image_id")


@case("J2_thin_images", """SELECT max(image_id) AS image_id FROM images GROUP BY scan_id, round_even(cx/2,0), round_even(cy/2,0), round_even(cz/2,0)""", "images")
def thin(spark, sf):
    return im.grid_thin_images(fx.images(spark, sf), 2.0).select("image_id")


@case("J3_pick_k", f"""SELECT 'kth' AS how, image_id, 0 AS draw FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY image_id)-1 AS rn FROM images) WHERE rn%3=0
UNION ALL SELECT 'random', image_id, 0 FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {h('pk', 'scan_id', 'image_id')}, image_id) AS rn FROM images) WHERE rn<=4
UNION ALL SELECT 'replace', r.image_id, d FROM (SELECT scan_id, count(*) AS n FROM images GROUP BY 1) s, range(0,5) t(d)
 JOIN (SELECT scan_id, image_id, row_number() OVER (PARTITION BY scan_id ORDER BY image_id) AS rn FROM images) r ON r.scan_id=s.scan_id AND rn={h('pk', 's.scan_id', 'd')}%n+1""", "images")
def pick_k(spark, sf):
    i = fx.images(spark, sf).select("scan_id", "image_id")
    zero = F.lit(0).cast("long")
    return (im.pick_images(i, 3).select(F.lit("kth").alias("how"), "image_id", zero.alias("draw"))
            .union(im.pick_images(i, 4, random=True, seed="pk").select(F.lit("random"), "image_id", zero))
            .union(im.pick_images(i, 5, random=True, replace=True, seed="pk").select(F.lit("replace"), "image_id", F.col("draw").cast("long"))))


@case("J4_pick_by_area", """SELECT scan_id, image_id, area FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY area DESC, image_id) AS rk
 FROM (SELECT scan_id, image_id, count(*) AS area FROM maps GROUP BY 1,2) WHERE area>0.5*32*16) WHERE rk<=6""", "maps")
def pick_by_area(spark, sf):
    i = fx.images(spark, sf).withColumns({"px_w": F.lit(32), "px_h": F.lit(16)})
    return im.pick_by_area(fx.maps(spark, sf), i, 0.5, 6).select("scan_id", "image_id", "area")


@case("J5_pick_by_credit")
def pick_by_credit(spark, sf):
    i = fx.images(spark, sf).select("scan_id", "image_id", (F.lit(64) + F.col("image_id") % 4 * 32).alias("size"))
    return im.pick_by_credit(i, fx.views(spark, sf), 400, seed="credit")


@case("J6_centre_roll", """WITH b AS (SELECT DISTINCT scan_id, image_id, px*256//32 AS b FROM maps), r AS (SELECT scan_id, image_id, r, min((b+r)%256) AS lo, max((b+r)%256) AS hi FROM b, range(0,256,32) t(r) GROUP BY 1,2,3)
SELECT scan_id, image_id, CAST(floor(arg_min(r, row(hi-lo+floor(abs((hi+lo)/2.0-128)), r))/256.0*32) AS BIGINT) AS roll FROM r GROUP BY 1,2""", "maps")
def centre_roll(spark, sf):
    i = fx.images(spark, sf).withColumn("px_w", F.lit(32).cast("long"))
    return im.centre_roll(fx.maps(spark, sf), i, 8).drop("px_w")


@case("J7_crop_groups", """WITH b AS (SELECT scan_id, image_id, greatest(min(px)-1,0) AS x0, least(max(px)+1,32) AS x1, greatest(min(py)-1,0) AS y0, least(max(py)+1,16) AS y1 FROM maps GROUP BY 1,2),
l AS (SELECT * FROM (VALUES (0,4,4),(1,8,4),(2,8,8),(3,16,8),(4,16,16),(5,32,16)) t(step, w, h)),
c AS (SELECT b.*, arg_min(row(w,h), step) AS s FROM b JOIN l ON x1-x0<=w AND y1-y0<=h GROUP BY ALL)
SELECT scan_id, image_id, s[1] AS crop_w, s[2] AS crop_h, CAST(greatest(0, least(trunc(x0-(s[1]-(x1-x0))/2), 32-s[1])) AS BIGINT) AS off_x,
 CAST(greatest(0, least(trunc(y0-(s[2]-(y1-y0))/2), 16-s[2])) AS BIGINT) AS off_y FROM c""", "maps")
def crop_groups(spark, sf):
    return im.crop_groups(fx.maps(spark, sf), 32, 16, 1, 4)


@case("J8_float_and_standardise", f"SELECT image_id, px, py, {six('(r/255-0.5)/0.25')} AS r FROM image_pixels", "image_pixels")
def standardise(spark, sf):
    p = im.standardise(im.to_float(fx.image_pixels(spark, sf)), [0.5] * 3, [0.25] * 3)
    return p.select("image_id", "px", "py", six_digits("r").alias("r"))


@case("J9_pixel_position_features", f"SELECT image_id, px, py, py/{D(15)} AS pos_y, px/{D(31)} AS pos_x FROM image_pixels", "image_pixels")
def pixel_position(spark, sf):
    return im.pixel_position(fx.image_pixels(spark, sf), 32, 16).select("image_id", "px", "py", "pos_y", "pos_x")


@case("J10_gather_pixels", "SELECT scan_id, m.image_id, point_id, m.px, m.py, r, b FROM maps m JOIN image_pixels p ON p.image_id=m.image_id AND p.px=m.px AND p.py=m.py", "maps image_pixels")
def gather_pixels(spark, sf):
    return im.gather(fx.maps(spark, sf), fx.image_pixels(spark, sf), ("r", "b")).select("scan_id", "image_id", "point_id", "px", "py", "r", "b")


def _bilinear(pad):
    edge = {"zeros": ("X", "Y"), "replicate": ("greatest(0, least(X, 31))", "greatest(0, least(Y, 15))"),
            "reflect": ("CASE WHEN X<0 THEN -X-1 WHEN X>31 THEN 63-X ELSE X END", "CASE WHEN Y<0 THEN -Y-1 WHEN Y>15 THEN 31-Y ELSE Y END")}[pad]
    ex, ey = edge[0].replace("X", "q.x"), edge[1].replace("Y", "q.y")
    return f"SELECT '{pad}' AS padding, q.row_id, sum(w*coalesce(r, 0)) AS r FROM q LEFT JOIN image_pixels p ON p.image_id=q.image_id AND p.px={ex} AND p.py={ey} GROUP BY 2"


@case("J11_gather_bilinear", f"""WITH c AS (SELECT o_orderkey AS row_id, o_orderkey%(SELECT count(*) FROM supplier)+1 AS image_id, CAST({h('tx', 'o_orderkey')}%1025 AS DOUBLE)/1024*32-0.5 AS x, CAST({h('ty', 'o_orderkey')}%1025 AS DOUBLE)/1024*16-0.5 AS y FROM orders),
q AS (SELECT row_id, image_id, CAST(floor(c.x) AS BIGINT)+i AS x, CAST(floor(c.y) AS BIGINT)+j AS y, (CASE i WHEN 1 THEN c.x-floor(c.x) ELSE 1-(c.x-floor(c.x)) END)*(CASE j WHEN 1 THEN c.y-floor(c.y) ELSE 1-(c.y-floor(c.y)) END) AS w
 FROM c, range(0,2) t(i), range(0,2) s(j)) {' UNION ALL '.join(_bilinear(p) for p in ('zeros', 'replicate', 'reflect'))}""", "image_pixels")
def gather_bilinear(spark, sf):
    k, n = F.col("o_orderkey"), fx.read(spark, sf, "supplier").count()
    c = fx.read(spark, sf, "orders").select(k.alias("row_id"), (k % n + 1).alias("image_id"), ((key_hash("tx", k) % 1025).cast("double") / 1024).alias("tx"), ((key_hash("ty", k) % 1025).cast("double") / 1024).alias("ty"))
    p = fx.image_pixels(spark, sf)
    out = [im.gather_bilinear(c, p, 32, 16, ("r",), pad).withColumn("padding", F.lit(pad)) for pad in ("zeros", "replicate", "reflect")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@case("J12_attach_images", """SELECT i.scan_id, i.image_id, count(DISTINCT point_id) AS n_points, count(point_id) AS n_pixels FROM images i LEFT JOIN maps m ON m.scan_id=i.scan_id AND m.image_id=i.image_id GROUP BY 1,2""", "images maps")
def attach_images(spark, sf):
    return im.image_summary(fx.images(spark, sf), fx.maps(spark, sf))


@case("A20_read_images", "SELECT image_id, ((px+3)%32-2)//2 AS px, py//2 AS py, avg(r) AS r FROM image_pixels WHERE (px+3)%32 BETWEEN 2 AND 17 GROUP BY 1,2,3", "image_pixels")
def image_settings(spark, sf):
    p = im.roll_pixels(fx.image_pixels(spark, sf), 3, 32)
    return im.resize_pixels(im.crop_pixels(p, 2, 0, 16, 16), 2, 2, ("r",))


@case("G12_flip_images", f"SELECT scan_id, image_id, point_id, CASE WHEN {u('flip', 'image_id')}<0.5 THEN 31-px ELSE px END AS px, py FROM maps", "maps")
def flip(spark, sf):
    return im.flip_images(fx.maps(spark, sf), 32, 0.5, "flip").select(*PIX.split(", "))


# ------------------------------------------------------------------ pooling

@case("K1_segment_reduce", """SELECT p.scan_id, p.point_id, coalesce(s, 0) AS s, coalesce(a, 0) AS a, coalesce(lo, 0) AS lo, coalesce(hi, 0) AS hi FROM points p LEFT JOIN
 (SELECT scan_id, point_id, sum(depth) AS s, avg(depth) AS a, min(depth) AS lo, max(depth) AS hi FROM views GROUP BY 1,2) v ON v.scan_id=p.scan_id AND v.point_id=p.point_id""", "points views")
def segment_reduce(spark, sf):
    v, p, keys = fx.views(spark, sf), fx.points(spark, sf), ["scan_id", "point_id"]
    parts = [po.pool(v.withColumn(n, F.col("depth")), keys, [n], how, p) for n, how in (("s", "sum"), ("a", "mean"), ("lo", "min"), ("hi", "max"))]
    out = parts[0]
    for other in parts[1:]:
        out = out.join(other, keys)
    return out


@case("K2_pool_by_heuristic", """SELECT p.scan_id, p.point_id, coalesce(v, 0) AS height FROM points p LEFT JOIN (SELECT scan_id, point_id, arg_max(height, row(depth, -image_id)) AS v FROM views GROUP BY 1,2) w
 ON w.scan_id=p.scan_id AND w.point_id=p.point_id""", "points views")
def pool_by_heuristic(spark, sf):
    return po.pool_by(fx.views(spark, sf), ["scan_id", "point_id"], "depth", ["height"], all_keys=fx.points(spark, sf))


SOFT = "sm AS (SELECT *, exp((depth-max(depth) OVER w)/sqrt(count(*) OVER w)) AS e1, exp(depth-max(depth) OVER w) AS e0, exp(height-max(height) OVER w) AS eh FROM views WINDOW w AS (PARTITION BY scan_id, point_id))"


@case("K3_segment_softmax", f"WITH {SOFT} SELECT scan_id, image_id, point_id, {six('e1/(sum(e1) OVER (PARTITION BY scan_id, point_id)+CAST(1e-12 AS DOUBLE))')} AS weight FROM sm", "views")
def segment_softmax(spark, sf):
    return po.softmax_over(fx.views(spark, sf), "depth", ["scan_id", "point_id"], scaling=True).select("scan_id", "image_id", "point_id", six_digits("weight").alias("weight"))


@case("K4_attention_pool", f"""WITH {SOFT} SELECT scan_id, point_id, {six('sum(e0*depth)/sum(e0)*tanh(greatest(max(depth)*2-0.5,0))')} AS a, {six('sum(e0*height)/sum(e0)*tanh(greatest(max(depth)*2-0.5,0))')} AS b,
 {six('sum(eh*depth*height)/sum(eh)*tanh(greatest(max(height)*2-0.5,0))')} AS c FROM sm GROUP BY 1,2""", "views")
def attention_pool(spark, sf):
    v = fx.views(spark, sf).withColumns({"a": F.col("depth"), "b": F.col("height"), "c": F.col("depth") * F.col("height")})
    out = po.attention_pool(v, ["scan_id", "point_id"], ["depth", "height"], ["a", "b", "c"], gate=(2.0, -0.5))
    return out.select("scan_id", "point_id", *[six_digits(c).alias(c) for c in "abc"])


@case("K5_set_features", f"""SELECT scan_id, image_id, point_id, depth-min(depth) OVER w AS depth_above_min, depth-max(depth) OVER w AS depth_below_max, {six('sqrt(1/(count(*) OVER w+CAST(0.001 AS DOUBLE)))')} AS set_size
FROM views WINDOW w AS (PARTITION BY scan_id, point_id)""", "views")
def set_features(spark, sf):
    return po.set_features(fx.views(spark, sf), ["depth"], ["scan_id", "point_id"]).drop("depth", "height").withColumn("set_size", six_digits("set_size"))


@case("K6_fuse_features", """SELECT p.scan_id, p.point_id, x+coalesce(d, 0) AS x, z+coalesce(e, 0) AS z, coalesce(d, 0) AS mod_depth, coalesce(e, 0) AS mod_height FROM points p LEFT JOIN
 (SELECT scan_id, point_id, avg(depth) AS d, avg(height) AS e FROM views GROUP BY 1,2) v ON v.scan_id=p.scan_id AND v.point_id=p.point_id""", "points views")
def fuse(spark, sf):
    m = po.pool(fx.views(spark, sf), ["scan_id", "point_id"], ["depth", "height"])
    return po.fuse_features(fx.points(spark, sf), m, ["scan_id", "point_id"], ["x", "z"], ["depth", "height"], "both")


@case("K7_two_level_pool", """WITH v AS (SELECT scan_id, m.image_id, point_id, max(r) AS r, max(g) AS g FROM maps m JOIN image_pixels p ON p.image_id=m.image_id AND p.px=m.px AND p.py=m.py GROUP BY 1,2,3),
a AS (SELECT scan_id, point_id, avg(r) AS r, avg(g) AS g FROM v GROUP BY 1,2)
SELECT p.scan_id, p.point_id, p.x, coalesce(a.r, 0) AS mod_r, coalesce(a.g, 0) AS mod_g FROM points p LEFT JOIN a ON a.scan_id=p.scan_id AND a.point_id=p.point_id""", "points maps image_pixels")
def two_level_pool(spark, sf):
    return po.multi_view_features(fx.points(spark, sf), fx.maps(spark, sf), fx.image_pixels(spark, sf), ["x"], ("r", "g"))


@case("K8_view_dropout", f"SELECT scan_id, point_id, CASE WHEN {u('drop', 'scan_id', 'instance')}<0.3 THEN 0 ELSE r END AS r FROM points", "points")
def view_dropout(spark, sf):
    return po.drop_side(fx.points(spark, sf), ["r"], 0.3, "drop", ("scan_id", "instance")).select("scan_id", "point_id", "r")
