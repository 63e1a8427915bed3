"""Queries that shape tables."""

from pyspark.sql import functions as F

from pointweave.functions.rand import key_hash
from pointweave.operators import tables as op

from . import fixtures as fx
from .registry import case

h, u, six = fx.h, fx.u, fx.six


@case("C1_save_point_id", "SELECT scan_id, point_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id)-1 AS local_id FROM points", "points")
def save_point_id(spark, sf):
    return op.with_point_id(fx.points(spark, sf), "local_id", "point_id").select("scan_id", "point_id", "local_id")


@case("C2_remove_columns", "SELECT scan_id, point_id, x, y, z, label FROM points", "points")
def remove_columns(spark, sf):
    return op.remove_columns(fx.points(spark, sf), ["r", "g", "b", "instance", "sample_ts"], strict=True)


@case("C3_add_features", """SELECT point_id, unnest([r, g, b, z, CAST(label AS DOUBLE)]) AS value,
 unnest(range(0,5)) AS channel FROM points""", "points")
def add_features(spark, sf):
    p = op.add_features(fx.points(spark, sf), ["r", "g", "b", "z", "x", "label"], flags=[True] * 4 + [False, True], delete=[True] * 3 + [False] * 3)
    return p.select("point_id", F.posexplode("feat").alias("channel", "value")).withColumn("channel", F.col("channel").cast("long"))


@case("C4_constant_and_axis_features", "SELECT point_id, CAST(1 AS DOUBLE) AS ones, x AS pos_x, z AS pos_z FROM points", "points")
def constant_and_axis(spark, sf):
    return op.axis_features(op.add_ones(fx.points(spark, sf)), ("x", "z")).select("point_id", "ones", "pos_x", "pos_z")


# The valid raw ids of the test map, three of them not cared for.
VALID = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 24, 28, 33, 34, 36, 39]
DONT_CARE = [13, 36, 40]


@case("C5_remap_labels", f"""WITH m AS (SELECT unnest({VALID}) AS raw, unnest(range(0,{len(VALID)})) AS target)
SELECT event_id, {h('lab', 'event_id')}%45 AS raw, CAST(coalesce(m.target, -1) AS INTEGER) AS label
FROM events LEFT JOIN m ON m.raw = {h('lab', 'event_id')}%45 AND m.raw NOT IN (13, 36, 40)""")
def remap_labels(spark, sf):
    e = fx.read(spark, sf, "events").select("event_id", (key_hash("lab", "event_id") % 45).alias("raw"))
    return op.remap_labels(e, VALID, DONT_CARE, col="raw", out="label")


@case("C6_inverse_labels", f"SELECT event_id, CAST(([{','.join(map(str, VALID))}])[event_id%20+1] AS INTEGER) AS raw FROM events")
def inverse_labels(spark, sf):
    e = fx.read(spark, sf, "events").select("event_id", (F.col("event_id") % 20).alias("pred"))
    return op.inverse_labels(e, VALID, out="raw").drop("pred")


@case("C7_fuse_clouds", """SELECT scan_id//2 AS area, x, label, row_number() OVER (PARTITION BY scan_id//2 ORDER BY scan_id, point_id)-1 AS point_id
FROM points""", "points")
def fuse_clouds(spark, sf):
    p = fx.points(spark, sf).withColumn("area", F.floor(F.col("scan_id") / 2)).select("scan_id", "area", "point_id", "x", "label")
    return op.fuse(p, "scan_id", "area", "point_id")


@case("C8_split_fold", """SELECT point_id, CASE WHEN scan_id=3 THEN 'test' WHEN instance IN (5, 6, 9) THEN 'val' ELSE 'train' END AS split,
 scan_id<>3 AND instance IN (5, 6, 9) AS is_val FROM points""", "points")
def split_fold(spark, sf):
    return op.split_fold(fx.points(spark, sf), 3, [5, 6, 9], "scan_id", "instance").select("point_id", "split", "is_val")


@case("C9_rotate_listed_scans", """WITH b AS (SELECT scan_id, min(x)+max(x) AS sx, min(y)+max(y) AS sy FROM points GROUP BY 1)
SELECT point_id, CASE WHEN scan_id IN (1, 2) THEN sx-x ELSE x END AS x, CASE WHEN scan_id IN (1, 2) THEN sy-y ELSE y END AS y
FROM points JOIN b USING (scan_id)""", "points")
def half_turn(spark, sf):
    return op.half_turn(fx.points(spark, sf), [1, 2]).select("point_id", "x", "y")


@case("C10_rigid_transform", f"""WITH m AS (SELECT scan_id, arg_min(ck, image_id) AS ck, arg_min(sk, image_id) AS sk,
 arg_min(cx, image_id) AS cx, arg_min(cy, image_id) AS cy, arg_min(cz, image_id) AS cz FROM images GROUP BY 1)
SELECT point_id, {six('ck*x-sk*y+cx')} AS x, {six('sk*x+ck*y+cy')} AS y, z+cz AS z, cx AS sensor_x FROM points JOIN m USING (scan_id)""", "points images")
def rigid_transform(spark, sf):
    poses = fx.images(spark, sf).groupBy("scan_id").agg(F.min_by("pose", "image_id").alias("pose"))
    out = op.rigid_transform(fx.points(spark, sf), poses, sensor=True)
    return out.select("point_id", fx_six("x"), fx_six("y"), "z", "sensor_x")


def fx_six(c):
    from pointweave.functions.maths import six_digits
    return six_digits(c).alias(c)


@case("C11_filter_classes_and_cap", f"""SELECT scan_id, point_id, label FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
 ORDER BY {h('cap', 'scan_id', 'point_id')}, point_id) AS rn FROM points WHERE label NOT IN (0, 5)) WHERE rn<=100""", "points")
def filter_and_cap(spark, sf):
    p = op.drop_classes(fx.points(spark, sf), [0, 5])
    return op.cap_points(p, 100, "cap").select("scan_id", "point_id", "label")


@case("C12_segments_to_labels", """
WITH v AS (SELECT scan_id, point_id AS vertex, instance*10+label AS segment, instance, label FROM points),
g AS (SELECT scan_id, instance AS object, instance%7 AS raw, segment FROM v WHERE label<4
  UNION ALL SELECT scan_id, instance+1000, instance%5, segment FROM v WHERE label IN (2, 4)),
m AS (SELECT unnest([0,1,2,3,4]) AS raw, unnest([10,11,12,13,14]) AS label),
b AS (SELECT scan_id, segment, max(row(object, coalesce(m.label, 0))) AS o FROM g LEFT JOIN m USING (raw) GROUP BY 1,2)
SELECT v.scan_id, vertex, segment, coalesce(o[1], 0) AS object, CAST(coalesce(o[2], 0) AS INTEGER) AS label
FROM v LEFT JOIN b USING (scan_id, segment)""", "points")
def segments_to_labels(spark, sf):
    v = fx.points(spark, sf).select("scan_id", F.col("point_id").alias("vertex"), (F.col("instance") * 10 + F.col("label")).alias("segment"), "instance", "label")
    g = v.where("label < 4").select("scan_id", F.col("instance").alias("object"), (F.col("instance") % 7).alias("raw"), "segment")
    g = g.union(v.where("label IN (2, 4)").select("scan_id", F.col("instance") + 1000, F.col("instance") % 5, "segment"))
    m = spark.range(5).select(F.col("id").alias("raw"), (F.col("id") + 10).cast("int").alias("label"))
    return op.segments_to_labels(v.select("scan_id", "vertex", "segment"), g, m)


BOX = """SELECT scan_id, instance, (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy, (min(z)+max(z))/2 AS cz,
 max(x)-min(x) AS dx, max(y)-min(y) AS dy, max(z)-min(z) AS dz, arg_min(label, point_id) AS label FROM points GROUP BY 1,2"""


@case("C13_instance_boxes", f"SELECT * FROM ({BOX}) WHERE label IN (1, 2, 3, 4)", "points")
def instance_boxes(spark, sf):
    return op.instance_boxes(fx.points(spark, sf), classes=[1, 2, 3, 4])


@case("C14_instance_targets", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY instance) AS no FROM ({BOX}) WHERE label IN (1,2,3))
SELECT p.point_id, coalesce(b.no, 0) AS instance_no, b.no IS NOT NULL AS instance_mask, coalesce(b.cx-p.x, CAST(0 AS DOUBLE)) AS vote_x,
 coalesce(b.cz-p.z, CAST(0 AS DOUBLE)) AS vote_z FROM points p LEFT JOIN b USING (scan_id, instance)""", "points")
def instance_targets(spark, sf):
    out = op.instance_targets(fx.points(spark, sf), [1, 2, 3], max_objects=100000)
    return out.select("point_id", "instance_no", "instance_mask", "vote_x", "vote_z")


# Mean box sizes per class of the test set.
MEAN_SIZES = [(8.0, 6.0, 3.0), (7.0, 5.0, 2.5), (6.0, 4.0, 2.0)]


@case("C15_box_targets", f"""SELECT scan_id, instance, label, label-1 AS size_class, row_number() OVER (PARTITION BY scan_id ORDER BY instance) AS object_no,
 dx-([CAST(8 AS DOUBLE),7,6])[label] AS residual_x, dz-([CAST(3 AS DOUBLE),2.5,2])[label] AS residual_z FROM ({BOX}) WHERE label IN (1,2,3)""", "points")
def box_targets(spark, sf):
    out = op.box_targets(fx.points(spark, sf), {1: 0, 2: 1, 3: 2}, MEAN_SIZES, max_objects=100000)
    return out.select("scan_id", "instance", "label", "size_class", "object_no", "residual_x", "residual_z")


@case("C16_dense_rows", "SELECT scan_id, point_id, x, label FROM points", "points")
def dense_rows(spark, sf):
    return op.from_arrays(op.to_arrays(fx.points(spark, sf), ["x", "label"], chunk=1000), ["x", "label"])


@case("C17_stack_scans", """WITH l AS (SELECT scan_id, point_id, row_number() OVER (PARTITION BY scan_id ORDER BY point_id)-1 AS local_id FROM points),
n AS (SELECT scan_id, count(*) AS n FROM points GROUP BY 1), o AS (SELECT scan_id, CAST(sum(n) OVER (ORDER BY scan_id)-n AS BIGINT) AS off FROM n)
SELECT point_id, scan_id, local_id+off AS stacked_id, local_id AS back FROM l JOIN o USING (scan_id)""", "points")
def stack_scans(spark, sf):
    p = op.with_point_id(fx.points(spark, sf).select("scan_id", "point_id"), "local_id", "point_id")
    stacked = op.stack_scans(p, point_id="local_id").drop("local_id")
    back = op.unstack_scans(stacked.withColumn("keep", F.col("stacked_id")), "back")
    return back.withColumnRenamed("keep", "stacked_id")


CSR = """WITH c AS (SELECT user_id%200 AS g, count(*) AS n FROM events GROUP BY 1)
, f AS (SELECT id AS g, coalesce(n, 0) AS n FROM range(0,250) t(id) LEFT JOIN c ON c.g=id)
, p AS (SELECT g, CAST(sum(n) OVER (ORDER BY g)-n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY g) AS BIGINT) AS stop FROM f)"""


@case("C18_rows_to_csr", f"""{CSR} SELECT 'p' AS part, g AS a, start AS b, stop AS c FROM p UNION ALL
SELECT 'v', start+row_number() OVER (PARTITION BY g ORDER BY event_id)-1, event_id, 0 FROM events JOIN p ON g=user_id%200
UNION ALL SELECT 'r', user_id%200, event_id, 0 FROM events""")
def rows_to_csr(spark, sf):
    rows = fx.read(spark, sf, "events").select((F.col("user_id") % 200).alias("group"), F.col("event_id").alias("value"))
    pointers, values = op.rows_to_csr(rows, 250)
    back = op.csr_to_rows(pointers, values)
    zero = F.lit(0).cast("long")
    return (pointers.select(F.lit("p").alias("part"), F.col("group").alias("a"), F.col("start").alias("b"), F.col("stop").alias("c"))
            .union(values.select(F.lit("v"), "position", "value", zero)).union(back.select(F.lit("r"), "group", "value", zero)))


@case("C19_group_by_settings", """SELECT image_id, md5(camera||'|'||CAST(px_w AS VARCHAR)||'|'||CAST(px_h AS VARCHAR)) AS setting_id FROM images""", "images")
def group_by_settings(spark, sf):
    return op.with_setting_id(fx.images(spark, sf), ["camera", "px_w", "px_h"]).select("image_id", "setting_id")


@case("C20_lexicographic_ops", """SELECT 'first' AS part, l_suppkey AS a, CAST(l_linenumber AS BIGINT) AS b, min(l_orderkey) AS c FROM lineitem GROUP BY 2,3
UNION ALL SELECT 'unique', o_custkey%50, o_orderkey%7, 0 FROM orders GROUP BY 2,3
UNION ALL SELECT 'argsort', o_orderkey, row_number() OVER (ORDER BY o_custkey%50, o_orderkey%7, o_orderkey)-1, 0 FROM orders""")
def lexicographic(spark, sf):
    li = fx.read(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("long").alias("ln"), "l_orderkey")
    first = op.first_per_key(li, ["l_suppkey", "ln"], ["l_orderkey"])
    o = fx.read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 7).alias("b"), "o_orderkey")
    zero = F.lit(0).cast("long")
    return (first.select(F.lit("first").alias("part"), F.col("l_suppkey").alias("a"), F.col("ln").alias("b"), F.col("l_orderkey").alias("c"))
            .union(op.lex_unique(o, ["a", "b"]).select(F.lit("unique"), "a", "b", zero))
            .union(op.lex_position(o, ["a", "b"], "o_orderkey").select(F.lit("argsort"), "o_orderkey", "position", zero)))


@case("C21_clamp_batch", f"""
WITH RECURSIVE s AS (SELECT o_orderkey//8 AS batch_id, row_number() OVER (PARTITION BY o_orderkey//8 ORDER BY o_orderkey) AS k,
 o_orderkey AS sample_pos, {h('n', 'o_orderkey')}%40000 AS n FROM orders),
w AS (SELECT batch_id, k, sample_pos, n, CASE WHEN n<=100000 THEN n ELSE 0 END AS t, n<=100000 AS ok FROM s WHERE k=1
 UNION ALL SELECT s.batch_id, s.k, s.sample_pos, s.n, CASE WHEN w.t+s.n<=100000 THEN w.t+s.n ELSE w.t END, w.t+s.n<=100000
 FROM w JOIN s ON s.batch_id=w.batch_id AND s.k=w.k+1)
SELECT batch_id, sample_pos, n AS n_points FROM w WHERE ok""")
def clamp_batch(spark, sf):
    s = fx.read(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 8).alias("batch_id"), F.col("o_orderkey").alias("sample_pos"), (key_hash("n", "o_orderkey") % 40000).alias("n_points"))
    return op.clamp_batches(s, 100000)


@case("C22_normalise_feature", f"""WITH m AS (SELECT min(x) AS lo, max(x)-min(x) AS d, avg(z) AS mu, stddev_samp(z) AS sd FROM points),
e AS (SELECT min(v) AS lo, max(v)-min(v) AS d FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))
SELECT point_id AS id, -1 AS channel, {six('(x-lo)/d')} AS a, {six('(z-mu)/sd')} AS b FROM points, m
UNION ALL SELECT vec_id, c, {six('(v-lo)/d')}, CAST(0 AS DOUBLE) FROM (SELECT vec_id, unnest(range(0,64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), e""", "points")
def normalise_feature(spark, sf):
    from pointweave.functions.maths import six_digits
    p = op.normalise_feature(op.normalise_feature(fx.points(spark, sf), "x"), "z", standardise=True)
    e = fx.read(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    e = op.normalise_feature(e, "embedding").select("vec_id", F.posexplode("embedding").alias("c", "v"))
    return p.select(F.col("point_id").alias("id"), F.lit(-1).cast("long").alias("channel"), six_digits("x").alias("a"), six_digits("z").alias("b")).union(
        e.select("vec_id", F.col("c").cast("long"), six_digits("v"), F.lit(0.0)))


@case("C23_normalise_rgb", "SELECT point_id, CASE WHEN scan_id=0 THEN r/256 ELSE r/255 END AS r FROM points", "points")
def normalise_rgb(spark, sf):
    p = fx.points(spark, sf).withColumns({c: F.when(F.col("scan_id") == 0, F.col(c) / 256).otherwise(F.col(c)) for c in "rgb"})
    return op.normalise_rgb(p).select("point_id", "r")


@case("C25_scale_and_centre", f"""WITH m AS (SELECT scan_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY 1),
c AS (SELECT p.scan_id, point_id, x-mx AS x, y-my AS y, z-mz AS z FROM points p JOIN m USING (scan_id)),
s AS (SELECT scan_id, max(greatest(abs(x),abs(y))) AS s FROM c GROUP BY 1)
SELECT point_id, {six('x*(CAST(0.999999 AS DOUBLE)/s)*2')} AS x, {six('z*2')} AS z FROM c JOIN s USING (scan_id)""", "points")
def scale_and_centre(spark, sf):
    p = op.scale_pos(op.cylinder_normalise(fx.points(spark, sf)), 2.0)
    return p.select("point_id", fx_six("x"), fx_six("z"))


@case("C26_library_steps", f"""WITH m AS (SELECT scan_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points GROUP BY 1),
c AS (SELECT p.scan_id, point_id, x-mx AS x, y-my AS y, z-mz AS z FROM points p JOIN m USING (scan_id)),
s AS (SELECT scan_id, max(greatest(abs(x),abs(y),abs(z))) AS s FROM c GROUP BY 1)
SELECT point_id, {six('x*(CAST(0.999999 AS DOUBLE)/s)')} AS x, {six('z*(CAST(0.999999 AS DOUBLE)/s)')} AS z FROM c JOIN s USING (scan_id)""", "points")
def library_steps(spark, sf):
    return op.normalise_scale(fx.points(spark, sf)).select("point_id", fx_six("x"), fx_six("z"))


A23 = f"""WITH RECURSIVE s AS (SELECT p_partkey%7 AS seq, p_partkey AS frame, row_number() OVER (PARTITION BY p_partkey%7 ORDER BY p_partkey) AS k,
 {h('bad', 'p_partkey')}%5=0 AS bad FROM part),
w AS (SELECT seq, frame, k, CASE WHEN bad THEN 0 ELSE 1 END AS i, NOT bad AS ok FROM s WHERE k=1
 UNION ALL SELECT s.seq, s.frame, s.k, CASE WHEN w.i%3=0 AND s.bad THEN w.i ELSE w.i+1 END, w.i%3=0 AND NOT s.bad
 FROM w JOIN s ON s.seq=w.seq AND s.k=w.k+1)
SELECT seq, frame FROM w WHERE ok"""


@case("A23_drop_corrupt_frames", A23)
def drop_corrupt(spark, sf):
    bad = key_hash("bad", "p_partkey") % 5 == 0
    f = fx.read(spark, sf, "part").select((F.col("p_partkey") % 7).alias("seq"), F.col("p_partkey").alias("frame"),
                                          F.array(F.lit(1.0), F.when(bad, F.lit(float("nan"))).otherwise(F.lit(2.0))).alias("values"))
    return op.drop_corrupt_frames(f, 3, bits=6).select("seq", "frame")
