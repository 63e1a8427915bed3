"""Region, crop, drop and augmentation queries."""

import math

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.operators import augment as au, regions as op, tables, voxel

from . import fixtures as fx
from .registry import case
from .voxel_cases import CENTRES

six, h, u = fx.six, fx.h, fx.u
D = lambda v: f"CAST({v} AS DOUBLE)"
PI = D(math.pi)


def n01(seed, *keys):
    """SQL text of rand.normal."""
    return f"(sqrt(-2*ln((CAST({h(seed + '/u', *keys)} AS DOUBLE)+1)/CAST(4294967296 AS DOUBLE)))*cos({D(2 * math.pi)}*{u(seed + '/v', *keys)}))"


def d2(q="c", s="p", axes="xyz"):
    return "+".join(f"({q}.{a}-{s}.{a})*({q}.{a}-{s}.{a})" for a in axes)


SIX = "SELECT point_id, {} FROM points"
IMG = "ce AS (SELECT scan_id, image_id AS centre_id, cx AS x, cy AS y, cz AS z FROM images)"


def centres(spark, sf):
    return fx.images(spark, sf).select("scan_id", F.col("image_id").alias("centre_id"), *[F.col(f"c{a}").alias(a) for a in "xyz"])


@case("F1_sphere_sample", f"WITH {IMG} SELECT p.scan_id, centre_id, point_id, p.x-c.x AS x, p.label FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE {d2()}<=1", "points images")
def sphere_sample(spark, sf):
    return op.sphere_sample(fx.points(spark, sf), centres(spark, sf), 1.0, align=True).select("scan_id", "centre_id", "point_id", "x", "label")


@case("F2_cylinder_sample", f"WITH {IMG} SELECT p.scan_id, centre_id, point_id, p.x-c.x AS x, p.z FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE {d2(axes='xy')}<=1", "points images")
def cylinder_sample(spark, sf):
    return op.cylinder_sample(fx.points(spark, sf), centres(spark, sf), 1.0, align=True).select("scan_id", "centre_id", "point_id", "x", "z")


RC = "c AS (SELECT scan_id, arg_min(row(x, y, z, point_id), row({}, point_id)) AS q FROM points GROUP BY 1), ce AS (SELECT scan_id, q[1] AS x, q[2] AS y, q[3] AS z, q[4] AS centre_id FROM c)"


@case("F3_random_sphere", f"WITH {RC.format(h('rs', 'scan_id', 'point_id'))} SELECT p.scan_id, centre_id, point_id FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE {d2()}<=2.25", "points")
def random_sphere(spark, sf):
    return op.random_sphere(fx.points(spark, sf), 1.5, "rs").select("scan_id", "centre_id", "point_id")


@case("F3_random_sphere_balanced", f"""WITH k AS (SELECT scan_id, label, count(*) AS n, arg_min(row(x, y, z, point_id), row({h('rb', 'scan_id', 'point_id')}, point_id)) AS q FROM points GROUP BY 1,2),
c AS (SELECT scan_id, arg_max(q, row(ln(greatest({u('rb/class', 'scan_id', 'label')}, {D(1e-12)}))*sqrt(n), label)) AS q FROM k GROUP BY 1), ce AS (SELECT scan_id, q[1] AS x, q[2] AS y, q[3] AS z, q[4] AS centre_id FROM c)
SELECT p.scan_id, centre_id, point_id FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE {d2()}<=2.25""", "points")
def random_sphere_balanced(spark, sf):
    return op.random_sphere(fx.points(spark, sf), 1.5, "rb", balanced=True).select("scan_id", "centre_id", "point_id")


GC = "gc AS (SELECT scan_id, max(point_id) AS centre_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY scan_id, round_even(x/3,0), round_even(y/3,0), round_even(z/3,0))"


@case("F4_grid_spheres", f"""WITH {GC}, lb AS (SELECT c.scan_id, c.centre_id, arg_min(p.label, row({d2()}, p.point_id)) AS centre_label FROM gc c JOIN points p ON c.scan_id=p.scan_id GROUP BY 1,2)
SELECT p.scan_id, c.centre_id, point_id, centre_label FROM gc c JOIN points p ON c.scan_id=p.scan_id JOIN lb ON lb.scan_id=c.scan_id AND lb.centre_id=c.centre_id WHERE {d2()}<=1""", "points")
def grid_spheres(spark, sf):
    return op.grid_spheres(fx.points(spark, sf), 1.0, 3.0).select("scan_id", "centre_id", "point_id", "centre_label")


@case("F5_grid_cylinders", f"WITH {GC} SELECT p.scan_id, centre_id, point_id FROM gc c JOIN points p ON c.scan_id=p.scan_id WHERE {d2(axes='xy')}<=1", "points")
def grid_cylinders(spark, sf):
    return op.grid_cylinders(fx.points(spark, sf), 1.0, 3.0).select("scan_id", "centre_id", "point_id")


@case("F6_index_cylinders", f"""{CENTRES} SELECT scan_id AS window_id, point_id AS centre_id, row_number() OVER (ORDER BY scan_id, point_id)-1 AS index FROM m""", "points")
def index_cylinders(spark, sf):
    c = voxel.sampling_centres(fx.points(spark, sf), 2.0)
    return op.cylinder_index(c.select(F.col("scan_id").alias("window_id"), F.col("point_id").alias("centre_id")))


@case("F7_fixed_count_and_drop", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {h('fc', 'scan_id', 'point_id')}, point_id) AS rn, count(*) OVER (PARTITION BY scan_id) AS n,
 row_number() OVER (PARTITION BY scan_id ORDER BY point_id) AS k FROM points)
SELECT 'count' AS how, scan_id, point_id, -1 AS draw FROM r WHERE rn<=64 UNION ALL SELECT 'drop', scan_id, point_id, -1 FROM r WHERE NOT {u('fc/scan', 'scan_id')}<0.7 OR rn<=floor(n*0.75)
UNION ALL SELECT 'replace', s.scan_id, r.point_id, d FROM (SELECT DISTINCT scan_id, n FROM r) s, range(0,32) t(d) JOIN r ON r.scan_id=s.scan_id AND r.k={h('fc', 's.scan_id', 'd')}%s.n+1""", "points")
def fixed_count(spark, sf):
    p = fx.points(spark, sf).select("scan_id", "point_id")
    none = F.lit(-1).cast("long")
    return (op.random_points(p, 64, "fc").select(F.lit("count").alias("how"), "scan_id", "point_id", none.alias("draw"))
            .union(op.random_drop(p, 0.25, 0.7, "fc").select(F.lit("drop"), "scan_id", "point_id", none))
            .union(op.random_points(p, 32, "fc", replace=True).select(F.lit("replace"), "scan_id", "point_id", F.col("draw").cast("long"))))


@case("F8_select", "SELECT scan_id, point_id, x, point_id*10+c AS new_id FROM points, range(0,2) t(c) WHERE label IN (1, 4)", "points")
def select(spark, sf):
    p = fx.points(spark, sf).select("scan_id", "point_id", "x", "label")
    ids = p.where("label IN (1, 4)").select("scan_id", "point_id", F.explode(F.array(F.col("point_id") * 10, F.col("point_id") * 10 + 1)).alias("new_id"))
    return op.select_points(p.drop("label"), ids)


@case("F9_farthest_point_sample", """WITH RECURSIVE f AS (SELECT scan_id, min(point_id) AS pid, arg_min(x, point_id) AS px, arg_min(y, point_id) AS py, arg_min(z, point_id) AS pz FROM points GROUP BY 1),
r AS (SELECT scan_id, 0 AS turn, point_id, x, y, z, CAST('infinity' AS DOUBLE) AS d, pid, px, py, pz FROM points JOIN f USING (scan_id) UNION ALL
 SELECT scan_id, turn+1, point_id, x, y, z, nd, first_value(point_id) OVER w, first_value(x) OVER w, first_value(y) OVER w, first_value(z) OVER w
 FROM (SELECT *, CASE WHEN point_id=pid THEN -1 ELSE least(d, (x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) END AS nd FROM r WHERE turn<47) WINDOW w AS (PARTITION BY scan_id ORDER BY nd DESC, point_id))
SELECT DISTINCT scan_id, turn, pid AS point_id FROM r""", "points")
def fps(spark, sf):
    return op.fps(fx.points(spark, sf), 48)


@case("F10_sphere_dropout", f"WITH {IMG} SELECT p.scan_id, p.point_id FROM points p ANTI JOIN ce c ON c.scan_id=p.scan_id AND {d2()}<=0.5625", "points images")
def sphere_dropout(spark, sf):
    return op.sphere_dropout(fx.points(spark, sf), centres(spark, sf), 0.75).select("scan_id", "point_id")


@case("F11_sphere_crop", f"WITH {RC.format(h('sc', 'scan_id', 'point_id'))} SELECT p.scan_id, point_id FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE {d2()}<=4 AND {d2()}>0", "points")
def sphere_crop(spark, sf):
    return op.sphere_crop(fx.points(spark, sf), 2.0, "sc").select("scan_id", "point_id")


@case("F12_cube_crop", f"WITH {RC.format(h('cc', 'scan_id', 'point_id'))} SELECT p.scan_id, point_id FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE abs(p.x-c.x)<1.5 AND abs(p.y-c.y)<1.5 AND abs(p.z-c.z)<1.5", "points")
def cube_crop(spark, sf):
    return op.cube_crop(fx.points(spark, sf), 1.5, 0.0, "cc").select("scan_id", "point_id")


@case("F12_cube_crop_turned")
def cube_crop_turned(spark, sf):
    return op.cube_crop(fx.points(spark, sf), 1.5, 180.0, "cc").select("scan_id", "point_id")


@case("F13_ellipsoid_crop", f"WITH {RC.format(h('ec', 'scan_id', 'point_id'))} SELECT p.scan_id, point_id FROM ce c JOIN points p ON c.scan_id=p.scan_id WHERE (p.x-c.x)*(p.x-c.x)/4+(p.y-c.y)*(p.y-c.y)/1+(p.z-c.z)*(p.z-c.z)/16<1", "points")
def ellipsoid_crop(spark, sf):
    return op.ellipsoid_crop(fx.points(spark, sf), 2.0, 1.0, 4.0, 0.0, "ec").select("scan_id", "point_id")


@case("F14_density_filter", f"SELECT p.scan_id, p.point_id FROM cloud p JOIN cloud c ON c.scan_id=p.scan_id AND {d2()}<=0.0625 AND {d2()}>0 GROUP BY 1,2 HAVING count(*)>20", "cloud")
def density_filter(spark, sf):
    return op.density_filter(fx.cloud(spark, sf), 0.25, 20).select("scan_id", "point_id")


@case("F15_irregular_sample", f"""WITH {RC.format(h('ir/centre', 'scan_id', 'point_id'))} SELECT p.scan_id, point_id FROM ce c JOIN points p ON c.scan_id=p.scan_id
WHERE {u('ir', 'p.scan_id', 'point_id')}<exp(-({d2()})/(2*(2.25/(2*ln({D(2)})))))""", "points")
def irregular(spark, sf):
    return op.irregular_sample(fx.points(spark, sf), 1.5, 2, "ir").select("scan_id", "point_id")


def _pc(a):
    return f"({a}-({u(f'pe/{a}', 'scan_id')}-0.5)*2*4)*({a}-({u(f'pe/{a}', 'scan_id')}-0.5)*2*4)"


@case("F16_periodic_sample", f"SELECT scan_id, point_id FROM points WHERE cos(sqrt({_pc('x')}+{_pc('y')}+{_pc('z')})*({D(2 * math.pi / 0.7)}))>{D(math.cos(math.pi * 0.4))}", "points")
def periodic(spark, sf):
    return op.periodic_sample(fx.points(spark, sf), 0.7, 0.4, 4.0, "pe").select("scan_id", "point_id")


@case("F17_random_walk_drop")
def random_walk(spark, sf):
    return op.random_walk_drop(fx.points(spark, sf), 200, 0.3, 0.4, "walk").select("scan_id", "point_id")


@case("F18_patches", f"""WITH k AS (SELECT scan_id, max(point_id) AS point_id FROM points GROUP BY scan_id, round_even(x/1.0, 0), round_even(y/1.0, 0), round_even(z/1.0, 0)),
c AS (SELECT points.* FROM points JOIN k USING (scan_id, point_id))
SELECT p.scan_id, c.point_id AS centre_id, p.point_id, p.label FROM c JOIN points p ON c.scan_id=p.scan_id WHERE {d2()}<=0.25 AND {d2()}>0""", "points")
def patches(spark, sf):
    """Around one point of every voxel of a metre."""
    p = fx.points(spark, sf)
    keys = voxel.grid_sample(p, 1.0, mode="last").withColumnRenamed("point_id", "centre_id")
    return op.patches(p, keys, 0.5).select("scan_id", "centre_id", "point_id", "label")


# ------------------------------------------------------------------ augmentation

@case("G1_jitter", f"SELECT point_id, {six('x+greatest(-0.05, least(0.05, ' + n01('jt/x', 'scan_id', 'point_id') + '*0.02))')} AS x FROM points", "points")
def jitter(spark, sf):
    return au.jitter(fx.points(spark, sf), ["x"], 0.02, 0.05, 1.0, "jt").select("point_id", six_digits("x").alias("x"))


_A = {a: f"(({u(f'ro/{a}', 'scan_id')}-0.5)*2*{D(math.radians(180.0))})" for a in "xyz"}
_ROT = f"""WITH t0 AS (SELECT scan_id, point_id, x, y, z, {_A['x']} AS ax, {_A['y']} AS ay, {_A['z']} AS az, {h('ro/order', 'scan_id')}%6 AS o FROM points)"""
for _i in range(3):
    _ax = lambda n: f"CASE o WHEN 0 THEN '{'xyz'[n]}' WHEN 1 THEN '{'xzy'[n]}' WHEN 2 THEN '{'yxz'[n]}' WHEN 3 THEN '{'yzx'[n]}' WHEN 4 THEN '{'zxy'[n]}' ELSE '{'zyx'[n]}' END"
    _ROT += f""", s{_i} AS (SELECT *, {_ax(_i)} AS w FROM t{_i}),
t{_i + 1} AS (SELECT scan_id, point_id, ax, ay, az, o, CASE w WHEN 'x' THEN x WHEN 'y' THEN cos(ay)*x+sin(ay)*z ELSE cos(az)*x-sin(az)*y END AS x,
 CASE w WHEN 'x' THEN cos(ax)*y-sin(ax)*z WHEN 'y' THEN y ELSE sin(az)*x+cos(az)*y END AS y, CASE w WHEN 'x' THEN sin(ax)*y+cos(ax)*z WHEN 'y' THEN -sin(ay)*x+cos(ay)*z ELSE z END AS z FROM s{_i})"""


@case("G2_rotate", f"{_ROT} SELECT point_id, {six('x')} AS x, {six('y')} AS y, {six('z')} AS z FROM t3", "points")
def rotate(spark, sf):
    return au.rotate(fx.points(spark, sf), seed="ro").select("point_id", *[six_digits(a).alias(a) for a in "xyz"])


@case("G3_translate", SIX.format(f"{six('x+-0.5+' + u('tr/x', 'scan_id') + '*1')} AS x, {six('z+-0.5+' + u('tr/z', 'scan_id') + '*1')} AS z"), "points")
def translate(spark, sf):
    return au.translate(fx.points(spark, sf), -0.5, 0.5, "tr").select("point_id", six_digits("x").alias("x"), six_digits("z").alias("z"))


@case("G4_scale", f"WITH f AS (SELECT *, 0.5+{u('sl/x', 'scan_id')} AS fa, 0.5+{u('sl/y', 'scan_id')} AS fb, 0.5+{u('sl/z', 'scan_id')} AS fc FROM points) SELECT point_id, {six('x*fa')} AS x, {six('(1/fa)/sqrt(1/fa*(1/fa)+2/fb*(2/fb)+2/fc*(2/fc))')} AS nx FROM f", "points")
def scale(spark, sf):
    p = fx.points(spark, sf).withColumns({"nx": F.lit(1.0), "ny": F.lit(2.0), "nz": F.lit(2.0)})
    return au.scale_random(p, 0.5, 1.5, "sl").select("point_id", six_digits("x").alias("x"), six_digits("nx").alias("nx"))


@case("G5_mirror", f"""SELECT point_id, CASE WHEN {u('mi/x', 'scan_id')}<0.5 THEN mx-x ELSE x END AS x, CASE WHEN {u('mi/y', 'scan_id')}<0.5 THEN my-y ELSE y END AS y
FROM points JOIN (SELECT scan_id, max(x) AS mx, max(y) AS my FROM points GROUP BY 1) USING (scan_id)""", "points")
def mirror(spark, sf):
    return au.mirror(fx.points(spark, sf), ["x", "y"], 0.5, "mi").select("point_id", "x", "y")


@case("G6_shift_voxels", SIX.format(f"CAST(round_even(x/0.5,0)+floor({u('sv/vx', 'scan_id')}*100) AS BIGINT) AS vx"), "points")
def shift_voxels(spark, sf):
    return au.shift_voxels(voxel.quantize(fx.points(spark, sf), 0.5), "sv").select("point_id", "vx")


def unit(spark, sf):
    return fx.points(spark, sf).withColumns({c: F.col(c) / 256 for c in "rgb"})


def clamp01(e):
    return f"greatest(0, least(1, {e}))"


@case("G7_colour_shift", SIX.format(f"CASE WHEN {u('cs/on', 'scan_id')}<0.5 THEN {six(clamp01('r/256+(' + u('cs/r', 'scan_id') + '-0.5)*2*0.2'))} ELSE {six('r/256')} END AS r"), "points")
def colour_shift(spark, sf):
    return au.colour_shift(unit(spark, sf), 0.2, "cs", 0.5).select("point_id", six_digits("r").alias("r"))


@case("G7_colour_contrast", f"""SELECT point_id, {six('(1-' + u('co/blend', 'scan_id') + ')*r/256+' + u('co/blend', 'scan_id') + '*((r-lo)/(hi-lo))')} AS r
FROM points JOIN (SELECT scan_id, min(r) AS lo, max(r) AS hi FROM points GROUP BY 1) USING (scan_id)""", "points")
def colour_contrast(spark, sf):
    return au.colour_contrast(unit(spark, sf), "co", 1.0).select("point_id", six_digits("r").alias("r"))


@case("G7_colour_noise", SIX.format(f"{six(clamp01('r/256+' + n01('cn/r', 'scan_id', 'point_id') + '*0.1'))} AS r"), "points")
def colour_noise(spark, sf):
    return au.colour_noise(unit(spark, sf), 0.1, "cn", 1.0).select("point_id", six_digits("r").alias("r"))


@case("G8_drop_feature", SIX.format(f"CASE WHEN {u('df', 'scan_id', 'instance')}<0.3 THEN 0 ELSE r END AS r"), "points")
def drop_feature(spark, sf):
    return au.drop_feature(fx.points(spark, sf), "r", 0.3, "df", ["scan_id", "instance"]).select("point_id", "r")


def _lat(prev, axis):
    join = " AND ".join(f"b.{k}{'+t.d' if k == axis else ''}=a.{k}" for k in "ijk")
    return f"SELECT a.scan_id, a.i, a.j, a.k, sum(b.v)/3 AS v FROM {prev} a, range(-1,2) t(d) JOIN {prev} b ON b.scan_id=a.scan_id AND {join} GROUP BY 1,2,3,4"


_steps = ", ".join(f"l{n + 1} AS ({_lat(f'l{n}', 'ijkijk'[n])})" for n in range(6))


@case("G9_elastic", f"""WITH b AS (SELECT scan_id, min(x) AS ox, min(y) AS oy, min(z) AS oz, CAST(floor((max(x)-min(x))/1) AS BIGINT)+3 AS nx, CAST(floor((max(y)-min(y))/1) AS BIGINT)+3 AS ny, CAST(floor((max(z)-min(z))/1) AS BIGINT)+3 AS nz FROM points GROUP BY 1),
l0 AS (SELECT scan_id, i, j, k, {n01('el/1.0/x', 'scan_id', 'i', 'j', 'k')} AS v FROM (SELECT *, unnest(range(0, nz)) AS k FROM (SELECT *, unnest(range(0, ny)) AS j FROM (SELECT *, unnest(range(0, nx)) AS i FROM b)))), {_steps},
t AS (SELECT p.scan_id, point_id, x, (x-ox)/1+1 AS tx, (y-oy)/1+1 AS ty, (z-oz)/1+1 AS tz FROM points p JOIN b ON b.scan_id=p.scan_id),
w AS (SELECT scan_id, point_id, x, CAST(floor(tx) AS BIGINT)+di AS i, CAST(floor(ty) AS BIGINT)+dj AS j, CAST(floor(tz) AS BIGINT)+dk AS k,
 (CASE di WHEN 1 THEN tx-floor(tx) ELSE 1-tx+floor(tx) END)*(CASE dj WHEN 1 THEN ty-floor(ty) ELSE 1-ty+floor(ty) END)*(CASE dk WHEN 1 THEN tz-floor(tz) ELSE 1-tz+floor(tz) END) AS w FROM t, range(0,2) a(di), range(0,2) b2(dj), range(0,2) c(dk))
SELECT point_id, {six('max(w.x)+sum(w*v)*0.4')} AS x FROM w JOIN l6 ON l6.scan_id=w.scan_id AND l6.i=w.i AND l6.j=w.j AND l6.k=w.k GROUP BY 1""", "points")
def elastic(spark, sf):
    return au.elastic(fx.points(spark, sf), [1.0], [0.4], "el", 1.0).select("point_id", six_digits("x").alias("x"))


@case("G10_shuffle", f"SELECT scan_id, point_id, row_number() OVER (PARTITION BY scan_id ORDER BY {h('sh', 'scan_id', 'point_id')}, point_id)-1 AS shuffled FROM points", "points")
def shuffle(spark, sf):
    return au.shuffle_ids(fx.points(spark, sf).select("scan_id", "point_id"), "sh")


@case("G11_pick_or_draw", f"SELECT scan_id, point_id, CASE {h('of', 'scan_id')}%3 WHEN 0 THEN x*2 WHEN 1 THEN x+1 ELSE (x+1)*2 END AS x FROM points", "points")
def pick_or_draw(spark, sf):
    double = lambda d: tables.scale_pos(d, 2.0)
    add = lambda d: d.withColumn("x", F.col("x") + 1)
    return au.one_of(fx.points(spark, sf), [double, add, au.compose(add, double)], "of").select("scan_id", "point_id", "x")
