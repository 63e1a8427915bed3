"""Camera and visibility queries."""

import math

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.operators import camera as cam, neighbours as nb, visibility as op

from . import fixtures as fx
from .registry import case

six, h = fx.six, fx.h
PI = "CAST(3.141592653589793 AS DOUBLE)"
LN1000 = "CAST(6.907755278982137 AS DOUBLE)"


def _pose(axis):
    """Row of the turn from world to camera: panoramas by opk (omega is 0), others by the transposed pose."""
    rows = {1: ("cos(phi)*ck", "-(cos(phi)*sk)", "sin(phi)"), 2: ("sk", "ck", "CAST(0 AS DOUBLE)"), 3: ("-(sin(phi)*ck)", "sin(phi)*sk", "cos(phi)")}
    pose = {1: ("ck", "sk", "CAST(0 AS DOUBLE)"), 2: ("-sk", "ck", "CAST(0 AS DOUBLE)"), 3: ("CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)")}
    return [f"CASE WHEN camera='equirectangular' THEN {a} ELSE {b} END" for a, b in zip(rows[axis], pose[axis])]


CAMS = "cams AS (SELECT *, " + ", ".join(f"{e} AS m{i}{j+1}" for i in (1, 2, 3) for j, e in enumerate(_pose(i))) + " FROM images)"
RMAX = 5.0
CAND = f"""{CAMS},
cand AS (SELECT c.*, p.point_id, p.x, p.y, p.z, p.label, x-cx AS dx, y-cy AS dy, z-cz AS dz,
 sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS dist FROM points p JOIN cams c ON p.scan_id=c.scan_id
 WHERE (cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)<25 AND (cx-x)*(cx-x)+(cy-y)*(cy-y)+(cz-z)*(cz-z)>0.25)"""


def _fish(dz):
    return f"""m11*dx+m12*dy+m13*{dz} AS p1, m21*dx+m22*dy+m23*{dz} AS p2, m31*dx+m32*dy+m33*{dz} AS p3"""


PROJ = f"""{CAND},
pr0 AS (SELECT *, {_fish('dz')} FROM cand),
pr1 AS (SELECT *, sqrt(p1*p1+p2*p2+p3*p3) AS nn FROM pr0),
pr2 AS (SELECT *, (p1/(nn+CAST(1e-4 AS DOUBLE)))/(p3/(nn+CAST(1e-4 AS DOUBLE))+xi) AS qx, (p2/(nn+CAST(1e-4 AS DOUBLE)))/(p3/(nn+CAST(1e-4 AS DOUBLE))+xi) AS qy FROM pr1),
pr3 AS (SELECT *, 1+k1*(qx*qx+qy*qy)+k2*((qx*qx+qy*qy)*(qx*qx+qy*qy)) AS rad FROM pr2),
pr4 AS (SELECT *, (px_w-1)*(1-atan2(p2,p1)/{PI})/2 AS eu, (px_h-1)*acos(greatest(-1, least(1, p3/dist)))/{PI} AS ev FROM pr3),
proj AS (SELECT * EXCLUDE (p1, p2, p3, nn, qx, qy, rad, eu, ev),
 CASE camera WHEN 'equirectangular' THEN eu-px_w*floor(eu/px_w) WHEN 'pinhole' THEN p1*fx/nullif(p3,0)+mx ELSE gamma1*rad*qx+u0 END AS u,
 CASE camera WHEN 'equirectangular' THEN ev-px_h*floor(ev/px_h) WHEN 'pinhole' THEN p2*fy/nullif(p3,0)+my ELSE gamma2*rad*qy+v0 END AS v,
 CASE camera WHEN 'equirectangular' THEN dist WHEN 'pinhole' THEN p3 ELSE nn*p3/abs(p3+CAST(1e-4 AS DOUBLE)) END AS depth_z FROM pr4)"""
FOV = f"{PROJ}, fov AS (SELECT * FROM proj WHERE u>=0 AND u<px_w AND v>=0 AND v<px_h AND depth_z>0)"
VOX = "CAST(0.25 AS DOUBLE)"
SPLAT = f"""{FOV},
sp0 AS (SELECT *, (1+exp(-dist/{LN1000}))*{VOX}/dist AS ang, (1+exp(-sqrt(x*x+y*y+z*z)/{LN1000}))*{VOX}/2 AS lift FROM fov),
sp1 AS (SELECT *, {_fish('(z+lift-cz)')} FROM sp0), sp2 AS (SELECT *, sqrt(p1*p1+p2*p2+p3*p3) AS nn FROM sp1),
sp3 AS (SELECT *, (p1/(nn+CAST(1e-4 AS DOUBLE)))/(p3/(nn+CAST(1e-4 AS DOUBLE))+xi) AS qx, (p2/(nn+CAST(1e-4 AS DOUBLE)))/(p3/(nn+CAST(1e-4 AS DOUBLE))+xi) AS qy FROM sp2),
sp4 AS (SELECT *, 1+k1*(qx*qx+qy*qy)+k2*((qx*qx+qy*qy)*(qx*qx+qy*qy)) AS rad FROM sp3),
sp5 AS (SELECT *, 2*sqrt((u-(gamma1*rad*qx+u0))*(u-(gamma1*rad*qx+u0))+(v-(gamma2*rad*qy+v0))*(v-(gamma2*rad*qy+v0))) AS fw FROM sp4),
sp6 AS (SELECT *, CASE camera WHEN 'equirectangular' THEN ang*px_w/(2*{PI})/(sin({PI}/px_h*v)+0.001) WHEN 'pinhole' THEN ang*fx ELSE fw END AS wx,
 CASE camera WHEN 'equirectangular' THEN ang*px_h/{PI} WHEN 'pinhole' THEN ang*fy ELSE fw END AS wy FROM sp5),
splat AS (SELECT * EXCLUDE (p1, p2, p3, nn, qx, qy, rad, fw, ang, lift),
 CAST(greatest(0, least(round_even(u-wx/2,0), px_w-1)) AS BIGINT) AS xa, CAST(greatest(1, least(round_even(u+wx/2+1,0), px_w)) AS BIGINT) AS xb,
 CAST(greatest(0, least(round_even(v-wy/2,0), px_h-1)) AS BIGINT) AS ya, CAST(greatest(1, least(round_even(v+wy/2+1,0), px_h)) AS BIGINT) AS yb FROM sp6)"""
ZBUF = f"""{SPLAT},
pix AS (SELECT scan_id, image_id, point_id, dist, px, unnest(range(ya, yb)) AS py FROM (SELECT *, unnest(range(xa, xb)) AS px FROM splat)),
zb AS (SELECT scan_id, image_id, px, py, arg_min(point_id, row(dist, point_id)) AS point_id FROM pix GROUP BY 1,2,3,4)"""
EXACT = f"""{ZBUF}, ex AS (SELECT s.scan_id, s.image_id, CAST(trunc(u) AS BIGINT) AS px, CAST(trunc(v) AS BIGINT) AS py, max(s.point_id) AS point_id FROM splat s
 SEMI JOIN zb ON zb.scan_id=s.scan_id AND zb.image_id=s.image_id AND zb.point_id=s.point_id GROUP BY 1,2,3,4)"""


def seen(spark, sf, keep=(), together=False):
    return op.project_views(fx.points(spark, sf), fx.images(spark, sf), RMAX, 0.5, voxel=0.25, carry=("label",), keep=keep, together=together)


def projected(spark, sf, camera, pose="c2w", keep=()):
    cams = cam.prepare_images(fx.images(spark, sf)).where(F.col("camera") == camera)
    return op.projected_views(fx.points(spark, sf), cams, RMAX, 0.5, pose=pose, keep=keep)


@case("H1_candidate_views", f"WITH {CAND} SELECT scan_id, image_id, point_id, {six('dist')} AS dist FROM cand", "points images")
def candidate_views(spark, sf):
    out = op.candidate_views(fx.points(spark, sf), fx.images(spark, sf), RMAX, 0.5)
    return out.select("scan_id", "image_id", "point_id", six_digits(F.sqrt("d2")).alias("dist"))


@case("H1_candidate_views_cylinder", """SELECT i.scan_id, image_id, point_id FROM points p JOIN images i ON p.scan_id=i.scan_id
 WHERE (cx-x)*(cx-x)+(cy-y)*(cy-y)<4 AND (cx-x)*(cx-x)+(cy-y)*(cy-y)>0.25""", "points images")
def candidate_cylinder(spark, sf):
    return op.candidate_views(fx.points(spark, sf), fx.images(spark, sf), 2.0, 0.5, cylinder=True).select("scan_id", "image_id", "point_id")


for _id, _camera in (("H2", "equirectangular"), ("H3", "pinhole"), ("H4", "fisheye")):
    def _project(spark, sf, camera=_camera):
        return projected(spark, sf, camera).select("image_id", "point_id", *[six_digits(F.col(c) * F.abs("depth_z") if c != "depth_z" and camera == "pinhole" else c).alias(c) for c in ("u", "v", "depth_z")])
    # Pinhole pixels grow without bound beside the camera plane, so they are compared times their depth.
    _by = "*abs(depth_z)" if _camera == "pinhole" else ""
    case(f"{_id}_project_{_camera}", f"WITH {PROJ} SELECT image_id, point_id, {six(f'u{_by}')} AS u, {six(f'v{_by}')} AS v, {six('depth_z')} AS depth_z FROM proj WHERE camera='{_camera}'", "points images")(_project)


@case("H3_project_pinhole_inverse", f"""WITH {PROJ} SELECT image_id, point_id, {six('((ck*x+sk*y-(ck*cx+sk*cy))*fx/nullif(z-cz,0)+mx)*(z-cz)')} AS u FROM proj WHERE camera='pinhole'""", "points images")
def project_inverse(spark, sf):
    out = projected(spark, sf, "pinhole", "inv", ("z", "cz"))
    return out.select("image_id", "point_id", six_digits(F.col("u") * (F.col("z") - F.col("cz"))).alias("u"))


@case("H5_field_of_view", f"WITH {FOV} SELECT image_id, point_id FROM fov WHERE camera='equirectangular' AND floor(v)<118", "points images")
def field_of_view(spark, sf):
    mask = spark.range(256).select(F.lit("equirectangular").alias("camera"), F.col("id").alias("px"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(117).cast("long"))).alias("py"))
    return cam.in_view(projected(spark, sf, "equirectangular", keep=("camera", "px_w", "px_h")), mask, on=("camera",)).select("image_id", "point_id")


@case("H6_splat_box", f"WITH {SPLAT} SELECT image_id, point_id, xa, xb, ya, yb FROM splat", "points images")
def splat(spark, sf):
    return seen(spark, sf).select("image_id", "point_id", "xa", "xb", "ya", "yb")


@case("H7_z_buffer", f"WITH {ZBUF} SELECT * FROM zb", "points images")
def z_buffer(spark, sf):
    return op.z_buffer(seen(spark, sf, together=True))


@case("H8_z_buffer_exact", f"WITH {EXACT} SELECT * FROM ex", "points images")
def z_buffer_exact(spark, sf):
    return op.z_buffer(seen(spark, sf, together=True), exact=True)


DM = "dm AS (SELECT image_id, px, py, CASE WHEN raw=65535 THEN CAST(-1 AS DOUBLE) ELSE raw/CAST(512 AS DOUBLE) END AS depth FROM depth_maps)"


@case("A19_read_depth_map", f"WITH {DM} SELECT * FROM dm", "depth_maps")
def depth_raster(spark, sf):
    return op.depth_from_raster(fx.depth_maps(spark, sf))


@case("H9_depth_map_visibility", f"""WITH {DM}, {FOV} SELECT fov.image_id, fov.point_id, dm.px, dm.py FROM fov JOIN dm ON dm.image_id=fov.image_id
 AND dm.px=CAST(trunc(u/8) AS BIGINT) AND dm.py=CAST(trunc(v/8) AS BIGINT) WHERE abs(depth-dist)<=0.5""", "points images depth_maps")
def depth_visibility(spark, sf):
    s = seen(spark, sf).withColumns({"u": F.col("u") / 8, "v": F.col("v") / 8})
    return op.visible_by_depth(s, op.depth_from_raster(fx.depth_maps(spark, sf)), 0.5).select("image_id", "point_id", "px", "py")


@case("H10_knn_visibility", f"""WITH {FOV}, f AS (SELECT image_id, point_id, u, v, dist FROM fov WHERE camera='equirectangular'),
w AS (SELECT image_id, point_id*3 AS slot, u, v, dist FROM f UNION ALL SELECT image_id, point_id*3+1, u+256, v, dist FROM f WHERE u<16
 UNION ALL SELECT image_id, point_id*3+2, u-256, v, dist FROM f WHERE u>=240),
pr AS (SELECT f.image_id, f.point_id, f.dist, w.dist AS dn, row_number() OVER (PARTITION BY f.image_id, f.point_id ORDER BY (f.u-w.u)*(f.u-w.u)+(f.v-w.v)*(f.v-w.v), slot) AS rk FROM f JOIN w ON f.image_id=w.image_id),
a AS (SELECT image_id, point_id, max(dist) AS dist, min(dn) AS lo, max(dn) AS hi FROM pr WHERE rk<=6 GROUP BY 1,2),
al AS (SELECT image_id, point_id, CASE WHEN hi>lo THEN exp(-(((dist-lo)/(hi-lo))*((dist-lo)/(hi-lo)))) ELSE 1 END AS alpha FROM a)
SELECT image_id, point_id, {six('alpha')} AS alpha FROM al WHERE alpha>=0.5""", "points images")
def knn_visibility(spark, sf):
    s = seen(spark, sf, ("camera", "px_w")).where("camera = 'equirectangular'")
    return op.visible_by_knn(s, 6, 16, 0.5).select("image_id", "point_id", six_digits("alpha").alias("alpha"))


@case("H11_view_features", f"""WITH {FOV} SELECT image_id, point_id, {six('(dist-0.5)/(CAST(5 AS DOUBLE)+CAST(1e-4 AS DOUBLE))')} AS depth, {six('v/px_h')} AS height,
 {six('abs(dz/(dist+CAST(1e-4 AS DOUBLE)))')} AS orientation FROM fov""", "points images")
def view_features(spark, sf):
    s = seen(spark, sf, ("px_h", "x", "y", "z", "cx", "cy", "cz")).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)})
    return op.view_features(s, 0.5, RMAX).select("image_id", "point_id", *[six_digits(c).alias(c) for c in ("depth", "height", "orientation")])


MAPPED = f"""{ZBUF}, mp AS (SELECT DISTINCT z.scan_id, z.image_id, z.point_id, z.px//2 AS px, z.py//2 AS py,
 (dist-0.5)/(CAST(5 AS DOUBLE)+CAST(1e-4 AS DOUBLE)) AS depth, v/px_h AS height FROM zb z JOIN splat s ON s.scan_id=z.scan_id AND s.image_id=z.image_id AND s.point_id=z.point_id)"""


def mapping(spark, sf):
    return op.map_images(fx.points(spark, sf), fx.images(spark, sf), r_max=RMAX, r_min=0.5, voxel=0.25, upscale=2)


@case("H12_map_images", f"""WITH {MAPPED}, vw AS (SELECT scan_id, image_id, point_id, max(depth) AS depth, count(*) AS n FROM mp GROUP BY 1,2,3)
SELECT scan_id, image_id, count(*) AS n_points, CAST(sum(n) AS BIGINT) AS n_pixels, {six('avg(depth)')} AS mean_depth FROM vw GROUP BY 1,2""", "points images")
def map_images(spark, sf):
    views = mapping(spark, sf).groupBy("scan_id", "image_id", "point_id").agg(F.max("depth").alias("depth"), F.count("*").alias("n"))
    return views.groupBy("scan_id", "image_id").agg(F.count("*").alias("n_points"), F.sum("n").alias("n_pixels"), six_digits(F.avg("depth")).alias("mean_depth"))


@case("H12_map_images_rows", f"WITH {MAPPED} SELECT scan_id, image_id, point_id, px, py, {six('depth')} AS depth, {six('height')} AS height FROM mp", "points images")
def map_rows(spark, sf):
    return mapping(spark, sf).select("scan_id", "image_id", "point_id", "px", "py", six_digits("depth").alias("depth"), six_digits("height").alias("height"))


@case("H13_static_mask", """WITH r AS (SELECT image_id%8 AS setting_id, arg_min(image_id, image_id) AS ref FROM image_pixels GROUP BY 1),
j AS (SELECT p.image_id%8 AS setting_id, p.px, p.py, bool_or(p.r<>q.r AND p.g<>q.g AND p.b<>q.b) AS d, count(*) AS n FROM image_pixels p JOIN r ON r.setting_id=p.image_id%8
 JOIN image_pixels q ON q.image_id=r.ref AND q.px=p.px AND q.py=p.py GROUP BY 1,2,3) SELECT setting_id, px, py, d OR n<2 AS usable FROM j""", "image_pixels")
def static_mask(spark, sf):
    p = fx.image_pixels(spark, sf).withColumn("setting_id", F.col("image_id") % 8)
    return op.non_static_mask(p, op.reference_pixels(p))


@case("H14_adjust_intrinsics", f"""SELECT image_id, fx*floor(CAST(60 AS DOUBLE)*px_w/px_h)/px_w AS fx, fy*60/px_h AS fy, {six('mx*127/(px_w-1)-4')} AS mx, {six('my*59/(px_h-1)-2')} AS my FROM images""", "images")
def adjust(spark, sf):
    out = cam.adjust_intrinsics(fx.images(spark, sf), 128, 60, 4, 2)
    return out.select("image_id", "fx", "fy", six_digits("mx").alias("mx"), six_digits("my").alias("my"))


@case("H15_camera_axes", f"WITH {CAMS} SELECT image_id, {six('m11')} AS ax_x, {six('m12')} AS ax_y, {six('m23')} AS ay_z, {six('m33')} AS az_z FROM cams", "images")
def axes(spark, sf):
    return cam.camera_axes(fx.images(spark, sf)).select("image_id", *[six_digits(c).alias(c) for c in ("ax_x", "ax_y", "ay_z", "az_z")])


@case("H16_paint_views", """SELECT m.scan_id, image_id, px, py, m.point_id, r, g, b FROM (SELECT scan_id, image_id, px, py, max(point_id) AS point_id FROM maps GROUP BY ALL) m
JOIN points p ON p.scan_id=m.scan_id AND p.point_id=m.point_id""", "points maps")
def paint(spark, sf):
    return op.render(fx.maps(spark, sf), fx.points(spark, sf))
