"""Voxel and grid aggregation queries."""

from pyspark.sql import functions as F

from pointweave.functions.groups import majority
from pointweave.operators import voxel as op

from . import fixtures as fx
from .registry import case

VOX = "scan_id, CAST(round_even(x/0.5,0) AS BIGINT) AS vx, CAST(round_even(y/0.5,0) AS BIGINT) AS vy, CAST(round_even(z/0.5,0) AS BIGINT) AS vz"
VOTED = f"""
WITH c AS (SELECT {VOX}, * EXCLUDE (scan_id) FROM points),
v AS (SELECT scan_id, vx, vy, vz, arg_min(label, row(-n, label)) AS label
      FROM (SELECT scan_id, vx, vy, vz, label, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1,2,3,4)"""


@case("D0_grid_sample", f"""{VOTED},
m AS (SELECT scan_id, vx, vy, vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r, max(point_id) AS point_id,
      bool_and(r>40) AS bright, count(*) AS n FROM c GROUP BY 1,2,3,4)
SELECT m.*, v.label FROM m JOIN v USING (scan_id, vx, vy, vz)""", "points")
def grid_sample(spark, sf):
    p = fx.points(spark, sf).withColumn("bright", F.col("r") > 40)
    return op.grid_sample(p, 0.5, means=("x", "y", "z", "r"), flags=("bright",), coords=True)


@case("D0b_grid_sample_last", f"""
WITH c AS (SELECT {VOX}, * EXCLUDE (scan_id), {fx.h('last', 'scan_id', 'point_id')} AS hh FROM points)
SELECT scan_id, vx, vy, vz, arg_max(point_id, row(hh, point_id)) AS point_id, arg_max(x, row(hh, point_id)) AS x,
 arg_max(label, row(hh, point_id)) AS label FROM c GROUP BY 1,2,3,4""", "points")
def grid_sample_last(spark, sf):
    p = fx.points(spark, sf).select("scan_id", "point_id", "x", "y", "z", "label")
    return op.grid_sample(p, 0.5, mode="last", seed="last", coords=True).drop("y", "z")


@case("D0c_quantize_coords", f"SELECT point_id, {VOX} FROM points", "points")
def quantize(spark, sf):
    return op.quantize(fx.points(spark, sf), 0.5).select("point_id", "scan_id", "vx", "vy", "vz")


@case("D0d_grid_pool", """SELECT scan_id, CAST(floor(x/0.75) AS BIGINT) AS vx, CAST(floor(y/0.75) AS BIGINT) AS vy,
 CAST(floor(z/0.75) AS BIGINT) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM points GROUP BY 1,2,3,4""", "points")
def grid_pool(spark, sf):
    return op.grid_pool(fx.points(spark, sf), 0.75)


@case("D0e_majority_vote", """SELECT scan_id, instance, arg_min(label, row(-n, label)) AS label
FROM (SELECT scan_id, instance, label, count(*) AS n FROM points GROUP BY ALL) GROUP BY 1,2""", "points")
def majority_vote(spark, sf):
    return majority(fx.points(spark, sf), ["scan_id", "instance"], "label")


CENTRES = """
WITH c AS (SELECT scan_id, CAST(round_even(x/2,0) AS BIGINT) AS vx, CAST(round_even(y/2,0) AS BIGINT) AS vy, x, y, label, point_id FROM points),
v AS (SELECT scan_id, vx, vy, arg_min(label, row(-n, label)) AS label FROM (SELECT scan_id, vx, vy, label, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1,2,3),
m AS (SELECT scan_id, vx, vy, avg(x) AS x, avg(y) AS y, max(point_id) AS point_id, count(*) AS n_points FROM c GROUP BY 1,2,3)"""


@case("D0f_window_centres", f"{CENTRES} SELECT m.*, v.label FROM m JOIN v USING (scan_id, vx, vy)", "points")
def window_centres(spark, sf):
    return op.sampling_centres(fx.points(spark, sf), 2.0)


@case("L6_label_counts", """SELECT scan_id, label, count(*) AS n, CAST(grouping(scan_id, label) AS INTEGER) AS level
FROM points GROUP BY ROLLUP (scan_id, label)""", "points")
def label_counts(spark, sf):
    return op.label_counts(fx.points(spark, sf), totals=True)
