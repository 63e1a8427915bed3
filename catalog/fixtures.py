"""Point, image and prediction tables derived from the given parquet tables.

Each table exists twice, as a DataFrame and as SQL text, built from md5 of the
row keys. Coordinates are multiples of 1/1024, so that sums and squared
distances are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointweave.functions.prefix import number_rows
from pointweave.functions.rand import key_hash

PX_W, PX_H = 256, 128


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def h(tag: str, *keys: str) -> str:
    """SQL text of key_hash."""
    parts = "||':'||".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x'||substr(md5('{tag}:'||{parts}),1,8) AS BIGINT)"


def u(tag: str, *keys: str) -> str:
    """SQL text of uniform."""
    return f"(CAST({h(tag, *keys)} AS DOUBLE)/CAST(4294967296 AS DOUBLE))"


def six(expr: str) -> str:
    """SQL text of six_digits."""
    return f"floor(({expr})*CAST(1e6 AS DOUBLE)+CAST(0.5 AS DOUBLE))/CAST(1e6 AS DOUBLE)"


def grid(tag: str, key: str, span: int) -> str:
    return f"CAST({h(tag, key)}%{span} AS DOUBLE)/1024"


def _grid(tag, key, span):
    return (key_hash(tag, key) % span).cast("double") / F.lit(1024.0)


TABLES: dict[str, tuple[str, str]] = {}


def _table(name: str, needs: str, sql: str):
    TABLES[name] = (needs, sql)


def with_tables(names, sql: str) -> str:
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for n in TABLES[name][0].split():
            visit(n)
        order.append(name)

    for n in names:
        visit(n)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in order)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {head},\n{rest[10:]}"
        return f"WITH {head},\n{rest}"
    return f"WITH {head}\n{body}"


# ------------------------------------------------------------------ points

_table("points", "", f"""
SELECT user_id%4 AS scan_id, event_id AS point_id,
 CASE event_id%6 WHEN 2 THEN CAST(0 AS DOUBLE) WHEN 3 THEN CAST(8 AS DOUBLE) ELSE {grid('x', 'event_id', 8192)} END AS x,
 CASE event_id%6 WHEN 4 THEN CAST(0 AS DOUBLE) WHEN 5 THEN CAST(6 AS DOUBLE) ELSE {grid('y', 'event_id', 6144)} END AS y,
 CASE event_id%6 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(3 AS DOUBLE) ELSE {grid('z', 'event_id', 3072)} END AS z,
 CAST({h('r', 'event_id')}%256 AS DOUBLE) AS r, CAST({h('g', 'event_id')}%256 AS DOUBLE) AS g,
 CAST({h('b', 'event_id')}%256 AS DOUBLE) AS b,
 CAST(event_id%6 AS INTEGER) AS label, user_id AS instance, ts AS sample_ts FROM events""")


def points(spark, sf):
    e = read(spark, sf, "events")
    k, f = F.col("event_id"), F.col("event_id") % 6
    side = lambda lo, hi, a, b, free: F.when(f == lo, F.lit(a)).when(f == hi, F.lit(b)).otherwise(free)
    return e.select(
        (F.col("user_id") % 4).alias("scan_id"), k.alias("point_id"),
        side(2, 3, 0.0, 8.0, _grid("x", k, 8192)).alias("x"),
        side(4, 5, 0.0, 6.0, _grid("y", k, 6144)).alias("y"),
        side(0, 1, 0.0, 3.0, _grid("z", k, 3072)).alias("z"),
        *[(key_hash(c, k) % 256).cast("double").alias(c) for c in "rgb"],
        f.cast("int").alias("label"), F.col("user_id").alias("instance"),
        F.col("ts").cast("timestamp").alias("sample_ts"))


# A full-volume cloud; a third of the rows crowd one corner, one row in fifty repeats a fixed place.
_table("cloud", "", f"""
WITH base AS (SELECT user_id%4 AS scan_id, event_id AS point_id, event_id%50=7 AS twin, event_id%3=0 AS crowd,
 {grid('x', 'event_id', 8192)} AS x0, {grid('y', 'event_id', 6144)} AS y0, {grid('z', 'event_id', 3072)} AS z0,
 user_id AS instance FROM events)
SELECT scan_id, point_id, CASE WHEN twin THEN CAST(1 AS DOUBLE) WHEN crowd THEN x0/16 ELSE x0 END AS x,
 CASE WHEN twin THEN CAST(2 AS DOUBLE) WHEN crowd THEN y0/16 ELSE y0 END AS y,
 CASE WHEN twin THEN CAST(1.5 AS DOUBLE) WHEN crowd THEN z0/16 ELSE z0 END AS z,
 CAST(point_id%5 AS INTEGER) AS label, instance FROM base""")


def cloud(spark, sf):
    k = F.col("event_id")
    twin, crowd = k % 50 == 7, k % 3 == 0
    pick = lambda fixed, free: F.when(twin, F.lit(fixed)).when(crowd, free / 16).otherwise(free)
    return read(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("scan_id"), k.alias("point_id"),
        pick(1.0, _grid("x", k, 8192)).alias("x"), pick(2.0, _grid("y", k, 6144)).alias("y"),
        pick(1.5, _grid("z", k, 3072)).alias("z"),
        (k % 5).cast("int").alias("label"), F.col("user_id").alias("instance"))


# ------------------------------------------------------------------ images

_table("images", "", f"""
WITH base AS (SELECT s_suppkey%4 AS scan_id, s_suppkey AS image_id,
 CASE s_suppkey%3 WHEN 0 THEN 'equirectangular' WHEN 1 THEN 'pinhole' ELSE 'fisheye' END AS camera,
 256 AS px_w, 128 AS px_h,
 CASE WHEN (s_suppkey//3)%3=2 THEN CAST(20 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + {grid('cx', 's_suppkey', 8192)} AS cx,
 {grid('cy', 's_suppkey', 6144)} AS cy, {grid('cz', 's_suppkey', 3072)} AS cz,
 CAST(0 AS DOUBLE) AS omega, CAST({h('phi', 's_suppkey')}%400 AS DOUBLE)/1024 AS phi,
 CAST({h('kappa', 's_suppkey')}%6283 AS DOUBLE)/1024 AS kappa FROM supplier)
SELECT *, cos(kappa) AS ck, sin(kappa) AS sk, CAST(80 AS DOUBLE) AS fx, CAST(80 AS DOUBLE) AS fy,
 CAST(128 AS DOUBLE) AS mx, CAST(64 AS DOUBLE) AS my, CAST(1.5 AS DOUBLE) AS xi, CAST(0.0625 AS DOUBLE) AS k1,
 CAST(0.015625 AS DOUBLE) AS k2, CAST(120 AS DOUBLE) AS gamma1, CAST(120 AS DOUBLE) AS gamma2,
 CAST(128 AS DOUBLE) AS u0, CAST(64 AS DOUBLE) AS v0 FROM base""")


def images(spark, sf):
    k = F.col("s_suppkey")
    d = lambda v: F.lit(float(v))
    base = read(spark, sf, "supplier").select(
        (k % 4).alias("scan_id"), k.alias("image_id"),
        F.when(k % 3 == 0, "equirectangular").when(k % 3 == 1, "pinhole").otherwise("fisheye").alias("camera"),
        F.lit(PX_W).alias("px_w"), F.lit(PX_H).alias("px_h"),
        (F.when(F.floor(k / 3) % 3 == 2, d(20)).otherwise(d(0)) + _grid("cx", k, 8192)).alias("cx"),
        _grid("cy", k, 6144).alias("cy"), _grid("cz", k, 3072).alias("cz"), d(0).alias("omega"),
        ((key_hash("phi", k) % 400).cast("double") / 1024).alias("phi"),
        ((key_hash("kappa", k) % 6283).cast("double") / 1024).alias("kappa"))
    ck, sk = F.cos("kappa"), F.sin("kappa")
    return base.select(
        "*",
        F.array(F.array(ck, -sk, d(0), F.col("cx")), F.array(sk, ck, d(0), F.col("cy")),
                F.array(d(0), d(0), d(1), F.col("cz")), F.array(d(0), d(0), d(0), d(1))).alias("pose"),
        d(80).alias("fx"), d(80).alias("fy"), d(128).alias("mx"), d(64).alias("my"), d(1.5).alias("xi"),
        d(0.0625).alias("k1"), d(0.015625).alias("k2"), d(120).alias("gamma1"), d(120).alias("gamma2"),
        d(128).alias("u0"), d(64).alias("v0"))


_table("image_pixels", "", f"""
SELECT image_id, px, py, CAST(CASE WHEN px=0 OR py=0 THEN 7 ELSE {h('pr', 'image_id', 'px', 'py')}%256 END AS DOUBLE) AS r,
 CAST(CASE WHEN px=0 OR py=0 THEN 7 ELSE {h('pg', 'image_id', 'px', 'py')}%256 END AS DOUBLE) AS g,
 CAST(CASE WHEN px=0 OR py=0 THEN 7 ELSE {h('pb', 'image_id', 'px', 'py')}%256 END AS DOUBLE) AS b
FROM (SELECT s_suppkey AS image_id, unnest(range(0,32)) AS px FROM supplier), range(0,16) t(py)""")


def image_pixels(spark, sf):
    k = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("image_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("px"))
    k = k.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("py"))
    edge = (F.col("px") == 0) | (F.col("py") == 0)
    return k.select("*", *[
        F.when(edge, 7).otherwise(key_hash(f"p{c}", "image_id", "px", "py") % 256).cast("double").alias(c) for c in "rgb"])


# A stored point-image-pixel table that does not depend on the projection: 32x16 images, a few pixels per view.
_table("maps", "points images", f"""
SELECT scan_id, image_id, point_id, (px0+dx)%32 AS px, py0 AS py,
 {grid('fd', 'pair', 1024)} AS depth, {grid('fh', 'pair', 1024)} AS height FROM (
 SELECT p.scan_id, i.image_id, p.point_id, CAST(p.point_id AS VARCHAR)||':'||CAST(i.image_id AS VARCHAR) AS pair,
  {h('vx', 'p.point_id', 'i.image_id')}%32 AS px0, {h('vy', 'p.point_id', 'i.image_id')}%16 AS py0
 FROM (SELECT DISTINCT scan_id, point_id, {h('see', 'point_id', 'd')}%n AS no FROM (SELECT p.scan_id, p.point_id, d, n FROM points p JOIN (SELECT scan_id, count(*) AS n FROM images WHERE cx<20 GROUP BY 1) USING (scan_id), range(0,4) s(d) WHERE p.point_id%7<>3)) p
 JOIN (SELECT scan_id, image_id, row_number() OVER (PARTITION BY scan_id ORDER BY image_id)-1 AS no FROM images WHERE cx<20) i ON p.scan_id=i.scan_id AND p.no=i.no), range(0,2) t(dx)""")


def maps(spark, sf):
    # Each point looks at up to four images of its scan, drawn by number: the table grows with the points.
    p = points(spark, sf).select("scan_id", "point_id").where("point_id % 7 <> 3")
    i = number_rows(images(spark, sf).where("cx < 20").select("scan_id", "image_id"), ["scan_id"], "image_id", "no")
    n = i.groupBy("scan_id").agg(F.max("no").alias("n"))
    four = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    v = p.join(n, "scan_id").withColumn("d", four).select("scan_id", "point_id", (key_hash("see", "point_id", "d") % F.col("n") + 1).alias("no")).distinct()
    v = v.join(i, ["scan_id", "no"])
    pair = F.concat_ws(":", F.col("point_id").cast("string"), F.col("image_id").cast("string"))
    v = v.select("scan_id", "image_id", "point_id",
                 (key_hash("vx", "point_id", "image_id") % 32).alias("px0"),
                 (key_hash("vy", "point_id", "image_id") % 16).alias("py"),
                 _grid("fd", pair, 1024).alias("depth"), _grid("fh", pair, 1024).alias("height"),
                 F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("dx"))
    return v.select("scan_id", "image_id", "point_id", ((F.col("px0") + F.col("dx")) % 32).alias("px"), "py", "depth", "height")


_table("views", "maps", """
SELECT scan_id, image_id, point_id, max(depth) AS depth, max(height) AS height FROM maps GROUP BY ALL""")


def views(spark, sf):
    return maps(spark, sf).groupBy("scan_id", "image_id", "point_id").agg(
        F.max("depth").alias("depth"), F.max("height").alias("height"))


_table("depth_maps", "", f"""
SELECT image_id, px, py, CASE WHEN {h('dn', 'image_id', 'px', 'py')}%50=0 THEN 65535
 ELSE {h('dm', 'image_id', 'px', 'py')}%4096 END AS raw
FROM (SELECT s_suppkey AS image_id, unnest(range(0,32)) AS px FROM supplier), range(0,16) t(py)""")


def depth_maps(spark, sf):
    return image_pixels(spark, sf).select(
        "image_id", "px", "py",
        F.when(key_hash("dn", "image_id", "px", "py") % 50 == 0, F.lit(65535).cast("long"))
        .otherwise(key_hash("dm", "image_id", "px", "py") % 4096).alias("raw"))


# ------------------------------------------------------------------ predictions

_table("preds", "points", f"""
WITH r AS (SELECT p.*, run FROM points p, range(0,3) t(run) WHERE p.point_id%4<>1),
d AS (SELECT *, 0 AS copy FROM r UNION ALL SELECT *, 1 AS copy FROM r WHERE {h('dup', 'point_id', 'run')}%50=0)
SELECT scan_id, run*100+CAST(floor(x/2) AS BIGINT) AS sample_id, point_id*2+copy AS row_id, point_id,
 CASE WHEN {h('ign', 'point_id')}%20=0 THEN -1 ELSE label END AS label, c AS class,
 CAST({h('sc', 'run', 'c', 'point_id', 'copy')}%1024 AS DOUBLE)/1024
  + CASE WHEN c=label AND {h('ok', 'point_id', 'run')}%10<7 THEN 1 ELSE 0 END AS score, sample_ts
FROM d, range(0,6) u(c)""")


def preds_long(spark, sf):
    """One row per (prediction row, class)."""
    p = points(spark, sf).where("point_id % 4 <> 1")
    r = p.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("run"))
    dup = key_hash("dup", "point_id", "run") % 50 == 0
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    d = r.select("*", F.explode(F.when(dup, F.array(zero, one)).otherwise(F.array(zero))).alias("copy"))
    return d, lambda c: (
        (key_hash("sc", "run", F.lit(c), "point_id", "copy") % 1024).cast("double") / 1024
        + F.when((F.col("label") == c) & (key_hash("ok", "point_id", "run") % 10 < 7), 1).otherwise(0))


def preds(spark, sf):
    d, score = preds_long(spark, sf)
    return d.select(
        "scan_id", (F.col("run") * 100 + F.floor(F.col("x") / 2)).alias("sample_id"),
        (F.col("point_id") * 2 + F.col("copy")).alias("row_id"), "point_id",
        F.when(key_hash("ign", "point_id") % 20 == 0, -1).otherwise(F.col("label")).alias("label"),
        F.array(*[score(c) for c in range(6)]).alias("scores"), "sample_ts")


# First prediction row by argmax, as SQL: (scan, sample, row, point, label, pred)
_table("pred_rows", "preds", """
SELECT scan_id, sample_id, row_id, point_id, label, arg_min(class, row(-score, class)) AS pred
FROM preds GROUP BY ALL""")
