"""Registration and depth fusion queries."""

import math

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.functions.rand import key_hash
from pointweave.operators import fusion as fu, registration as op

from . import fixtures as fx
from .registry import case

six, h = fx.six, fx.h

# Fragment f of a scan holds x in [1.5f, 1.5f+3), shifted by (f/4, -f/8, 0) in its own frame.
fx._table("frags", "points", """SELECT scan_id AS scene, f AS frag_id, point_id, x+f*CAST(0.25 AS DOUBLE) AS x, y-f*CAST(0.125 AS DOUBLE) AS y, z
 FROM points, range(0,4) t(f) WHERE x>=1.5*f AND x<1.5*f+3""")
fx._table("pairs", "", "SELECT s AS scene, f AS src, f+1 AS dst, s*10+f AS pair_id FROM range(0,4) a(s), range(0,3) b(f)")


def frags(spark, sf):
    p = fx.points(spark, sf).select("scan_id", "point_id", "x", "y", "z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("f"))
    p = p.where("x >= 1.5 * f AND x < 1.5 * f + 3")
    return p.select(F.col("scan_id").alias("scene"), F.col("f").alias("frag_id"), "point_id", (F.col("x") + F.col("f") * 0.25).alias("x"), (F.col("y") - F.col("f") * 0.125).alias("y"), "z")


def _shift(dx, dy):
    rows = [(1.0, 0.0, 0.0, dx), (0.0, 1.0, 0.0, dy), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)]
    return F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])


def pairs(spark, sf, sign=1):
    s = fx.points(spark, sf).select(F.col("scan_id").alias("scene")).distinct().select("scene", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("src"))
    return s.select("scene", "src", (F.col("src") + 1).alias("dst"), (F.col("scene") * 10 + F.col("src")).alias("pair_id"), _shift(0.25 * sign, -0.125 * sign).alias("pose"))


MM = """sq AS (SELECT pair_id, point_id AS query_id, x+0.25 AS x, y-0.125 AS y, z FROM frags JOIN pairs ON pairs.scene=frags.scene AND src=frag_id),
dq AS (SELECT pair_id, point_id, x, y, z FROM frags JOIN pairs ON pairs.scene=frags.scene AND dst=frag_id),
cm AS (SELECT s.pair_id, query_id, d.point_id, (s.x-d.x)*(s.x-d.x)+(s.y-d.y)*(s.y-d.y)+(s.z-d.z)*(s.z-d.z) AS d2 FROM sq s JOIN dq d ON s.pair_id=d.pair_id),
mm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, query_id ORDER BY d2, point_id) AS rk FROM cm WHERE d2<=0.0625) WHERE rk<=2)"""


@case("O1_overlap_matches", f"WITH {MM} SELECT pair_id, query_id, point_id, d2 FROM mm", "frags pairs")
def overlap_matches(spark, sf):
    return op.overlap_matches(pairs(spark, sf), frags(spark, sf), 0.25, 2)[0]


OVER = f"""{MM}, ov AS (SELECT pair_id, (SELECT count(DISTINCT query_id) FROM mm WHERE mm.pair_id=n.pair_id)/n AS overlap FROM (SELECT pair_id, count(*) AS n FROM sq GROUP BY 1) n),
ob AS (SELECT pair_id, (SELECT count(DISTINCT point_id) FROM cm WHERE d2<=0.0625 AND cm.pair_id=n.pair_id)/n AS overlap_back FROM (SELECT pair_id, count(*) AS n FROM dq GROUP BY 1) n)"""


@case("O1_overlap", f"WITH {OVER} SELECT pair_id, {six('overlap')} AS overlap, {six('overlap_back')} AS overlap_back FROM ov JOIN ob USING (pair_id)", "frags pairs")
def overlap(spark, sf):
    o = op.overlap_matches(pairs(spark, sf), frags(spark, sf), 0.25, 1, both=True)[1]
    return o.select("pair_id", six_digits("overlap").alias("overlap"), six_digits("overlap_back").alias("overlap_back"))


@case("O2_subsampled_matches", f"""WITH {MM}, sm AS (SELECT pair_id, max(query_id) AS query_id FROM sq GROUP BY pair_id, round_even(x/0.5,0), round_even(y/0.5,0), round_even(z/0.5,0))
SELECT pair_id, query_id, point_id, d2 FROM mm SEMI JOIN sm USING (pair_id, query_id)""", "frags pairs")
def subsampled(spark, sf):
    return op.subsampled_matches(pairs(spark, sf), frags(spark, sf), 0.5, 0.25, 2)


POS = f"fr AS (SELECT p_partkey//16 AS seq, p_partkey%16 AS frame, CAST({h('px', 'p_partkey')}%8192 AS DOUBLE)/1024 AS x, CAST({h('py', 'p_partkey')}%8192 AS DOUBLE)/1024 AS y, CAST(0 AS DOUBLE) AS z FROM part)"


@case("O3_candidate_pairs", f"""WITH {POS}, j AS (SELECT a.seq, a.frame AS i, b.frame AS j, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM fr a JOIN fr b ON a.seq=b.seq AND b.frame>a.frame)
SELECT 'window' AS how, seq, i, j FROM j WHERE j-i<4 UNION ALL SELECT 'distance', seq, i, min(j) FROM j WHERE d2>9 AND j-i<100 GROUP BY seq, i UNION ALL SELECT 'all', seq, i, j FROM j""")
def candidate_pairs(spark, sf):
    k = F.col("p_partkey")
    c = lambda t: (key_hash(t, k) % 8192).cast("double") / 1024
    f = fx.read(spark, sf, "part").select(F.floor(k / 16).alias("seq"), (k % 16).alias("frame"), c("px").alias("x"), c("py").alias("y"), F.lit(0.0).alias("z"))
    a = op.frame_pairs(f, "window", 4).withColumn("how", F.lit("window"))
    b = op.frame_pairs(f, "distance", 100, 3.0).withColumn("how", F.lit("distance"))
    return a.unionByName(b).unionByName(op.frame_pairs(f, "window", 16).withColumn("how", F.lit("all")))


@case("O4_filter_overlap", f"WITH {OVER} SELECT pair_id FROM ov JOIN ob USING (pair_id) WHERE greatest(overlap, overlap_back)>0.3 AND greatest(overlap, overlap_back)<0.52", "frags pairs")
def filter_overlap(spark, sf):
    o = op.overlap_matches(pairs(spark, sf), frags(spark, sf), 0.25, 1, both=True)[1]
    return op.filter_overlap(o, 0.3, 0.52).select("pair_id")


@case("O5_pairs_with_truth", f"WITH {MM} SELECT pair_id, query_id, point_id, d2 FROM mm WHERE rk=1", "frags pairs")
def pairs_with_truth(spark, sf):
    return op.benchmark_matches(pairs(spark, sf, -1), frags(spark, sf), 0.25)[0]


@case("O6_track_matches", f"WITH {MM} SELECT pair_id, query_id*3 AS src_point, point_id*5 AS dst_point FROM mm WHERE rk=1 AND query_id%2=0 AND point_id%3<>0", "frags pairs")
def track(spark, sf):
    s, d = op._sides(pairs(spark, sf), frags(spark, sf))
    m = op.ball_join(s, d, 0.25, 1, ["pair_id"])
    a = s.where("query_id % 2 = 0").select("pair_id", F.col("query_id").alias("old_id"), (F.col("query_id") * 3).alias("new_id"))
    b = d.where("point_id % 3 <> 0").select("pair_id", F.col("point_id").alias("old_id"), (F.col("point_id") * 5).alias("new_id"))
    return op.track_matches(m, a, b)


@case("O7_limit_matches", f"""WITH {MM} SELECT pair_id, query_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY {h('lim', 'pair_id', 'query_id', 'point_id')}, query_id, point_id) AS q FROM mm WHERE rk=1) WHERE q<=50""", "frags pairs")
def limit(spark, sf):
    m = op.overlap_matches(pairs(spark, sf), frags(spark, sf), 0.25, 1)[0]
    return op.limit_matches(m, 50, "lim").select("pair_id", "query_id", "point_id")


@case("O8_self_pairs")
def self_pairs(spark, sf):
    """A fragment that no draw can serve is a row of nulls."""
    matches, served = op.self_pairs(frags(spark, sf), 2.0, 0.1, (0.5, 1.0), "self")
    return matches.unionByName(served.where("draw IS NULL"), allowMissingColumns=True)


@case("O9_join_pairs", f"""WITH {MM} SELECT mm.pair_id, mm.query_id, mm.point_id, s.x AS sx, d.x AS tx, s.z AS sz FROM mm JOIN sq s ON s.pair_id=mm.pair_id AND s.query_id=mm.query_id JOIN dq d ON d.pair_id=mm.pair_id AND d.point_id=mm.point_id WHERE rk=1""", "frags pairs")
def join_pairs(spark, sf):
    s, d = op._sides(pairs(spark, sf), frags(spark, sf))
    m = op.ball_join(s, d, 0.25, 1, ["pair_id"])
    t = op.pair_table(m, s.withColumnRenamed("query_id", "point_id"), d, ["x", "y", "z"])
    return t.select("pair_id", "query_id", "point_id", F.col("src.x").alias("sx"), F.col("dst.x").alias("tx"), F.col("src.z").alias("sz"))


def _vec(a, b):
    return f"list_sum(list_transform(range(1,65), lambda i: (CAST({a}[i] AS DOUBLE)-CAST({b}[i] AS DOUBLE))*(CAST({a}[i] AS DOUBLE)-CAST({b}[i] AS DOUBLE))))"


EMB = f"""c AS MATERIALIZED (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {_vec('a.embedding', 'b.embedding')} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id%2=0 AND b.vec_id%2=1),
f AS (SELECT a_id, arg_min(b_id, row(d2, b_id)) AS b_id FROM c GROUP BY 1), g AS (SELECT b_id, arg_min(a_id, row(d2, a_id)) AS a_id FROM c GROUP BY 1)"""


def emb(spark, sf, cond):
    return fx.read(spark, sf, "embeddings").where(cond).select(F.lit(0).alias("pair_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("feat"), "label")


@case("O10_feature_matches", f"WITH {EMB} SELECT f.a_id, f.b_id FROM f SEMI JOIN g ON g.a_id=f.a_id AND g.b_id=f.b_id")
def feature_matches(spark, sf):
    return op.feature_matches(emb(spark, sf, "vec_id % 2 = 0"), emb(spark, sf, "vec_id % 2 = 1"), mutual=True).select("a_id", "b_id")


@case("O11_descriptor_accuracy", f"""WITH m AS (SELECT vec_id, list_transform(range(1,65), lambda i: CAST(embedding[i] AS DOUBLE)+CASE WHEN vec_id%3=0 THEN CAST(embedding[65-i] AS DOUBLE)*2 ELSE 0 END) AS v FROM embeddings),
n AS (SELECT m.vec_id AS a, arg_min(b.vec_id, row({_vec('m.v', 'b.embedding')}, b.vec_id)) AS b FROM m, embeddings b GROUP BY 1)
SELECT {six('100*avg(CASE WHEN a=b THEN 1 ELSE 0 END)')} AS accuracy FROM n""")
def descriptor_accuracy(spark, sf):
    e = emb(spark, sf, "true").withColumn("feat", F.col("feat").cast("array<double>"))
    mixed = F.when(F.col("id") % 3 == 0, F.zip_with("feat", F.reverse("feat"), lambda a, b: a + b * 2)).otherwise(F.col("feat"))
    return op.descriptor_accuracy(e.withColumn("feat", mixed), e).select(six_digits("accuracy").alias("accuracy"))


def known_matches(spark, sf, clean=False):
    """Points of a scan and their places after a known turn and shift per scan, one in twenty wrong unless clean."""
    p = fx.points(spark, sf)
    t = F.col("scan_id") * 0.1 + 0.05
    wrong = F.when((key_hash("wrong", "point_id") % 20 == 0) & F.lit(not clean), F.lit(3.0)).otherwise(F.lit(0.0))
    return p.select(F.col("scan_id").alias("pair_id"), *[F.col(a).alias(f"s{a}") for a in "xyz"],
                    (F.cos(t) * F.col("x") - F.sin(t) * F.col("y") + 0.5 + wrong).alias("tx"), (F.sin(t) * F.col("x") + F.cos(t) * F.col("y") - 0.25).alias("ty"), (F.col("z") + 0.125).alias("tz"))


def known_pose():
    t = F.col("pair_id") * 0.1 + 0.05
    z, o = F.lit(0.0), F.lit(1.0)
    return F.array(F.array(F.cos(t), -F.sin(t), z, F.lit(0.5)), F.array(F.sin(t), F.cos(t), z, F.lit(-0.25)), F.array(z, z, o, F.lit(0.125)), F.array(z, z, z, o))


COS, SIN = "cos(scan_id*CAST(0.1 AS DOUBLE)+CAST(0.05 AS DOUBLE))", "sin(scan_id*CAST(0.1 AS DOUBLE)+CAST(0.05 AS DOUBLE))"
KNOWN = "SELECT scan_id AS pair_id, " + ", ".join(f"{six(e)} AS m{i}{j}" for i, row in enumerate(((COS, f"-{SIN}", "0", "0.5"), (SIN, COS, "0", "-0.25"), ("0", "0", "1", "0.125"))) for j, e in enumerate(row)) + " FROM points GROUP BY scan_id"


@case("O12_fit_rigid_clean", KNOWN, "points")
def fit_rigid_clean(spark, sf):
    p = op.fit_rigid(known_matches(spark, sf, clean=True))
    return p.select("pair_id", *[six_digits(F.col("pose")[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(4)])


@case("O13_fit_robust_clean", KNOWN, "points")
def fit_robust_clean(spark, sf):
    p = op.fit_robust(known_matches(spark, sf, clean=True))
    return p.select("pair_id", *[six_digits(F.col("pose")[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(4)])


@case("O12_fit_rigid")
def fit_rigid(spark, sf):
    p = op.fit_rigid(known_matches(spark, sf))
    return p.select("pair_id", *[F.col("pose")[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(4)])


@case("O13_fit_robust")
def fit_robust(spark, sf):
    p = op.fit_robust(known_matches(spark, sf))
    return p.select("pair_id", *[F.col("pose")[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(4)])


ERR = f"""k AS (SELECT scan_id AS pair_id, x, y, z, cos(scan_id*0.1+0.05) AS c, sin(scan_id*0.1+0.05) AS s, CASE WHEN {h('wrong', 'point_id')}%20=0 THEN 3 ELSE 0 END AS w FROM points),
mid AS (SELECT pair_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM k GROUP BY 1),
e AS (SELECT k.pair_id, avg(CASE WHEN w<0.1 THEN 1 ELSE 0 END) AS hit_ratio, avg(sqrt((x+0.5-(c*x-s*y+0.5+w))*(x+0.5-(c*x-s*y+0.5+w))+(y-0.25-(s*x+c*y-0.25))*(y-0.25-(s*x+c*y-0.25))+0.015625))<0.6 AS recalled,
 avg(sqrt((x+0.5-(c*x-s*y+0.5))*(x+0.5-(c*x-s*y+0.5))+(y-0.25-(s*x+c*y-0.25))*(y-0.25-(s*x+c*y-0.25))+0.015625)/(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))+1e-12)) AS sr_err,
 max(degrees(acos(greatest(-1, least(1, (c+c+1-1)*0.5))))) AS rot_error, CAST(0.125 AS DOUBLE) AS trans_error FROM k JOIN mid ON mid.pair_id=k.pair_id GROUP BY 1)"""


def errors(spark, sf):
    m = known_matches(spark, sf)
    est = _shift(0.5, -0.25)
    poses = m.select("pair_id").distinct().select("pair_id", known_pose().alias("pose_gt"), est.alias("pose"))
    pts = m.select("pair_id", *[F.col(f"s{a}").alias(a) for a in "xyz"])
    return op.pair_errors(m, pts, poses, 0.1, 0.6)


@case("O14_pair_errors", f"WITH {ERR} SELECT pair_id, {six('hit_ratio')} AS hit_ratio, recalled, {six('sr_err')} AS sr_err, {six('rot_error')} AS rot_error, {six('trans_error')} AS trans_error FROM e", "points")
def pair_errors(spark, sf):
    e = errors(spark, sf)
    return e.select("pair_id", "recalled", *[six_digits(c).alias(c) for c in ("hit_ratio", "sr_err", "rot_error", "trans_error")])


@case("O15_registration_report", f"""WITH {ERR} SELECT {six('avg(hit_ratio)')} AS hit_ratio, {six('avg(CASE WHEN hit_ratio>0.05 THEN 1 ELSE 0 END)')} AS feat_match_ratio, {six('avg(trans_error)')} AS trans_error,
 {six('avg(rot_error)')} AS rot_error, {six('avg(CASE WHEN rot_error<5 THEN 1 ELSE 0 END)')} AS rre, {six('avg(CASE WHEN trans_error<0.3 THEN 1 ELSE 0 END)')} AS rte, {six('avg(sr_err)')} AS sr_err, {six('avg(CASE WHEN recalled THEN 1 ELSE 0 END)')} AS recall FROM e""", "points")
def registration_report(spark, sf):
    r = op.registration_report(errors(spark, sf))
    return r.select(*[six_digits(c).alias(c) for c in r.columns])


# ------------------------------------------------------------------ depth frames

fx._table("frames", "", f"""SELECT *, cos(a) AS ca, sin(a) AS sa FROM (SELECT p_partkey//16 AS seq, p_partkey%16 AS frame, p_partkey, CAST({h('pa', 'p_partkey')}%64 AS DOUBLE)/1024 AS a,
 CAST({h('tx', 'p_partkey')}%256 AS DOUBLE)/1024 AS tx, CAST({h('ty', 'p_partkey')}%256 AS DOUBLE)/1024 AS ty FROM part)""")
fx._table("depth", "", f"""SELECT seq, frame, u, v, CASE WHEN {h('dz', 'p_partkey', 'u', 'v')}%20=0 THEN 0 ELSE 512+{h('dm', 'p_partkey', 'u', 'v')}%4096 END AS mm FROM (SELECT p_partkey, p_partkey//16 AS seq, p_partkey%16 AS frame, unnest(range(0,16)) AS u FROM part), range(0,12) t(v)""")


def frames(spark, sf):
    k = F.col("p_partkey")
    a = (key_hash("pa", k) % 64).cast("double") / 1024
    z, o = F.lit(0.0), F.lit(1.0)
    g = lambda t: (key_hash(t, k) % 256).cast("double") / 1024
    pose = F.array(F.array(F.cos(a), -F.sin(a), z, g("tx")), F.array(F.sin(a), F.cos(a), z, g("ty")), F.array(z, z, o, z), F.array(z, z, z, o))
    return fx.read(spark, sf, "part").select(F.floor(k / 16).alias("seq"), (k % 16).alias("frame"), k, *[F.lit(float(v)).alias(c) for c, v in (("fx", 16), ("fy", 16), ("cx", 8), ("cy", 6))], pose.alias("pose"))


def depth(spark, sf):
    k = F.col("p_partkey")
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # A few rows of a small file become many here: dealt out first, so that not one task makes them all.
    p = fx.read(spark, sf, "part").select(k).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k)
    d = p.select(k, F.floor(k / 16).alias("seq"), (k % 16).alias("frame"), seq(16).alias("u"))
    d = d.withColumn("v", seq(12))
    return d.select("seq", "frame", "u", "v", F.when(key_hash("dz", k, "u", "v") % 20 == 0, 0).otherwise(512 + key_hash("dm", k, "u", "v") % 4096).alias("mm"))


P1 = "pt AS (SELECT d.seq, d.frame, u, v, (u+0.5-8)*(mm/1000)/16 AS x0, (v+0.5-6)*(mm/1000)/16 AS y0, mm/1000 AS z, ca, sa, tx, ty FROM depth d JOIN frames f ON f.seq=d.seq AND f.frame=d.frame WHERE mm>0 AND mm<4000)"


@case("P1_depth_to_points", f"WITH {P1} SELECT seq, frame, u, v, {six('ca*x0-sa*y0+tx')} AS x, {six('sa*x0+ca*y0+ty')} AS y, {six('z')} AS z FROM pt", "frames depth")
def depth_to_points(spark, sf):
    p = fu.depth_to_points(depth(spark, sf), frames(spark, sf), 4.0)
    return p.select("seq", "frame", "u", "v", *[six_digits(a).alias(a) for a in "xyz"])


@case("P2_fragments", "SELECT seq, frame, frame//4 AS fragment FROM frames QUALIFY count(*) OVER (PARTITION BY seq, frame//4)=4", "frames")
def fragments(spark, sf):
    return fu.frame_fragments(frames(spark, sf), 4)


FRUS = """mx AS (SELECT seq, frame, max(CASE WHEN mm>4000 THEN 0 ELSE mm END)/1000 AS d FROM depth GROUP BY 1,2),
co AS (SELECT * FROM (VALUES (0,0,0,0),(1,0,0,1),(2,0,12,1),(3,16,0,1),(4,16,12,1)) t(corner,u,v,s)),
fr AS (SELECT f.seq, f.frame, corner, (u-8)*(d*s)/16 AS x0, (v-6)*(d*s)/16 AS y0, d*s AS z, ca, sa, tx, ty FROM frames f JOIN mx ON mx.seq=f.seq AND mx.frame=f.frame, co),
fw AS (SELECT seq, frame, corner, ca*x0-sa*y0+tx AS x, sa*x0+ca*y0+ty AS y, z FROM fr)"""


@case("P3_view_frustum", f"WITH {FRUS} SELECT seq, frame, corner, {six('x')} AS x, {six('y')} AS y, {six('z')} AS z FROM fw", "frames depth")
def view_frustum(spark, sf):
    f = fu.view_frustum(depth(spark, sf), frames(spark, sf), 16, 12, 4.0)
    return f.select("seq", "frame", "corner", *[six_digits(a).alias(a) for a in "xyz"])


def _trim(a, limit=12, voxel="CAST(0.25 AS DOUBLE)"):
    size = f"(h{a}-l{a})/{voxel}"
    return f"CASE WHEN {size}>{limit} THEN ({size}-{limit})*{voxel}*0.5 ELSE 0 END"


BND = f"""{FRUS}, fm AS (SELECT seq, frame//4 AS fragment, frame, {', '.join(f'min({a}) AS l{a}, max({a}) AS h{a}' for a in 'xyz')} FROM fw GROUP BY 1,2,3),
q AS (SELECT seq, fragment, {', '.join(f'quantile_cont(l{a}, 0.1) AS l{a}, quantile_cont(h{a}, 0.9) AS h{a}' for a in 'xyz')} FROM fm GROUP BY 1,2 HAVING count(*)=4),
bd AS (SELECT seq, fragment, {', '.join(f'l{a}+{_trim(a)} AS lo_{a}, h{a}-{_trim(a)} AS hi_{a}' for a in 'xyz')} FROM q)"""


def bounds(spark, sf):
    f, d = frames(spark, sf), depth(spark, sf)
    frusta = fu.view_frustum(d, f, 16, 12, 4.0).join(fu.frame_fragments(f, 4), ["seq", "frame"])
    return fu.volume_bounds(frusta, 0.25, 12)


@case("P4_volume_bounds", f"WITH {BND} SELECT seq, fragment, {six('lo_x')} AS lo_x, {six('hi_x')} AS hi_x, {six('lo_y')} AS lo_y, {six('hi_z')} AS hi_z FROM bd", "frames depth")
def volume_bounds(spark, sf):
    return bounds(spark, sf).select("seq", "fragment", *[six_digits(c).alias(c) for c in ("lo_x", "hi_x", "lo_y", "hi_z")])


# A volume with a fixed origin per fragment keeps the pixel rounding away from ties.
TS = """vx AS (SELECT seq, fragment, i, j, k, CAST(-1.53 AS DOUBLE)+i*CAST(0.25 AS DOUBLE) AS x, CAST(-1.07 AS DOUBLE)+j*CAST(0.25 AS DOUBLE) AS y, CAST(0.61 AS DOUBLE)+k*CAST(0.25 AS DOUBLE) AS z FROM (SELECT seq, frame//4 AS fragment FROM frames GROUP BY 1,2 HAVING count(*)=4), range(0,12) a(i), range(0,8) b(j), range(0,10) c(k)),
cm AS (SELECT v.*, f.frame, ca*(x-tx)+sa*(y-ty) AS x0, -sa*(x-tx)+ca*(y-ty) AS y0 FROM vx v JOIN frames f ON f.seq=v.seq AND f.frame//4=v.fragment),
px AS (SELECT *, CAST(round_even(x0*16/z+8,0) AS BIGINT) AS u, CAST(round_even(y0*16/z+6,0) AS BIGINT) AS w FROM cm),
ts AS (SELECT px.seq, fragment, i, j, k, avg(least(1, (mm/1000-z)/1.25)) AS tsdf, count(*) AS w FROM px JOIN depth d ON d.seq=px.seq AND d.frame=px.frame AND d.u=px.u AND d.v=px.w WHERE mm>0 AND mm/1000-z>=-1.25 GROUP BY 1,2,3,4,5)"""


def volume(spark, sf):
    f = frames(spark, sf)
    groups = fu.frame_fragments(f, 4)
    vols = groups.select("seq", "fragment").distinct().select("*", *[F.lit(v).alias(f"lo_{a}") for a, v in zip("xyz", (-1.53, -1.07, 0.61))], *[F.lit(v).cast("long").alias(f"n_{a}") for a, v in zip("xyz", (12, 8, 10))])
    return fu.tsdf(vols, f.join(groups, ["seq", "frame"]), depth(spark, sf), 0.25, 16, 12), vols


@case("P5_tsdf", f"WITH {TS} SELECT seq, fragment, i, j, k, {six('tsdf')} AS tsdf, w FROM ts", "frames depth")
def tsdf(spark, sf):
    return volume(spark, sf)[0].withColumn("tsdf", six_digits("tsdf"))


@case("P6_surface_points", f"WITH {TS} SELECT seq, fragment, i, j, k, {six('i*0.25-1.53')} AS x, {six('k*0.25+0.61')} AS z FROM ts WHERE floor(abs(tsdf)*1e9+0.5)<200000000 AND w>2", "frames depth")
def surface(spark, sf):
    v, vols = volume(spark, sf)
    return fu.surface_points(v, vols, 0.25, 0.2, 2).select("seq", "fragment", "i", "j", "k", six_digits("x").alias("x"), six_digits("z").alias("z"))


# No trimming here: a trimmed edge is a whole number of voxels up to the last bit, and its ceiling a toss-up.
FUSED = f"""{BND.replace(BND[BND.index('bd AS ('):], 'bd AS (SELECT seq, fragment, ' + ', '.join(f'l{a} AS lo_{a}, h{a} AS hi_{a}' for a in 'xyz') + ' FROM q)')}, vo AS (SELECT seq, fragment, lo_x, lo_y, lo_z, {', '.join(f'CAST(ceil((hi_{a}-lo_{a})/CAST(0.25 AS DOUBLE)) AS BIGINT) AS n_{a}' for a in 'xyz')} FROM bd),
vx AS (SELECT *, lo_x+i*CAST(0.25 AS DOUBLE) AS x, lo_y+j*CAST(0.25 AS DOUBLE) AS y, lo_z+k*CAST(0.25 AS DOUBLE) AS z FROM (SELECT *, unnest(range(0, n_z)) AS k FROM (SELECT *, unnest(range(0, n_y)) AS j FROM (SELECT *, unnest(range(0, n_x)) AS i FROM vo)))),
cm AS (SELECT v.*, f.frame, ca*(x-tx)+sa*(y-ty) AS x0, -sa*(x-tx)+ca*(y-ty) AS y0 FROM vx v JOIN frames f ON f.seq=v.seq AND f.frame//4=v.fragment WHERE z>0),
px AS (SELECT *, CAST(round_even(x0*16/z+8,0) AS BIGINT) AS u, CAST(round_even(y0*16/z+6,0) AS BIGINT) AS w FROM cm),
ts AS (SELECT px.seq, fragment, i, j, k, max(x) AS x, max(z) AS z, avg(least(1, (mm/1000-z)/1.25)) AS tsdf, count(*) AS w FROM px JOIN depth d ON d.seq=px.seq AND d.frame=px.frame AND d.u=px.u AND d.v=px.w WHERE mm>0 AND mm<=4000 AND mm/1000-z>=-1.25 GROUP BY 1,2,3,4,5)"""


@case("P7_build_fragments", f"WITH {FUSED} SELECT seq, fragment, i, j, k, {six('x')} AS x, {six('z')} AS z FROM ts WHERE floor(abs(tsdf)*1e9+0.5)<200000000 AND w>2", "frames depth")
def build_fragments(spark, sf):
    out = fu.fuse_frames(frames(spark, sf), depth(spark, sf), 4, 0.25, 16, 12, 4.0, 600, 0.2)
    return out.select("seq", "fragment", "i", "j", "k", six_digits("x").alias("x"), six_digits("z").alias("z"))
