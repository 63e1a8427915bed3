"""Box, instance and detection queries."""

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.functions.rand import key_hash
from pointweave.operators import boxes as op, instances as ins, metrics, neighbours

from . import fixtures as fx
from .registry import case

six, h = fx.six, fx.h


def _g(tag, key, m, add):
    return f"CAST({h(tag, key)}%{m} AS DOUBLE)/1024+{add}"


fx._table("box_truth", "", f"""SELECT c_custkey%20 AS scan_id, c_custkey AS box_id, CAST({h('bc', 'c_custkey')}%4 AS INTEGER) AS class,
 {_g('bx', 'c_custkey', 8192, 0)} AS cx, {_g('by', 'c_custkey', 6144, 0)} AS cy, {_g('bz', 'c_custkey', 3072, 0)} AS cz,
 {_g('bw', 'c_custkey', 1024, 0.5)} AS dx, {_g('bd', 'c_custkey', 1024, 0.5)} AS dy, {_g('bh', 'c_custkey', 1024, 0.5)} AS dz FROM customer""")
fx._table("box_pred", "box_truth", f"""SELECT * EXCLUDE (fake), CAST({h('bs', 'box_id')}%1024 AS DOUBLE)/1024 AS score FROM (
 SELECT scan_id, box_id*2 AS box_id, class, cx+{_g('mx', 'box_id', 205, 0)} AS cx, cy+{_g('my', 'box_id', 205, 0)} AS cy, cz AS cz, dx, dy, dz, 0 AS fake FROM box_truth
 UNION ALL SELECT scan_id, box_id*2+1, class, {_g('fx', 'box_id', 8192, 0)}, cy, cz, dx, dy, dz, 1 FROM box_truth WHERE box_id%3=0)""")


def box_truth(spark, sf):
    k = F.col("c_custkey")
    d = lambda t, m, a, n: ((key_hash(t, k) % m).cast("double") / 1024 + a).alias(n)
    return fx.read(spark, sf, "customer").select(
        (k % 20).alias("scan_id"), k.alias("box_id"), (key_hash("bc", k) % 4).cast("int").alias("class"),
        d("bx", 8192, 0, "cx"), d("by", 6144, 0, "cy"), d("bz", 3072, 0, "cz"), d("bw", 1024, 0.5, "dx"), d("bd", 1024, 0.5, "dy"), d("bh", 1024, 0.5, "dz"))


def box_pred(spark, sf):
    t = box_truth(spark, sf)
    g = lambda tag, m: (key_hash(tag, "box_id") % m).cast("double") / 1024
    moved = t.withColumns({"cx": F.col("cx") + g("mx", 205), "cy": F.col("cy") + g("my", 205), "box_id": F.col("box_id") * 2})
    fake = t.where("box_id % 3 = 0").withColumns({"cx": g("fx", 8192), "box_id": F.col("box_id") * 2 + 1})
    return moved.unionByName(fake).withColumn("score", (key_hash("bs", "box_id") % 1024).cast("double") / 1024)


CORNERS = "(VALUES (0,-1,-1,-1),(1,1,-1,-1),(2,1,1,-1),(3,-1,1,-1),(4,-1,-1,1),(5,1,-1,1),(6,1,1,1),(7,-1,1,1)) s(corner, sx, sy, sz)"


@case("N1_box_corners", f"SELECT box_id, CAST(corner AS BIGINT) AS corner, {six('cos(score)*sx*dx/2-sin(score)*sy*dy/2+cx')} AS x, {six('sin(score)*sx*dx/2+cos(score)*sy*dy/2+cy')} AS y, {six('sz*dz/2+cz')} AS z FROM box_pred, {CORNERS}", "box_pred")
def box_corners(spark, sf):
    b = op.box_corners(box_pred(spark, sf), "score").select("box_id", F.posexplode("corners").alias("corner", "c"))
    return b.select("box_id", F.col("corner").cast("long").alias("corner"), *[six_digits(f"c.{a}").alias(a) for a in "xyz"])


def _side(a):
    return f"(least(a.c{a}+a.d{a}/2, b.c{a}+b.d{a}/2)-greatest(a.c{a}-a.d{a}/2, b.c{a}-b.d{a}/2))"


IOU = f"""ov AS (SELECT a.scan_id, a.class, a.box_id AS a_box_id, b.box_id AS b_box_id, {_side('x')}*{_side('y')}*{_side('z')} AS i, a.dx*a.dy*a.dz+b.dx*b.dy*b.dz AS s, a.class=b.class AS same
 FROM box_pred a JOIN box_truth b ON a.scan_id=b.scan_id WHERE {_side('x')}>0 AND {_side('y')}>0 AND {_side('z')}>0)"""


@case("N2_box_iou_aligned", f"WITH {IOU} SELECT scan_id, a_box_id, b_box_id, {six('i/(s-i)')} AS iou FROM ov", "box_pred box_truth")
def box_iou(spark, sf):
    return op.box_iou(box_pred(spark, sf), box_truth(spark, sf)).withColumn("iou", six_digits("iou"))


@case("N3_box_iou_rotated", f"WITH {IOU} SELECT scan_id, a_box_id, b_box_id, {six('i/(s-i)')} AS iou FROM ov", "box_pred box_truth")
def box_iou_rotated(spark, sf):
    zero = lambda d: d.withColumn("heading", F.lit(0.0))
    return op.box_iou(zero(box_pred(spark, sf)), zero(box_truth(spark, sf)), rotated=True).withColumn("iou", six_digits("iou"))


@case("N3_box_iou_rotated_headings")
def box_iou_turned(spark, sf):
    turn = lambda d, t: d.withColumn("heading", (key_hash(t, "box_id") % 6283).cast("double") / 1000)
    return op.box_iou(turn(box_pred(spark, sf), "ha"), turn(box_truth(spark, sf), "hb"), rotated=True)


def greedy(rows: str, edges: str, keys: str) -> str:
    """SQL that keeps rows one by one: a row goes when a kept one of smaller rank is among its edges (rank, list `over`)."""
    return f"""gr AS MATERIALIZED (SELECT r.*, coalesce(e.over, []) AS over FROM {rows} r LEFT JOIN {edges} e USING ({keys}, rk)),
rec AS (SELECT {keys}, rk, [rk] AS kept FROM gr WHERE rk=1 UNION ALL
 SELECT {', '.join(f'gr.{k}' for k in keys.split(', '))}, gr.rk, CASE WHEN list_has_any(rec.kept, gr.over) THEN rec.kept ELSE list_append(rec.kept, gr.rk) END
 FROM rec JOIN gr ON {' AND '.join(f'gr.{k}=rec.{k}' for k in keys.split(', '))} AND gr.rk=rec.rk+1),
kept AS (SELECT gr.* FROM gr JOIN (SELECT {keys}, arg_max(kept, rk) AS kept FROM rec GROUP BY ALL) USING ({keys}) WHERE list_contains(kept, gr.rk))"""


@case("N4_box_nms", f"""WITH RECURSIVE bx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id, class ORDER BY score DESC, box_id) AS rk FROM box_pred),
ov AS (SELECT b.scan_id, b.class, b.rk, list(a.rk) AS over FROM bx a JOIN bx b ON a.scan_id=b.scan_id AND a.class=b.class AND a.rk<b.rk
 WHERE {_side('x')}>0 AND {_side('y')}>0 AND {_side('z')}>0 AND {_side('x')}*{_side('y')}*{_side('z')}/(a.dx*a.dy*a.dz+b.dx*b.dy*b.dz-{_side('x')}*{_side('y')}*{_side('z')})>CAST(0.1 AS DOUBLE) GROUP BY 1,2,3),
{greedy('bx', 'ov', 'scan_id, class')} SELECT scan_id, box_id, class, score FROM kept""", "box_pred")
def box_nms(spark, sf):
    return op.box_nms(box_pred(spark, sf), 0.1).select("scan_id", "box_id", "class", "score")


PROP = f"""pp AS (SELECT o_orderkey, CAST({h('o0', 'o_orderkey')}%64 AS DOUBLE)/16 AS o0, CAST({h('o1', 'o_orderkey')}%64 AS DOUBLE)/16 AS o1, {h('z0', 'o_orderkey')}%64 AS z0, {h('z1', 'o_orderkey')}%64 AS z1, {h('z2', 'o_orderkey')}%64 AS z2,
 CAST({h('rs', 'o_orderkey')}%64 AS DOUBLE)/64 AS rs, {h('k0', 'o_orderkey')}%64 AS k0, {h('k1', 'o_orderkey')}%64 AS k1 FROM orders),
 pq AS (SELECT *, CASE WHEN z0>=z1 AND z0>=z2 THEN 0 WHEN z1>=z2 THEN 1 ELSE 2 END AS sc, exp(o1-greatest(o0,o1))/(exp(o0-greatest(o0,o1))+exp(o1-greatest(o0,o1))) AS score FROM pp)"""


@case("N5_decode_boxes", f"WITH {PROP} SELECT o_orderkey, CASE WHEN k0>=k1 THEN 0 ELSE 1 END AS class, {six('score')} AS score, ([CAST(1 AS DOUBLE),2,3])[sc+1]+rs*(sc+1) AS dx, ([CAST(3 AS DOUBLE),2,1])[sc+1]+rs*(sc+1) AS dz FROM pq WHERE score>0.5")
def decode(spark, sf):
    g = lambda t: (key_hash(t, "o_orderkey") % 64).cast("double")
    rs = g("rs") / 64
    o = fx.read(spark, sf, "orders").select(
        "o_orderkey", *[F.lit(0.0).alias(f"c{a}") for a in "xyz"], F.array(F.lit(1.0)).alias("heading_scores"), F.array(F.lit(0.0)).alias("heading_residuals"),
        F.array(g("z0"), g("z1"), g("z2")).alias("size_scores"), F.array(*[F.array(rs * i, rs * i, rs * i) for i in (1, 2, 3)]).alias("size_residuals"),
        F.array(g("o0") / 16, g("o1") / 16).alias("objectness"), F.array(g("k0"), g("k1")).alias("class_scores"))
    return op.decode_boxes(o, [(1, 2, 3), (2, 2, 2), (3, 2, 1)], 0.5).select("o_orderkey", "class", six_digits("score").alias("score"), "dx", "dz")


ASSIGN = f"""nn AS (SELECT a.scan_id, a.box_id, a.score, arg_min(b.box_id, row((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz), b.box_id)) AS object_id,
 sqrt(min((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))+CAST(1e-6 AS DOUBLE)) AS dist FROM box_pred a JOIN box_truth b ON a.scan_id=b.scan_id GROUP BY 1,2,3),
 asg AS (SELECT *, CASE WHEN dist<0.1 THEN 1 ELSE 0 END AS objectness, CASE WHEN dist<0.1 OR dist>0.2 THEN 1 ELSE 0 END AS mask FROM nn)"""


@case("N6_assign_objects", f"WITH {ASSIGN} SELECT scan_id, box_id, object_id, {six('dist')} AS dist, objectness, mask FROM asg", "box_pred box_truth")
def assign(spark, sf):
    return op.assign_objects(box_pred(spark, sf), box_truth(spark, sf), 0.1, 0.2).withColumn("dist", six_digits("dist"))


@case("N7_proposal_stats", f"""WITH {ASSIGN}, b AS (SELECT scan_id, avg(objectness) AS p, avg(CASE WHEN mask=1 AND objectness=0 THEN 1 ELSE 0 END) AS n,
 sum(CASE WHEN mask=1 AND objectness=CASE WHEN score>0.5 THEN 1 ELSE 0 END THEN 1 ELSE 0 END)/(sum(mask)+CAST(1e-6 AS DOUBLE)) AS a FROM asg GROUP BY 1)
SELECT {six('avg(p)')} AS pos_ratio, {six('avg(n)')} AS neg_ratio, {six('avg(a)')} AS obj_acc FROM b""", "box_pred box_truth")
def proposal_stats(spark, sf):
    p = box_pred(spark, sf)
    a = op.assign_objects(p, box_truth(spark, sf), 0.1, 0.2).join(p.select("scan_id", "box_id", (F.col("score") > 0.5).cast("int").alias("pred")), ["scan_id", "box_id"])
    s = op.proposal_stats(a)
    return s.select(*[six_digits(c).alias(c) for c in s.columns])


MATCH = f"""{IOU}, bb AS (SELECT scan_id, class, a_box_id, max(i/(s-i)) AS iou, arg_max(b_box_id, row(i/(s-i), -b_box_id)) AS gt FROM ov WHERE same GROUP BY 1,2,3),
rk AS (SELECT bb.*, score, row_number() OVER (PARTITION BY bb.class, bb.scan_id, gt ORDER BY score DESC, a_box_id) AS rk FROM bb JOIN box_pred p ON p.box_id=a_box_id WHERE iou>0.25),
mt AS (SELECT p.scan_id, p.class, p.box_id AS pred_id, p.score, CASE WHEN rk=1 THEN 1 ELSE 0 END AS tp FROM box_pred p LEFT JOIN rk ON rk.a_box_id=p.box_id)"""


@case("N8_match_detections", f"WITH {MATCH} SELECT * FROM mt", "box_pred box_truth")
def match(spark, sf):
    keys = ["class", "scan_id"]
    pairs = op.box_iou(box_pred(spark, sf), box_truth(spark, sf), keys, best=True).withColumnsRenamed({"a_box_id": "pred_id", "b_box_id": "gt_id"})
    p = box_pred(spark, sf).select(*keys, F.col("box_id").alias("pred_id"), "score")
    return op.match_detections(p, pairs, 0.25)


@case("N9_detection_ap", f"""WITH {MATCH}, cu AS (SELECT *, sum(tp) OVER w AS ctp, count(*) OVER w AS cn FROM mt WINDOW w AS (PARTITION BY class ORDER BY score DESC, pred_id ROWS UNBOUNDED PRECEDING)),
en AS (SELECT *, max(ctp/cn) OVER (PARTITION BY class ORDER BY score DESC, pred_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu)
SELECT class, {six('sum(env) FILTER (tp=1)/(SELECT count(*) FROM box_truth t WHERE t.class=en.class)')} AS ap, CAST(0.25 AS DOUBLE) AS threshold FROM en GROUP BY 1""", "box_pred box_truth")
def detection_ap(spark, sf):
    return op.box_ap_at(box_pred(spark, sf), box_truth(spark, sf), [0.25]).withColumn("ap", six_digits("ap"))


# ------------------------------------------------------------------ instances

fx._table("cluster_points", "points", f"""SELECT scan_id, instance*2+CASE WHEN instance%8=0 THEN point_id%2 ELSE 0 END AS cluster, point_id FROM points WHERE {h('lost', 'point_id')}%10<>0
 UNION ALL SELECT scan_id, instance*2+1, point_id FROM points WHERE instance%8=3 AND point_id%4<>0""")


def cluster_points(spark, sf):
    p = fx.points(spark, sf)
    a = p.where(key_hash("lost", "point_id") % 10 != 0).select("scan_id", (F.col("instance") * 2 + F.when(F.col("instance") % 8 == 0, F.col("point_id") % 2).otherwise(0)).alias("cluster"), "point_id")
    return a.union(p.where("instance % 8 = 3 AND point_id % 4 <> 0").select("scan_id", F.col("instance") * 2 + 1, "point_id"))


def clusters(spark, sf):
    c = cluster_points(spark, sf).select("scan_id", "cluster").distinct()
    return c.select("*", (F.col("cluster") % 5).cast("int").alias("class"), ((key_hash("cs", "scan_id", "cluster") % 1024).cast("double") / 1024).alias("score"))


INS = """cl AS (SELECT scan_id, cluster, count(*) AS nc FROM cluster_points GROUP BY 1,2), tr AS (SELECT scan_id, instance, count(*) AS nt FROM points GROUP BY 1,2),
io AS (SELECT scan_id, cluster, instance, i/(nc+nt-i) AS iou FROM (SELECT c.scan_id, cluster, instance, count(*) AS i FROM cluster_points c JOIN points p ON p.scan_id=c.scan_id AND p.point_id=c.point_id GROUP BY 1,2,3)
 JOIN cl USING (scan_id, cluster) JOIN tr USING (scan_id, instance))"""


@case("N10_instance_iou", f"WITH {INS} SELECT scan_id, cluster, instance, {six('iou')} AS iou FROM io", "points cluster_points")
def instance_iou(spark, sf):
    return ins.instance_iou(cluster_points(spark, sf), fx.points(spark, sf)).withColumn("iou", six_digits("iou"))


@case("N11_cluster_nms", f"""WITH RECURSIVE cl AS MATERIALIZED (SELECT scan_id, cluster, CAST(cluster%5 AS INTEGER) AS class, CAST({h('cs', 'scan_id', 'cluster')}%1024 AS DOUBLE)/1024 AS score, count(*) AS n_points FROM cluster_points GROUP BY 1,2,3,4),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, cluster) AS rk FROM cl),
io AS (SELECT a.scan_id, a.cluster AS a, b.cluster AS b, count(*) AS i FROM cluster_points a JOIN cluster_points b ON a.scan_id=b.scan_id AND a.point_id=b.point_id AND a.cluster<>b.cluster GROUP BY 1,2,3),
ov AS (SELECT b.scan_id, b.rk, list(a.rk) AS over FROM io JOIN rk a ON a.scan_id=io.scan_id AND a.cluster=io.a JOIN rk b ON b.scan_id=io.scan_id AND b.cluster=io.b WHERE a.rk<b.rk AND i/(a.n_points+b.n_points-i)>CAST(0.3 AS DOUBLE) GROUP BY 1,2),
{greedy('rk', 'ov', 'scan_id')} SELECT scan_id, cluster, class, score, n_points FROM kept WHERE n_points>=5 AND score>CAST(0.1 AS DOUBLE)""", "cluster_points")
def cluster_nms(spark, sf):
    return ins.cluster_nms(clusters(spark, sf), cluster_points(spark, sf), 0.3, 5, 0.1)


@case("N12_grow_regions", """WITH RECURSIVE e AS MATERIALIZED (SELECT q.point_id AS a, s.point_id AS b FROM points q JOIN points s ON q.scan_id=s.scan_id AND q.label=s.label
 WHERE q.label NOT IN (0, 1) AND (q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z)<=0.0225),
c AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a=c.b)
SELECT scan_id, p.point_id, label, r.region FROM points p JOIN (SELECT a, min(b) AS region FROM c GROUP BY 1) r ON r.a=p.point_id""", "points")
def grow_regions(spark, sf):
    return ins.grow_regions(fx.points(spark, sf), 0.15, (0, 1))


@case("N13_score_clusters", f"""WITH one AS (SELECT p.scan_id, p.point_id, class, max(score) AS score FROM preds p GROUP BY 1,2,3),
m AS (SELECT c.scan_id, cluster, class, avg(score) AS s FROM cluster_points c JOIN one o ON o.scan_id=c.scan_id AND o.point_id=c.point_id GROUP BY 1,2,3)
SELECT scan_id, cluster, {six('max(s)')} AS score FROM m GROUP BY 1,2""", "preds cluster_points")
def score_clusters(spark, sf):
    p = fx.preds(spark, sf)
    best = p.groupBy("scan_id", "point_id").agg(F.array(*[F.max(F.col("scores")[i]) for i in range(6)]).alias("scores"))
    return ins.score_clusters(cluster_points(spark, sf), best).withColumn("score", six_digits("score"))


@case("N14_panoptic_stats", f"""WITH {INS}, b AS (SELECT scan_id, cluster, max(iou) AS iou, arg_max(instance, row(iou, -instance)) AS instance FROM io GROUP BY 1,2),
lb AS (SELECT scan_id, cluster, arg_min(label, row(-n, label)) AS pc FROM (SELECT c.scan_id, cluster, label, count(*) AS n FROM cluster_points c JOIN points p ON p.scan_id=c.scan_id AND p.point_id=c.point_id GROUP BY 1,2,3) GROUP BY 1,2),
f AS (SELECT scan_id, instance, arg_min(label, point_id) AS tc FROM points GROUP BY 1,2), n AS (SELECT scan_id, count(*) AS n FROM f GROUP BY 1),
k AS (SELECT scan_id, CASE WHEN iou>=0.5 AND pc=tc THEN 1 ELSE 0 END AS ok FROM b JOIN lb USING (scan_id, cluster) JOIN f USING (scan_id, instance))
SELECT scan_id, {six('avg(ok)')} AS acc, {six('sum(ok)/max(n)')} AS pos, {six('(count(*)-sum(ok))/max(n)')} AS neg FROM k JOIN n USING (scan_id) GROUP BY 1""", "points cluster_points")
def panoptic_stats(spark, sf):
    s = ins.panoptic_stats(cluster_points(spark, sf), fx.points(spark, sf), 0.5)
    return s.select("scan_id", *[six_digits(c).alias(c) for c in ("acc", "pos", "neg")])


@case("N15_instance_tables", f"""SELECT 'pred' AS part, c.scan_id, cluster AS id, CAST(cluster%5 AS INTEGER) AS class, CAST({h('cs', 'c.scan_id', 'cluster')}%1024 AS DOUBLE)/1024 AS score, point_id FROM cluster_points c
UNION ALL SELECT 'truth', scan_id, instance, arg_min(label, point_id) OVER (PARTITION BY scan_id, instance), 1, point_id FROM points""", "points cluster_points")
def instance_tables(spark, sf):
    p, t = ins.instance_tables(cluster_points(spark, sf), clusters(spark, sf), fx.points(spark, sf))
    p = p.select(F.lit("pred").alias("part"), "scan_id", F.col("cluster").alias("id"), "class", "score", "point_id")
    return p.union(t.select(F.lit("truth"), "scan_id", "instance", "class", F.lit(1.0), "point_id"))


@case("N16_offset_errors", f"""SELECT scan_id, {six('avg(abs(x-1)+abs(y-2)+abs(z-1))')} AS norm_loss, {six('avg(-(x+y*2+z)/((sqrt(x*x+y*y+z*z)+CAST(1e-8 AS DOUBLE))*(sqrt(CAST(6 AS DOUBLE))+CAST(1e-8 AS DOUBLE))))')} AS dir_loss FROM points GROUP BY 1""", "points")
def offset_errors(spark, sf):
    p = fx.points(spark, sf).withColumns({"px": F.col("x"), "py": F.col("y"), "pz": F.col("z"), "tx": F.lit(1.0), "ty": F.lit(2.0), "tz": F.lit(1.0)})
    return ins.offset_errors(p).select("scan_id", six_digits("norm_loss").alias("norm_loss"), six_digits("dir_loss").alias("dir_loss"))
