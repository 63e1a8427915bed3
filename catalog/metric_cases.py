"""Balance, sampling plan, metric and voting queries."""

from pyspark.sql import functions as F

from pointweave.functions.maths import six_digits
from pointweave.functions.rand import key_hash
from pointweave.operators import balance as ba, metrics as op, voxel

from . import fixtures as fx
from .registry import case
from .voxel_cases import CENTRES

six, h, u = fx.six, fx.h, fx.u
E8 = "CAST(1e-8 AS DOUBLE)"


@case("L1_class_weights", f"""WITH n AS (SELECT c, coalesce(n, 1) AS n FROM range(0,7) t(c) LEFT JOIN (SELECT label, count(*) AS n FROM points GROUP BY 1) ON label=c),
w AS (SELECT c, avg(n) OVER ()/n AS w FROM n), s AS (SELECT c, sqrt(w) AS a, ln(1.1+w/sum(w) OVER ()) AS b FROM w)
SELECT CAST(c AS INTEGER) AS label, {six('a/sum(a) OVER ()')} AS weight, {six('b/sum(b) OVER ()')} AS log_weight FROM s""", "points")
def class_weights(spark, sf):
    p = fx.points(spark, sf)
    a = ba.class_weights(p, 7).withColumn("weight", six_digits("weight"))
    return a.join(ba.class_weights(p, 7, "log").select("label", six_digits("weight").alias("log_weight")), "label")


@case("L2_balance_probabilities", f"""{CENTRES}, n AS (SELECT label, count(*) AS n FROM m JOIN v USING (scan_id, vx, vy) GROUP BY 1)
SELECT label, n, {six('sqrt(avg(n) OVER ()/n)/sum(sqrt(k/n)) OVER ()')} AS p FROM (SELECT *, avg(n) OVER () AS k FROM n)""", "points")
def balance(spark, sf):
    return ba.balance_probabilities(voxel.sampling_centres(fx.points(spark, sf), 2.0)).withColumn("p", six_digits("p"))


def _draws(seed, classes):
    """Draws: a class by cumulative probability, a row number in it."""
    return f"""c AS (SELECT label, n, sum(p) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS c FROM ({classes})),
dr AS (SELECT d, {u(seed + '/class', 'd')} AS uc, {u(seed + '/row', 'd')} AS ur FROM range(0,2000) t(d)),
k AS (SELECT d, ur, coalesce(min(label) FILTER (c>uc), max(label)) AS label FROM dr, c GROUP BY 1,2),
q AS (SELECT d AS draw, k.label, CAST(floor(ur*n) AS BIGINT)+1 AS rn FROM k JOIN c ON c.label=k.label)"""


@case("L3_draw_balanced", f"""WITH n AS (SELECT label, count(*) AS n FROM points GROUP BY 1), w AS (SELECT label, n, sqrt(avg(n) OVER ()/n) AS w FROM n),
{_draws('draw', 'SELECT label, n, w/sum(w) OVER () AS p FROM w')}, r AS (SELECT label, point_id, row_number() OVER (PARTITION BY label ORDER BY point_id) AS rn FROM points)
SELECT draw, q.label, point_id FROM q JOIN r ON r.label=q.label AND r.rn=q.rn""", "points")
def draw_balanced(spark, sf):
    return ba.draw_balanced(fx.points(spark, sf), 2000, "draw", "point_id")


@case("L4_draw_label_window", f"""WITH n AS (SELECT label, count(*) AS n FROM points GROUP BY 1),
{_draws('window', 'SELECT label, n, CAST(1 AS DOUBLE)/count(*) OVER () AS p FROM n')}, r AS (SELECT label, scan_id, point_id, row_number() OVER (PARTITION BY label ORDER BY scan_id, point_id) AS rn FROM points)
SELECT draw, q.label, scan_id AS window_id, point_id FROM q JOIN r ON r.label=q.label AND r.rn=q.rn""", "points")
def draw_label_window(spark, sf):
    return ba.draw_label_window(fx.points(spark, sf).withColumnRenamed("scan_id", "window_id"), 2000, "window", row_id="point_id")


@case("L5_sampling_plan", f"""WITH d AS (SELECT o_custkey%40 AS window_id, o_orderkey AS draw, (row_number() OVER (PARTITION BY o_custkey%40 ORDER BY o_orderkey)-1) AS rn FROM orders)
SELECT window_id, draw, rn//16 AS run, row_number() OVER (ORDER BY {h('plan', 'window_id', 'rn//16')}, window_id, rn)-1 AS position FROM d""")
def sampling_plan(spark, sf):
    d = fx.read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("window_id"), F.col("o_orderkey").alias("draw"))
    return ba.sampling_plan(d, 16, "plan")


# ------------------------------------------------------------------ metrics

CONF = "conf AS (SELECT label AS truth, pred, count(*) AS n FROM pred_rows WHERE label<>-1 GROUP BY 1,2)"
CLS = f"""{CONF}, cls AS (SELECT c AS class, coalesce((SELECT sum(n) FROM conf WHERE truth=c AND pred=c), 0) AS tp, coalesce((SELECT sum(n) FROM conf WHERE truth=c), 0) AS t,
 coalesce((SELECT sum(n) FROM conf WHERE pred=c), 0) AS p FROM range(0,8) r(c))"""


def conf(spark, sf):
    return op.confusion(fx.preds(spark, sf))


@case("M1_confusion", f"WITH {CONF} SELECT truth, CAST(pred AS INTEGER) AS pred, n FROM conf", "pred_rows")
def confusion(spark, sf):
    return conf(spark, sf)


@case("M2_iou_scores", f"WITH {CLS} SELECT CAST(class AS INTEGER) AS class, {six(f'{E8}+tp/(t+p-tp+{E8})')} AS iou, t+p-tp>0 AS present FROM cls", "pred_rows")
def iou_scores(spark, sf):
    return op.iou(conf(spark, sf), 8).withColumn("iou", six_digits("iou"))


@case("M2_mean_iou", f"WITH {CLS} SELECT {six(f'avg({E8}+tp/(t+p-tp+{E8})) FILTER (t+p-tp>0)')} AS miou, {six(f'avg(CASE WHEN t+p-tp>0 THEN {E8}+tp/(t+p-tp+{E8}) ELSE 1 END)')} AS filled FROM cls", "pred_rows")
def mean_iou(spark, sf):
    per = op.iou(conf(spark, sf), 8)
    return op.mean_iou(per).withColumn("filled", op.mean_iou(per, True).scalar()).select(six_digits("miou").alias("miou"), six_digits("filled").alias("filled"))


@case("M3_accuracies", f"WITH {CLS} SELECT {six('sum(tp)/sum(t)')} AS acc, {six('avg(tp/t) FILTER (t>0)')} AS macc FROM cls", "pred_rows")
def accuracies(spark, sf):
    return op.accuracies(conf(spark, sf), 8).select(six_digits("acc").alias("acc"), six_digits("macc").alias("macc"))


@case("M4_normalised_matrix", f"WITH {CONF} SELECT truth, CAST(pred AS INTEGER) AS pred, n, {six('n/sum(n) OVER (PARTITION BY truth)')} AS recall, {six('n/sum(n) OVER (PARTITION BY pred)')} AS prec FROM conf", "pred_rows")
def normalised(spark, sf):
    c = conf(spark, sf)
    both = op.normalise_confusion(c, "truth").withColumnRenamed("share", "recall").join(
        op.normalise_confusion(c, "pred").select("truth", "pred", F.col("share").alias("prec")), ["truth", "pred"])
    return both.withColumns({"recall": six_digits("recall"), "prec": six_digits("prec")})


@case("M5_image_iou", f"""WITH r AS (SELECT * FROM pred_rows WHERE label<>-1), k AS (SELECT DISTINCT sample_id FROM r),
c AS (SELECT k.sample_id, c AS class, count(*) FILTER (label=c AND pred=c) AS i, count(*) FILTER (label=c OR pred=c) AS un FROM k JOIN r USING (sample_id), range(0,7) t(c) GROUP BY 1,2)
SELECT CAST(class AS INTEGER) AS class, {six('avg(CASE WHEN un>0 THEN i/un ELSE 1 END*100)')} AS iou_percent FROM c GROUP BY 1""", "pred_rows")
def image_iou(spark, sf):
    p = fx.preds(spark, sf).withColumn("pred", op.argmax("scores"))
    return op.iou_percent(p, 7, per_image=True, image="sample_id").withColumn("iou_percent", six_digits("iou_percent"))


@case("M6_lovasz_score", f"""WITH e AS (SELECT scan_id, class, row_id, CASE WHEN class=label THEN 1 ELSE 0 END AS hit, abs(CASE WHEN class=label THEN 1 ELSE 0 END-score/2) AS err FROM preds WHERE label<>-1),
s AS (SELECT *, sum(hit) OVER w AS ch, count(*) OVER w AS cn, sum(hit) OVER (PARTITION BY scan_id, class) AS g FROM e WINDOW w AS (PARTITION BY scan_id, class ORDER BY err DESC, row_id ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, 1-(g-ch)/CAST(g+(cn-ch) AS DOUBLE) AS jac, 1-(g-(ch-hit))/CAST(g+((cn-1)-(ch-hit)) AS DOUBLE) AS prev FROM s WHERE g>0),
c AS (SELECT scan_id, class, sum(err*(jac-prev)) AS loss FROM j GROUP BY 1,2) SELECT scan_id, {six('avg(loss)')} AS lovasz FROM c GROUP BY 1""", "preds")
def lovasz(spark, sf):
    p = fx.preds(spark, sf).withColumn("scores", F.transform("scores", lambda s: s / 2))
    return op.lovasz_softmax(p, 6).withColumn("lovasz", six_digits("lovasz"))


VOTE = """one AS (SELECT scan_id, sample_id, point_id, max(row_id) AS row_id FROM preds GROUP BY 1,2,3),
vt AS (SELECT p.scan_id, p.point_id, class, sum(score) AS s, count(*) AS n FROM preds p JOIN one o ON o.scan_id=p.scan_id AND o.sample_id=p.sample_id AND o.point_id=p.point_id AND o.row_id=p.row_id GROUP BY 1,2,3),
vp AS (SELECT scan_id, point_id, arg_min(class, row(-s, class)) AS pred, max(n) AS n_votes FROM vt GROUP BY 1,2)"""


def votes(spark, sf):
    return op.vote(fx.preds(spark, sf), 6)


@case("M7_vote", f"WITH {VOTE} SELECT scan_id, point_id, n AS n_votes, class, s AS score FROM vt", "preds")
def vote(spark, sf):
    v = votes(spark, sf).select("scan_id", "point_id", "n_votes", F.posexplode("scores").alias("class", "score"))
    return v.withColumn("class", F.col("class").cast("long"))


@case("M8_coverage", f"WITH {VOTE} SELECT p.scan_id, {six('count(v.point_id)/count(*)')} AS coverage, CAST(sum(n_votes) AS BIGINT) AS n_votes FROM points p LEFT JOIN vp v ON v.scan_id=p.scan_id AND v.point_id=p.point_id GROUP BY 1", "points preds")
def coverage(spark, sf):
    return op.coverage(fx.points(spark, sf), votes(spark, sf)).withColumn("coverage", six_digits("coverage"))


FULL = f"""{VOTE}, un AS (SELECT * FROM points p ANTI JOIN vp v ON v.scan_id=p.scan_id AND v.point_id=p.point_id),
vq AS (SELECT v.scan_id, v.point_id, v.pred, x, y, z FROM vp v JOIN points p ON v.scan_id=p.scan_id AND v.point_id=p.point_id),
full_res AS (SELECT scan_id, point_id, pred FROM vp UNION ALL SELECT q.scan_id, q.point_id, arg_min(s.pred, row((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)+(q.z-s.z)*(q.z-s.z), s.point_id)) FROM un q JOIN vq s ON s.scan_id=q.scan_id GROUP BY 1,2)"""


@case("M9_full_resolution", f"WITH {FULL} SELECT scan_id, point_id, CAST(pred AS INTEGER) AS pred FROM full_res", "points preds")
def full_resolution(spark, sf):
    return op.full_resolution(fx.points(spark, sf), votes(spark, sf))


@case("M10_vote_metrics", f"""WITH {FULL}, c AS (SELECT 'sample' AS level, label AS truth, pred FROM pred_rows WHERE label<>-1 UNION ALL SELECT 'voted', label, pred FROM vp JOIN points USING (scan_id, point_id)
 UNION ALL SELECT 'full', label, pred FROM full_res JOIN points USING (scan_id, point_id)),
i AS (SELECT level, cl AS class, count(*) FILTER (truth=cl AND pred=cl) AS tp, count(*) FILTER (truth=cl OR pred=cl) AS un FROM c, range(0,6) t(cl) GROUP BY 1,2)
SELECT level, CAST(class AS INTEGER) AS class, {six(f'{E8}+tp/(un+{E8})')} AS iou, un>0 AS present, 'class '||class AS name FROM i""", "points preds pred_rows")
def report(spark, sf):
    return op.segmentation_report(fx.points(spark, sf), fx.preds(spark, sf), [f"class {i}" for i in range(6)]).withColumn("iou", six_digits("iou"))


# Parts per test category.
PARTS = {0: [0, 1, 2, 3], 1: [4, 5], 2: [6, 7], 3: [8, 9, 10, 11]}
SHAPES = f"""sh AS (SELECT o_custkey AS shape_id, o_custkey%4 AS category, o_orderkey, CASE o_custkey%4 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 8 END AS base, CASE WHEN o_custkey%4 IN (0,3) THEN 4 ELSE 2 END AS np FROM orders),
s2 AS (SELECT shape_id, category, base, np, base+{h('pt', 'o_orderkey')}%np AS truth, base+{h('pp', 'o_orderkey')}%np AS pred FROM sh),
pi AS (SELECT shape_id, category, part, CASE WHEN count(*) FILTER (truth=part OR pred=part)>0 THEN count(*) FILTER (truth=part AND pred=part)/count(*) FILTER (truth=part OR pred=part) ELSE 1 END AS v
 FROM (SELECT *, unnest(range(base, base+np)) AS part FROM s2) GROUP BY 1,2,3), ps AS (SELECT shape_id, category, avg(v) AS iou FROM pi GROUP BY 1,2)"""


def shape_iou(spark, sf):
    o = fx.read(spark, sf, "orders")
    cat = F.col("o_custkey") % 4
    base = F.when(cat == 0, 0).when(cat == 1, 4).when(cat == 2, 6).otherwise(8)
    n = F.when(cat.isin(0, 3), 4).otherwise(2)
    s = o.select(F.col("o_custkey").alias("shape_id"), cat.cast("int").alias("category"), (base + key_hash("pt", "o_orderkey") % n).alias("truth"), (base + key_hash("pp", "o_orderkey") % n).alias("pred"))
    return op.part_iou(s, PARTS)


@case("M11_part_iou", f"WITH {SHAPES} SELECT shape_id, CAST(category AS INTEGER) AS category, {six('iou')} AS iou FROM ps")
def part_iou(spark, sf):
    return shape_iou(spark, sf).withColumn("iou", six_digits("iou"))


@case("M11_part_iou_summary", f"WITH {SHAPES} SELECT {six('avg(iou)')} AS instance_miou, {six('(SELECT avg(m) FROM (SELECT avg(iou) AS m FROM ps GROUP BY category))')} AS class_miou FROM ps")
def part_summary(spark, sf):
    return op.part_iou_summary(shape_iou(spark, sf)).select(six_digits("instance_miou").alias("instance_miou"), six_digits("class_miou").alias("class_miou"))


@case("M12_classification_accuracy", f"SELECT {six('avg(a)')} AS acc FROM (SELECT sample_id, 100*avg(CASE WHEN label=pred THEN 1 ELSE 0 END) AS a FROM pred_rows GROUP BY 1)", "pred_rows")
def accuracy(spark, sf):
    p = fx.preds(spark, sf).withColumn("pred", op.argmax("scores"))
    return op.batch_accuracy(p, "sample_id", "label").select(six_digits("acc").alias("acc"))


BIN = f"""b AS (SELECT doc_id AS row_id, 'quality' AS class, CAST({h('qs', 'doc_id')}%1024 AS DOUBLE)/1024 AS score, quality AS truth, {h('w', 'doc_id')}%4+1 AS weight FROM labels
 UNION ALL SELECT doc_id, 'toxic', CAST({h('ts', 'doc_id')}%64 AS DOUBLE)/64, toxic, {h('w', 'doc_id')}%4+1 FROM labels)"""


def binary(spark, sf):
    l = fx.read(spark, sf, "labels")
    one = lambda c, t, m: l.select(F.col("doc_id").alias("row_id"), F.lit(c).alias("class"), ((key_hash(t, "doc_id") % m).cast("double") / m).alias("score"), F.col(c).alias("truth"), (key_hash("w", "doc_id") % 4 + 1).alias("weight"))
    return one("quality", "qs", 1024).union(one("toxic", "ts", 64))


@case("M13_average_precision", f"""WITH {BIN}, r AS (SELECT *, sum(truth) OVER w/count(*) OVER w AS p, sum(truth*weight) OVER w/sum(weight) OVER w AS pw FROM b WINDOW w AS (PARTITION BY class ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING))
SELECT class, {six('coalesce(sum(p) FILTER (truth>0), 0)/greatest(sum(truth), 1)')} AS ap, {six('coalesce(sum(pw) FILTER (truth>0), 0)/greatest(sum(truth), 1)')} AS weighted FROM r GROUP BY 1""")
def average_precision(spark, sf):
    b = binary(spark, sf)
    return op.average_precision(b).withColumn("ap", six_digits("ap")).join(op.average_precision(b, weight="weight").select("class", six_digits("ap").alias("weighted")), "class")


LOG = "log AS (SELECT user_id%5 AS run, CASE event_id%2 WHEN 0 THEN 'train' ELSE 'val' END AS stage, CAST(floor(epoch(ts)/86400) AS BIGINT) AS epoch, CASE event_type WHEN 'error' THEN 'loss' WHEN 'view' THEN 'miou' ELSE event_type END AS name, value FROM events)"


def log(spark, sf):
    e = fx.read(spark, sf, "events")
    return e.select((F.col("user_id") % 5).alias("run"), F.when(F.col("event_id") % 2 == 0, "train").otherwise("val").alias("stage"),
                    F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("epoch"),
                    F.when(F.col("event_type") == "error", "loss").when(F.col("event_type") == "view", "miou").otherwise(F.col("event_type")).alias("name"), "value")


@case("M14_mean_meter", f"WITH {LOG} SELECT stage, name, {six('avg(value)')} AS mean, count(*) AS n FROM log GROUP BY 1,2")
def mean_meter(spark, sf):
    return op.mean_meter(log(spark, sf)).withColumn("mean", six_digits("mean"))


@case("M15_running_stats", f"WITH {LOG}, w AS (SELECT run, epoch, name, round_even(value*100, 0) AS v FROM log) SELECT run, epoch, name, count(*) AS n, {six('avg(v)')} AS mean, {six('coalesce(var_samp(v), 0)')} AS variance FROM w GROUP BY 1,2,3")
def running_stats(spark, sf):
    cents = log(spark, sf).withColumn("value", F.rint(F.col("value") * 100))
    return op.running_stats(cents, ("run", "epoch", "name")).select("run", "epoch", "name", "n", six_digits("mean").alias("mean"), six_digits("variance").alias("variance"))


BEST = f"""{LOG}, a AS (SELECT run, stage, epoch, name, max(value) AS value FROM log GROUP BY ALL),
b AS (SELECT *, CASE WHEN name='loss' THEN min(value) OVER w ELSE max(value) OVER w END AS best, CASE WHEN name='loss' THEN min(value) OVER q ELSE max(value) OVER q END AS prev FROM a
 WINDOW w AS (PARTITION BY run, stage, name ORDER BY epoch ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY run, stage, name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def best(spark, sf):
    return op.best_so_far(log(spark, sf).groupBy("run", "stage", "epoch", "name").agg(F.max("value").alias("value")))


@case("M16_best_so_far", f"WITH {BEST} SELECT run, stage, epoch, name, value, best, prev IS NULL OR CASE WHEN name='loss' THEN value<prev ELSE value>prev END AS improved FROM b")
def best_so_far(spark, sf):
    return best(spark, sf)


@case("M17_run_summary", f"WITH {BEST} SELECT run, name, arg_max(best, epoch) FILTER (stage='train') AS train, arg_max(best, epoch) FILTER (stage='val') AS val FROM b GROUP BY 1,2")
def run_summary(spark, sf):
    return op.run_summary(best(spark, sf), ["train", "val"])
