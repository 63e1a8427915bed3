"""Segmentation metrics, voting over overlapping samples, running statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.maths import argmax, ratio
from ..functions.prefix import running, score_levels
from .neighbours import knn_interpolate, nearest_join

SCAN = ("scan_id",)


# ------------------------------------------------------------------ confusion

def confusion(df: DataFrame, ignore: int = -1, truth="label", pred=None, scores="scores", by=()) -> DataFrame:
    """Rows per (truth, pred), the ignored label left out; pred is the first maximum of the scores."""
    p = F.col(pred) if pred else argmax(scores)
    rows = df.where(F.col(truth) != ignore).select(*by, F.col(truth).alias("truth"), p.alias("pred"))
    return rows.groupBy(*by, "truth", "pred").agg(F.count("*").alias("n"))


def class_counts(conf: DataFrame, n: int, by=()) -> DataFrame:
    """tp, truth and predicted totals per class 0..n-1, one row each."""
    flat = conf.select(*by, F.inline(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")))))
    classes = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("class")
    frame = conf.select(*by).distinct().select(*by, classes) if by else conf.sparkSession.range(1).select(classes)
    sums = flat.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_truth"), F.sum("p").alias("n_pred"))
    return frame.join(sums, [*by, "class"], "left").na.fill(0, ["tp", "n_truth", "n_pred"])


def iou(conf: DataFrame, n: int, by=()) -> DataFrame:
    """Per class 1e-8 + tp/(union + 1e-8), present when the union is above 1e-3."""
    c = class_counts(conf, n, by)
    union = F.col("n_truth") + F.col("n_pred") - F.col("tp")
    return c.select(*by, "class", (1e-8 + F.col("tp") / (union + 1e-8)).alias("iou"), (union > 1e-3).alias("present"))


def mean_iou(per_class: DataFrame, missing_as_one=False, by=()) -> DataFrame:
    v = F.when(F.col("present"), F.col("iou")).otherwise(F.lit(1.0) if missing_as_one else F.lit(None))
    return per_class.groupBy(*by).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("miou"))


def accuracies(conf: DataFrame, n: int, by=()) -> DataFrame:
    """Overall accuracy and the mean over classes with truth of tp/truth."""
    c = class_counts(conf, n, by)
    return c.groupBy(*by).agg(ratio(F.sum("tp"), F.sum("n_truth")).alias("acc"),
                              F.avg(F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth"))).alias("macc"))


def normalise_confusion(conf: DataFrame, axis="truth", by=()) -> DataFrame:
    """Share of each cell in its truth (recall) or prediction (precision) total."""
    total = conf.groupBy(*by, axis).agg(F.sum("n").alias("__t"))
    return conf.join(total, [*by, axis]).withColumn("share", ratio("n", "__t")).drop("__t")


def iou_percent(df: DataFrame, n: int, ignore=-1, per_image=False, image="image_id", truth="label", pred="pred") -> DataFrame:
    """IoU in percent per class; ignored pixels are not false positives; an empty class is 100; mean over images when asked."""
    by = [image] if per_image else []
    rows = df.where(F.col(truth) != ignore)
    conf = rows.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    c = class_counts(conf, n, by)
    c = c.withColumn("v", ratio(F.col("tp"), F.col("n_truth") + F.col("n_pred") - F.col("tp"), 1.0) * 100)
    return c.groupBy("class").agg(F.avg("v").alias("iou_percent"))


def lovasz_softmax(df: DataFrame, n: int, by=SCAN, truth="label", scores="scores", row_id="point_id", ignore=-1) -> DataFrame:
    """Per group: the mean over the classes present of sum(error * Jaccard step), errors in falling order.

    Equal errors may come in any order, as their steps telescope, so the rows
    of one error value are folded before the order is taken.
    """
    by = list(by)
    rows = df.where(F.col(truth) != ignore).select(*by, truth, F.posexplode(scores).alias("class", "p")).where(F.col("class") < n)
    hit = (F.col(truth) == F.col("class")).cast("long")
    e = rows.select(*by, "class", hit.alias("hit"), F.abs(hit - F.col("p")).alias("error"))
    e = e.groupBy(*by, "class", "error").agg(F.sum("hit").alias("hit"), F.count("*").alias("n"))
    keys = by + ["class"]
    total = e.groupBy(*keys).agg(F.sum("hit").alias("gts")).where("gts > 0")
    e = running(e, keys, [F.floor(-F.col("error") * 4096)], [-F.col("error")], {"ch": F.col("hit"), "cn": F.col("n")}).join(total, keys)

    def jaccard(h, m):
        return 1 - (F.col("gts") - h) / (F.col("gts") + (m - h)).cast("double")

    step = jaccard(F.col("ch"), F.col("cn")) - jaccard(F.col("ch") - F.col("hit"), F.col("cn") - F.col("n"))
    per_class = e.groupBy(*keys).agg(F.sum(F.col("error") * step).alias("loss"))
    return per_class.groupBy(*by).agg(F.avg("loss").alias("lovasz"))


# ------------------------------------------------------------------ votes

def vote(preds: DataFrame, n: int, by=SCAN, sample="sample_id", row_id="row_id", scores="scores", extra=()) -> DataFrame:
    """Sum of scores and number of votes per point; a point repeated in one sample counts once, by its highest row."""
    keys = [*by, "point_id"]
    one = preds.groupBy(*keys, sample).agg(F.max_by(F.struct(scores, *extra), row_id).alias("__v"))
    sums = [F.sum(F.col(f"__v.{scores}")[i]).alias(f"__s{i}") for i in range(n)]
    out = one.groupBy(*keys).agg(F.count("*").alias("n_votes"), *sums, *[F.max(f"__v.{c}").alias(c) for c in extra])
    return out.select(*keys, "n_votes", F.array(*[f"__s{i}" for i in range(n)]).alias("scores"), *extra)


def coverage(points: DataFrame, votes: DataFrame, by=SCAN) -> DataFrame:
    keys = [*by, "point_id"]
    j = points.select(*keys).join(votes.select(*keys, "n_votes"), keys, "left")
    return j.groupBy(*by).agg(F.avg(F.col("n_votes").isNotNull().cast("double")).alias("coverage"), F.coalesce(F.sum("n_votes"), F.lit(0)).alias("n_votes"))


def full_resolution(points: DataFrame, votes: DataFrame, k: int = 1, n: int | None = None, by=SCAN) -> DataFrame:
    """Class of every point: its own vote, or that of the nearest voted point; with k > 1 all points interpolate k votes."""
    keys = [*by, "point_id"]
    own = votes.select(*keys, argmax("scores").alias("pred"), "scores")
    placed = own.join(points.select(*keys, "x", "y", "z"), keys)
    if k == 1:
        missing = points.join(votes.select(*keys), keys, "left_anti").select(*by, F.col("point_id").alias("query_id"), "x", "y", "z")
        near = nearest_join(missing, placed, 1, by=by).join(own.select(*keys, "pred"), keys)
        filled = near.select(*by, F.col("query_id").alias("point_id"), "pred")
        return own.select(*keys, "pred").unionByName(filled)
    cols = [f"__s{i}" for i in range(n)]
    wide = placed.withColumns({c: F.col("scores")[i] for i, c in enumerate(cols)})
    q = points.select(*by, F.col("point_id").alias("query_id"), "x", "y", "z")
    out = knn_interpolate(wide, q, k, cols, by)
    return out.select(*by, F.col("query_id").alias("point_id"), argmax(F.array(*cols)).alias("pred"))


def segmentation_report(points: DataFrame, preds: DataFrame, names, ignore=-1, by=SCAN) -> DataFrame:
    """IoU per class at three levels: per sample rows, voted points, full resolution."""
    n = len(names)
    votes = vote(preds, n, by)
    truth = points.select(*by, "point_id", "label")
    levels = {
        "sample": confusion(preds, ignore),
        "voted": confusion(votes.join(truth, [*by, "point_id"]), ignore),
        "full": confusion(full_resolution(points, votes, 1, by=by).join(truth, [*by, "point_id"]), ignore, pred="pred"),
    }
    conf = reduce(lambda a, b: a.unionByName(b), [c.withColumn("level", F.lit(k)) for k, c in levels.items()])
    name = F.array(*[F.lit(v) for v in names])[F.col("class")]
    return iou(conf, n, ["level"]).withColumn("name", name)


# ------------------------------------------------------------------ shapes, scores, runs

def part_iou(df: DataFrame, parts: dict, shape="shape_id", category="category", truth="truth", pred="pred") -> DataFrame:
    """Per shape: mean IoU over the parts of its category, an absent part counting 1."""
    table = F.create_map(*[x for c, ps in parts.items() for x in (F.lit(c), F.array(*[F.lit(p) for p in ps]))])
    flat = df.groupBy(shape, category, truth, pred).agg(F.count("*").alias("n"))
    flat = flat.withColumn("part", F.explode(table[F.col(category)]))
    is_t, is_p = F.col(truth) == F.col("part"), F.col(pred) == F.col("part")
    per = flat.groupBy(shape, category, "part").agg(
        F.sum(F.when(is_t & is_p, F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(is_t | is_p, F.col("n")).otherwise(0)).alias("u"))
    return per.groupBy(shape, category).agg(F.avg(ratio("i", "u", 1.0)).alias("iou"))


def part_iou_summary(per_shape: DataFrame, category="category") -> DataFrame:
    """Mean over shapes and mean over category means."""
    per = per_shape.groupBy(category).agg(F.avg("iou").alias("m"), F.sum("iou").alias("s"), F.count("*").alias("n"))
    return per.agg((F.sum("s") / F.sum("n")).alias("instance_miou"), F.avg("m").alias("class_miou"))


def masked_argmax(scores, parts) -> "F.Column":
    """Argmax limited to an array column of allowed classes."""
    s, p = F.col(scores), F.col(parts)
    best = F.array_max(F.transform(p, lambda i: F.struct(F.element_at(s, i + 1).alias("s"), (-i).alias("i"))))
    return -best["i"]


def batch_accuracy(df: DataFrame, batch="batch_id", truth="truth", pred="pred") -> DataFrame:
    per = df.groupBy(batch).agg((100.0 * F.avg((F.col(truth) == F.col(pred)).cast("double"))).alias("acc"))
    return per.agg(F.avg("acc").alias("acc"))


def average_precision(df: DataFrame, by=("class",), score="score", truth="truth", row_id="row_id", weight: str | None = None) -> DataFrame:
    """Per class: sum of the precision at the positives over max(positives, 1), scores falling, ties by id."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = F.col(truth).cast("double")
    r = running(df, by, score_levels(score, row_id), [-F.col(score), F.col(row_id)], {"__tp": t * w if weight else t, "__n": w})
    pos = F.col("__tp") / F.col("__n")
    return r.groupBy(*by).agg((F.sum(F.when(t > 0, pos).otherwise(0.0)) / F.greatest(F.sum(t), F.lit(1.0))).alias("ap"))


def mean_meter(df: DataFrame, by=("stage", "name"), value="value") -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count(value).alias("n"))


def running_stats(df: DataFrame, by=("stage", "name"), value="value") -> DataFrame:
    """Mean, sample variance (0 for one value) and standard deviation."""
    var = F.coalesce(F.var_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), var.alias("variance"), F.sqrt(var).alias("std"))


# Which way a metric improves, by a part of its name.
DIRECTIONS = {"loss": "min", "iou": "max", "acc": "max", "map": "max", "miou": "max", "macc": "max"}


def best_so_far(df: DataFrame, directions=None, by=("run", "stage", "name"), epoch="epoch", value="value") -> DataFrame:
    """Best value up to each epoch and whether the epoch improved on it; a group is the epochs of one metric of one run."""
    directions = directions or DIRECTIONS
    down = reduce(lambda a, b: a | b, [F.lower("name").contains(k) for k, d in directions.items() if d == "min"])
    signed = F.when(down, -F.col(value)).otherwise(F.col(value))
    w = W.partitionBy(*by).orderBy(epoch)
    before = F.max(signed).over(w.rowsBetween(W.unboundedPreceding, -1))
    now = F.max(signed).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumns({"best": F.when(down, -now).otherwise(now), "improved": before.isNull() | (signed > before)})


def run_summary(df: DataFrame, stages, by=("run", "name"), epoch="epoch", value="best") -> DataFrame:
    """The latest value of each run and metric, one column per stage."""
    cells = [F.max_by(F.when(F.col("stage") == s, F.col(value)), F.when(F.col("stage") == s, F.col(epoch))).alias(s) for s in stages]
    return df.groupBy(*by).agg(*cells)
