"""Matching and alignment of scan pairs; every operator handles all pairs in one job."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.lineage import cut
from ..functions.maths import rigid_inverse
from ..functions.prefix import number_by_hash
from ..functions.products import TILE, Nearest, vectors
from ..functions.rand import key_hash, uniform
from .neighbours import ball_join, nearest_join, neighbour_counts
from .voxel import grid_sample

XYZ = ("x", "y", "z")
_POSE = T.ArrayType(T.ArrayType(T.DoubleType()))


def _move(m, cols=XYZ):
    c = [F.col(a) for a in cols]
    return [m[i][0] * c[0] + m[i][1] * c[1] + m[i][2] * c[2] + m[i][3] for i in range(3)]


def _sides(pairs: DataFrame, frags: DataFrame, pose="pose"):
    """Source points moved by the pair's transform and target points, keyed by pair."""
    s = frags.withColumnRenamed("frag_id", "src").join(pairs.select("scene", "src", "pair_id", F.col(pose).alias("__m")), ["scene", "src"])
    new = _move(F.col("__m"))
    s = s.select("pair_id", F.col("point_id").alias("query_id"), *[e.alias(a) for e, a in zip(new, XYZ)])
    t = frags.withColumnRenamed("frag_id", "dst").join(pairs.select("scene", "dst", "pair_id"), ["scene", "dst"])
    return s, t.select("pair_id", "point_id", *XYZ)


def overlap_matches(pairs: DataFrame, frags: DataFrame, r: float, m: int | None = 1, both=False) -> tuple[DataFrame, DataFrame]:
    """Matches (pair_id, query_id, point_id, d2), nearest first, and the overlap per pair.

    pairs(scene, src, dst, pair_id, pose 4x4), frags(scene, frag_id, point_id, x, y, z).
    """
    s, t = _sides(pairs, frags)
    matches = ball_join(s, t, r, m, ["pair_id"])

    def share(found, side, key, name):
        hit = found.select("pair_id", key).distinct().groupBy("pair_id").agg(F.count("*").alias("__h"))
        n = side.groupBy("pair_id").agg(F.count("*").alias("__n"))
        return n.join(hit, "pair_id", "left").select("pair_id", (F.coalesce("__h", F.lit(0)) / F.col("__n")).alias(name))

    overlap = share(matches, s, "query_id", "overlap")
    if both:
        back = ball_join(t.withColumnRenamed("point_id", "query_id"), s.withColumnRenamed("query_id", "point_id"), r, 1, ["pair_id"])
        overlap = overlap.join(share(back, t, "query_id", "overlap_back"), "pair_id")
    return matches, overlap


def subsampled_matches(pairs, frags, size: float, r: float, m=1) -> DataFrame:
    """Matches of the grid-sampled source against the full target, in original ids."""
    s, t = _sides(pairs, frags)
    s = grid_sample(s, size, "last", by=["pair_id"], point_id="query_id")
    return ball_join(s, t, r, m, ["pair_id"])


def frame_pairs(frames: DataFrame, how: str = "window", window: int = 2, min_dist: float = 0.0) -> DataFrame:
    """Pairs of frames (seq, i, j): 0 < j-i < window; or for each i the first j < i+window farther than min_dist.

    All pairs of a sequence are the window as long as the sequence.
    """
    left = frames.select("seq", F.col("frame").alias("i"), *[F.col(a).alias(f"__{a}") for a in XYZ])
    left = left.withColumn("frame", F.explode(F.sequence(F.col("i") + 1, F.col("i") + window - 1)))
    j = left.join(frames.select("seq", "frame", *XYZ), ["seq", "frame"])
    if how == "window":
        return j.select("seq", "i", F.col("frame").alias("j"))
    if how != "distance":
        raise ValueError(f"unknown choice {how!r}")
    d2 = sum(((F.col(a) - F.col(f"__{a}")) * (F.col(a) - F.col(f"__{a}")) for a in XYZ), F.lit(0.0))
    return j.where(d2 > min_dist * min_dist).groupBy("seq", "i").agg(F.min("frame").alias("j"))


def filter_overlap(df: DataFrame, lo: float, hi: float) -> DataFrame:
    top = F.greatest("overlap", "overlap_back")
    return df.where((top > lo) & (top < hi))


def benchmark_matches(pairs: DataFrame, frags: DataFrame, r: float, m=1) -> tuple[DataFrame, DataFrame]:
    """Pairs with their true transform (target to source): matches and overlap under its inverse."""
    return overlap_matches(pairs.withColumn("pose", rigid_inverse("pose")), frags, r, m, True)


def track_matches(matches: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Matches whose both points survived sampling, in new ids: src/dst(pair_id, old_id, new_id)."""
    a = src.select("pair_id", F.col("old_id").alias("query_id"), F.col("new_id").alias("src_point"))
    b = dst.select("pair_id", F.col("old_id").alias("point_id"), F.col("new_id").alias("dst_point"))
    return matches.join(a, ["pair_id", "query_id"]).join(b, ["pair_id", "point_id"]).select("pair_id", "src_point", "dst_point")


def limit_matches(matches: DataFrame, n: int, seed) -> DataFrame:
    """At most n random matches per pair."""
    keyed = matches.withColumn("__h", key_hash(seed, "pair_id", "query_id", "point_id"))
    return number_by_hash(keyed, ["pair_id"], "__h", F.struct("query_id", "point_id"), "__rn").where(F.col("__rn") <= n).drop("__rn", "__h")


def self_pairs(frags: DataFrame, r_crop: float, r: float, block: tuple[float, float], seed, min_matches: int = 1, at_once: int = 8) -> tuple[DataFrame, DataFrame]:
    """Self-supervised pairs: two crops of one fragment about random points; the source points in a ball of random radius
    about a random source point are matched with their nearest target point within r.

    Each fragment draws at_once times side by side and the first draw with enough matches stays; fragments without one
    draw again, and only those, until none is left. A fragment cannot succeed when no ball of the largest radius holds
    min_matches points, for both crops and the ball may lie about one point; it does not draw. Returns the matches
    (scene, frag_id, draw, query_id, point_id, d2) and for every fragment the draw that served: null where none can.
    """
    keys = ["scene", "frag_id"]
    by = keys + ["draw"]
    far2 = lambda s, t: sum(((F.col(f"{s}{x}") - F.col(f"{t}{x}")) * (F.col(f"{s}{x}") - F.col(f"{t}{x}")) for x in XYZ), F.lit(0.0))
    d2 = lambda t: far2("", f"{t}.")
    pick = lambda tag: F.min_by(F.struct(*XYZ), F.struct(key_hash(f"{seed}/{tag}", *by, "point_id"), F.col("point_id"))).alias(tag)

    sound = frags.where(reduce(lambda a, b: a & b, [F.abs(F.col(x)) < float("inf") for x in XYZ]))  # no null, NaN or infinity
    if min_matches > 1:
        widest = min(float(block[1]), float(r_crop))
        if block[0] < block[1] <= r_crop:
            widest = float(np.nextafter(widest, 0))  # a radius below the largest is drawn
        counts = neighbour_counts(sound.withColumnRenamed("point_id", "query_id"), sound, widest, keys)
        sound = counts.where(F.col("n") >= min_matches)
    possible = cut(sound.select(*keys).distinct())
    hopeless = frags.select(*keys).distinct().join(possible, keys, "left_anti")
    served, matches, left, first, width = [hopeless.withColumn("draw", F.lit(None).cast("int"))], [], possible, 0, at_once
    while True:
        tries = left.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + width - 1))))
        # Crops farther apart than this have no match; most draws of a large fragment end here, before points are joined.
        centres = frags.join(tries, keys).groupBy(*by).agg(pick("a"), pick("b"))
        centres = cut(centres.where(far2("a.", "b.") <= (2 * r_crop + r) ** 2 * (1 + 1e-9) + 1e-12))
        pts = frags.join(centres, keys)
        source = pts.where(d2("a") <= r_crop * r_crop)
        source = source.join(source.groupBy(*by).agg(pick("c")), by)
        reach = F.lit(float(block[0])) + uniform(f"{seed}/reach", *by) * (block[1] - block[0])
        source = source.where(d2("c") <= reach * reach).select(*by, F.col("point_id").alias("query_id"), *XYZ)
        target = pts.where(d2("b") <= r_crop * r_crop).select(*by, "point_id", *XYZ)
        found = cut(nearest_join(source, target, 1, r, by).drop("rank"))
        good = found.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= min_matches)
        good = cut(good.groupBy(*keys).agg(F.min("draw").alias("draw")))
        if not matches or not good.isEmpty():
            matches.append(found.join(good, by, "left_semi"))
            served.append(good)
            left = cut(left.join(good, keys, "left_anti"))
        if left.isEmpty():
            break
        first, width = first + width, min(2 * width, 8 * at_once)
    return reduce(DataFrame.unionByName, matches), reduce(DataFrame.unionByName, served)


def pair_table(matches: DataFrame, src: DataFrame, dst: DataFrame, features) -> DataFrame:
    """Matches with the source and target rows side by side as structs."""
    a = src.select("pair_id", F.col("point_id").alias("query_id"), F.struct(*features).alias("src"))
    b = dst.select("pair_id", "point_id", F.struct(*features).alias("dst"))
    return matches.join(a, ["pair_id", "query_id"]).join(b, ["pair_id", "point_id"])


# ------------------------------------------------------------------ descriptors

#: Rows of b, and of a, that a task holds at once.
REFERENCES, QUERIES = 16384, 8192


def _matched(by, names):
    """Rows of b of a part, then the rows of a that meet them: the nearest of each."""
    key = [*by, "__pa", "__pb"]

    def run(batches):
        now, held, near = None, [], None
        for b in batches:
            new = np.zeros(b.num_rows, bool)
            new[:1] = True
            for c in [*key, "is_query"]:
                column = b.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, max(b.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                name = tuple(b.column(c)[lo].as_py() for c in key)
                if name != now:
                    now, held, near = name, [], None
                rows = b.slice(lo, hi - lo)
                if not rows.column("is_query")[0].as_py():
                    held.append(rows)
                    continue
                if near is None:
                    if not held:
                        continue
                    near = Nearest(np.concatenate([vectors(h.column("__v")) for h in held]), [i for h in held for i in h.column("b_id").to_pylist()])
                    held = []
                for at in range(0, len(rows), TILE):
                    part = rows.slice(at, TILE)
                    at_q, d2, row = near.find(vectors(part.column("__v")))
                    part = part.take(pa.array(at_q))
                    ids = pa.array([near.ids[i] for i in row], b.schema.field("b_id").type)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in by), part.column("a_id"), ids, pa.array(d2)], names=names)
    return run


def nearest_descriptor(a: DataFrame, b: DataFrame, by=("pair_id",), vec="feat", n_pivots: int = 64) -> DataFrame:
    """Exact nearest descriptor: (by, a_id, b_id, d2), ties to the lower id.

    Descriptors have many dimensions, where hardly any row can be ruled out by its place, so all pairs of a group are
    compared, but as products of matrices. Both sides are dealt into parts that a task holds, each part of one side meets
    each of the other in a task, and the nearest of the parts are aggregated. ``n_pivots`` has no effect any more.
    """
    by = list(by)
    b = b.select(*by, F.col("id").alias("b_id"), F.col(vec).alias("__v"))
    a = a.select(*by, F.col("id").alias("a_id"), F.col(vec).alias("__v"))
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(t, most):  # a row for each group
        return t.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).cast("long").alias("n"))

    sizes = parts(a, QUERIES).withColumnRenamed("n", "__na").join(parts(b, REFERENCES).withColumnRenamed("n", "__nb"), by)
    groups = cut(sizes)
    # Few parts would leave tasks without work: queries are dealt finer then.
    whole = groups.agg(F.sum(F.col("__na") * F.col("__nb"))).first()[0] or 1
    groups = groups.withColumn("__na", F.col("__na") * max(1, -(-2 * n // whole)))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    kind = {f.name: f.dataType for f in [*a.schema.fields, *b.schema.fields]}
    left = a.join(groups, by).withColumn("__pa", F.pmod(F.xxhash64("a_id", "__v"), F.col("__na"))).withColumn("__pb", every("__nb"))
    right = b.join(groups, by).withColumn("__pb", F.pmod(F.xxhash64("b_id", "__v"), F.col("__nb"))).withColumn("__pa", every("__na"))
    cols = [*by, "__pa", "__pb", "is_query", "a_id", "b_id", "__v"]
    vector = lambda t: F.col("__v").cast("array<double>").alias("__v")
    left = left.withColumns({"is_query": F.lit(True), "b_id": F.lit(None).cast(kind["b_id"])}).select(*cols[:-1], vector(left))
    right = right.withColumns({"is_query": F.lit(False), "a_id": F.lit(None).cast(kind["a_id"])}).select(*cols[:-1], vector(right))
    both = left.unionByName(right).repartition(max(n, min(int(whole), 4096)), *by, "__pa", "__pb").sortWithinPartitions(*by, "__pa", "__pb", "is_query")
    names = [*by, "a_id", "b_id", "d2"]
    schema = T.StructType([*[T.StructField(c, kind[c]) for c in names[:-1]], T.StructField("d2", T.DoubleType())])
    near = both.mapInArrow(_matched(by, names), schema)
    return near.groupBy(*by, "a_id").agg(F.min(F.struct("d2", "b_id")).alias("m")).select(*by, "a_id", F.col("m.b_id").alias("b_id"), F.col("m.d2").alias("d2"))


def feature_matches(a, b, mutual=False, by=("pair_id",), vec="feat", n_pivots=64) -> DataFrame:
    fwd = nearest_descriptor(a, b, by, vec, n_pivots)
    if not mutual:
        return fwd
    back = nearest_descriptor(b, a, by, vec, n_pivots).select(*by, F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id"))
    return fwd.join(back, [*by, "a_id", "b_id"], "left_semi")


def descriptor_accuracy(a, b, by=("pair_id",), vec="feat") -> DataFrame:
    """Share in percent of rows whose nearest reference row is their own."""
    return feature_matches(a, b, by=by, vec=vec).groupBy(*by).agg((100.0 * F.avg((F.col("a_id") == F.col("b_id")).cast("double"))).alias("accuracy"))


# ------------------------------------------------------------------ alignment

@F.pandas_udf(_POSE)
def _kabsch(h: pd.Series, ms: pd.Series, mt: pd.Series) -> pd.Series:
    m = np.stack(h.to_numpy()).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(m)
    v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
    fix = np.tile(np.eye(3), (len(m), 1, 1))
    fix[:, 2, 2] = np.sign(np.linalg.det(v @ ut))
    r = v @ fix @ ut
    a, b = np.stack(ms.to_numpy()), np.stack(mt.to_numpy())
    out = np.tile(np.eye(4), (len(m), 1, 1))
    out[:, :3, :3], out[:, :3, 3] = r, b - np.einsum("nij,nj->ni", r, a)
    return pd.Series([[list(row) for row in p] for p in out])


def fit_rigid(matches: DataFrame, by=("pair_id",)) -> DataFrame:
    """Turn and shift from matched points (sx, sy, sz) to (tx, ty, tz): one aggregate and a 3x3 solve per pair."""
    s, t = ["sx", "sy", "sz"], ["tx", "ty", "tz"]
    sums = matches.groupBy(*by).agg(
        F.array(*[F.covar_pop(a, b) for a in s for b in t]).alias("h"), F.array(*[F.avg(a) for a in s]).alias("ms"), F.array(*[F.avg(b) for b in t]).alias("mt"))
    return sums.select(*by, _kabsch("h", "ms", "mt").alias("pose"))


@F.pandas_udf(_POSE)
def _twist_step(sums: pd.Series, pose: pd.Series) -> pd.Series:
    """Solve the 6x6 system and put its motion before the pose so far."""
    flat = np.stack(sums.to_numpy())
    upper = np.triu_indices(6)
    a = np.zeros((len(flat), 6, 6))
    a[:, upper[0], upper[1]] = flat[:, :21]
    a = a + np.triu(a, 1).transpose(0, 2, 1)
    # Too few matches leave the system without a single answer: then the shortest one, and none from values that are not finite.
    known = np.isfinite(flat).all(1)
    x = np.zeros((len(flat), 6))
    if known.any():
        x[known] = (np.linalg.pinv(a[known], hermitian=True) @ flat[known, 21:, None])[..., 0]
    out = []
    for xi, p in zip(x, pose):
        theta = np.linalg.norm(xi[:3])
        k = xi[:3] / theta if theta > 0 else xi[:3]
        c = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        step = np.eye(4)
        step[:3, :3] = np.eye(3) + np.sin(theta) * c + (1 - np.cos(theta)) * c @ c
        step[:3, 3] = xi[3:]
        out.append([list(row) for row in step @ np.array([list(r) for r in p])])
    return pd.Series(out)


def fit_robust(matches: DataFrame, by=("pair_id",), mu: float = 1.0, rounds: int = 20) -> DataFrame:
    """Weighted least squares with weights mu/(mu + |residual|^2), mu halved every five rounds.

    A round is one aggregate of 27 sums per pair and a 6x6 solve; matches are
    never gathered. Both sides of the system carry the weight, so it counts squared.
    """
    by = list(by)
    unit = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(4)]) for i in range(4)])
    matches = cut(matches)  # read in every round
    poses = matches.select(*by).distinct().withColumn("pose", unit)
    s = ("sx", "sy", "sz")
    for i in range(rounds):
        if i and i % 5 == 0:
            mu /= 2.0
        m = F.col("pose")
        x = [F.col(f"__{a}") for a in XYZ]
        d = [F.col(f"t{a}") - c for a, c in zip(XYZ, x)]
        rows = matches.join(poses, by)
        rows = rows.withColumns({f"__{a}": e for a, e in zip(XYZ, _move(m, s))})
        w = F.lit(1.0) if i == 0 else F.lit(mu) / (F.lit(mu) + d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        zero, one = F.lit(0.0), F.lit(1.0)
        a = [[zero, x[2], -x[1], one, zero, zero], [-x[2], zero, x[0], zero, one, zero], [x[1], -x[0], zero, zero, zero, one]]
        ww = F.col("__w") * F.col("__w")
        rows = rows.withColumn("__w", w)
        terms = [F.sum(ww * sum((a[r][p] * a[r][q] for r in range(3)), F.lit(0.0))) for p in range(6) for q in range(p, 6)]
        terms += [F.sum(ww * sum((a[r][p] * d[r] for r in range(3)), F.lit(0.0))) for p in range(6)]
        sums = rows.groupBy(*by).agg(F.array(*terms).alias("__s"))
        poses = sums.join(poses, by).select(*by, _twist_step("__s", "pose").alias("pose"))
        poses = cut(poses)
    return poses


# ------------------------------------------------------------------ errors

def transform_errors(df: DataFrame, truth="pose_gt", pred="pose") -> DataFrame:
    """Translation error and rotation error in degrees of two 4x4 columns."""
    g, p = F.col(truth), F.col(pred)
    trace = sum((g[i][j] * p[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    shift = sum(((g[i][3] - p[i][3]) * (g[i][3] - p[i][3]) for i in range(3)), F.lit(0.0))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) * 0.5))
    return df.withColumns({"trans_error": F.sqrt(shift), "rot_error": F.degrees(F.acos(cos))})


def pair_errors(matches: DataFrame, points: DataFrame, poses: DataFrame, tau: float, recall: float = 0.2, by=("pair_id",)) -> DataFrame:
    """Per pair: hit ratio, translation, rotation and scaled error, and recall.

    matches(by, sx.., tx..), points(by, x, y, z) of the source, poses(by, pose_gt, pose).
    """
    by = list(by)
    s, norm = ("sx", "sy", "sz"), lambda e: F.sqrt(sum((c * c for c in e), F.lit(0.0)))
    m = matches.join(poses, by)
    under = lambda pose: [c - F.col(f"t{a}") for c, a in zip(_move(F.col(pose), s), XYZ)]
    hits = m.groupBy(*by).agg(F.avg((norm(under("pose_gt")) < tau).cast("double")).alias("hit_ratio"), (F.avg(norm(under("pose"))) < recall).alias("recalled"))
    # The centre of the moved points is the moved centre, so one aggregate over the points gives it.
    mid = points.groupBy(*by).agg(*[F.avg(a).alias(f"__c{a}") for a in XYZ])
    p = points.join(poses, by).join(mid, by)
    est, gt, centre = _move(F.col("pose")), _move(F.col("pose_gt")), _move(F.col("pose"), [f"__c{a}" for a in XYZ])
    scaled = norm([a - b for a, b in zip(est, gt)]) / (norm([a - b for a, b in zip(est, centre)]) + 1e-12)
    err = p.groupBy(*by).agg(F.avg(scaled).alias("sr_err"))
    return transform_errors(poses).select(*by, "trans_error", "rot_error").join(hits, by).join(err, by)


def registration_report(errors: DataFrame, tau_2: float = 0.05, rot: float = 5.0, trans: float = 0.3) -> DataFrame:
    flag = lambda c: F.avg(c.cast("double"))
    return errors.agg(
        F.avg("hit_ratio").alias("hit_ratio"), flag(F.col("hit_ratio") > tau_2).alias("feat_match_ratio"), F.avg("trans_error").alias("trans_error"),
        F.avg("rot_error").alias("rot_error"), flag(F.col("rot_error") < rot).alias("rre"), flag(F.col("trans_error") < trans).alias("rte"),
        F.avg("sr_err").alias("sr_err"), flag(F.col("recalled")).alias("recall"))
