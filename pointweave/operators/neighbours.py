"""Neighbour joins: radius, k nearest, interpolation and what builds on them.

A radius join is an equi join on grid cells with the exact distance as a
filter. A k-nearest join meets blocks of some thousand points (``celltree``): what a
query finds in its own block tells which other blocks it has to look into.
Copies of one place are reduced to the k smallest ids beforehand, which is
exact because equal distances are ordered by id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from . import celltree
from ..functions.lineage import cut
from ..functions.groups import top_per_group
from ..functions.maths import six_digits, squared_distance
from ..functions.products import TILE, Nearest, vectors
from ..functions.rand import key_hash

SCAN = ("scan_id",)
XYZ = ("x", "y", "z")
# Rows of one cell that one task meets at once.
CROWD = 4096


def _cells(axes, size) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"__c{a}") for a in axes]


def _cover(df: DataFrame, axes, size, radius, prefix="", last: Column | None = None) -> DataFrame:
    """One row per cell of the given size that the ball around the row touches; with ``last`` only cells 0 to last."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    for a in axes:
        lo = F.floor((F.col(prefix + a) - radius) / size).cast("long")
        hi = F.floor((F.col(prefix + a) + radius) / size).cast("long")
        if last is not None:
            lo, hi = F.greatest(lo, F.lit(0).cast("long")), F.least(hi, last)
        df = df.withColumn(f"__c{a}", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    gaps = []
    for a in axes:
        low = F.col(f"__c{a}") * size
        p = F.col(prefix + a)
        gaps.append(F.greatest(low - p, p - low - size, F.lit(0.0)))
    gap = reduce(lambda u, v: u + v, [g * g for g in gaps])
    return df.where(gap <= radius * radius * (1 + 1e-9) + 1e-12)


def radius_join(q: DataFrame, s: DataFrame, r, by=SCAN, q_id="query_id", s_id="point_id", axes=XYZ,
                carry=(), q_carry=(), size: float | None = None, strict=False, crowd: int = CROWD) -> DataFrame:
    """All pairs within r: (by, q_id, s_id, d2). The smaller side should be the queries.

    ``r`` may be a column of the query side when a cell ``size`` is given. The queries are written once per cell they
    reach, of which Spark's size estimate knows nothing: the merge hint keeps it from collecting them for a broadcast.
    Cells of more than ``crowd`` rows are cut into parts, which the queries there meet one by one, in other tasks.
    """
    by = list(by)
    size = size or float(r)
    radius = r if isinstance(r, Column) else F.lit(float(r))
    left = q.select(*by, q_id, *q_carry, *[F.col(a).alias(f"__q{a}") for a in axes], radius.alias("__r"))
    left = _cover(left, axes, size, F.col("__r"), "__q")
    right = s.select(*by, s_id, *carry, *axes, *_cells(axes, size))
    on = by + [f"__c{a}" for a in axes]
    if not s.isStreaming:
        left, right = _parted(left, right, on, F.xxhash64(s_id, *axes), crowd)
        on = [*on, "__part"]
        n = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few small rows may make many: never merged
        left, right = left.repartition(n, *on), right.repartition(n, *on)
    d2 = squared_distance([f"__q{a}" for a in axes], axes)
    out = left.hint("merge").join(right, on).withColumn("d2", d2) if not s.isStreaming else left.join(right, on).withColumn("d2", d2)
    limit = F.col("__r") * F.col("__r")
    out = out.where(F.col("d2") < limit if strict else F.col("d2") <= limit)
    return out.select(*by, q_id, s_id, "d2", *q_carry, *carry)


def _parted(left: DataFrame, right: DataFrame, on, mark: Column, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part: a row of the right side has one, of the left side all parts of its cell."""
    zero = F.lit(0).cast("long")
    busy = right.groupBy(*on).agg(F.floor((F.count("*") - 1) / crowd).cast("long").alias("__last")).where("__last > 0")
    busy = cut(busy)  # both sides must see the same parts; at most a row for each crowd of rows
    if busy.isEmpty():
        return left.withColumn("__part", zero), right.withColumn("__part", zero)
    last = F.coalesce("__last", zero)
    left = left.join(F.broadcast(busy), on, "left").withColumn("__part", F.explode(F.sequence(zero, last)))
    right = right.join(F.broadcast(busy), on, "left").withColumn("__part", F.pmod(mark, last + 1))
    return left.drop("__last"), right.drop("__last")


def nearest_join(q: DataFrame, s: DataFrame, k: int, r: float | None = None, by=SCAN, q_id="query_id",
                 s_id="point_id", axes=XYZ) -> DataFrame:
    """The exact k nearest points of each query, at most r away: (by, q_id, rank, s_id, d2), rank from 1."""
    by, ax = list(by), list(axes)
    xs = [F.col(a).cast("double").alias(f"x{i}") for i, a in enumerate(ax)]
    at = [f"x{i}" for i in range(len(ax))]
    whole = reduce(lambda u, v: u & v, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in ax])

    # Queries at one place share one answer; copies beyond the k smallest ids cannot be in any answer.
    asked = q.where(whole).select(*by, F.col(q_id).alias("__q"), *xs)
    places = cut(asked.groupBy(*by, *at).agg(F.min("__q").alias("site"), F.count("*").alias("copies")))
    points = cut(top_per_group(s.where(whole).select(*by, F.col(s_id).alias("id"), *xs), by + at, [F.col("id")], k))
    best = celltree.nearest(places.select(*by, F.col("site").alias("id"), *at), points, k, r, by, len(ax))
    shared = places.where("copies > 1").select(*by, "site", *at)
    several = asked.join(shared, by + at).select(*by, "site", "__q")
    out = best.join(several, by + ["site"], "left").withColumn(q_id, F.coalesce("__q", "site"))
    return out.select(*by, q_id, "rank", F.col("id").alias(s_id), "d2")


def knn_join(q, s, k, by=SCAN, q_id="query_id", s_id="point_id", axes=XYZ) -> DataFrame:
    """Exact k nearest, the point itself included when the clouds are the same; ties by id."""
    return nearest_join(q, s, k, None, by, q_id, s_id, axes)


def ball_join(q, s, r, max_n: int | None, by=SCAN, q_id="query_id", s_id="point_id", axes=XYZ) -> DataFrame:
    """Neighbours within r; with max_n the nearest max_n of them."""
    if max_n is None:
        return radius_join(q, s, r, by, q_id, s_id, axes)
    return nearest_join(q, s, max_n, r, by, q_id, s_id, axes).drop("rank")


def dilated_knn(q, s, k: int, d: int, seed, by=SCAN, q_id="query_id", s_id="point_id") -> DataFrame:
    """k of the k*d nearest, drawn with replacement."""
    near = knn_join(q, s, k * d, by, q_id, s_id)
    have = near.groupBy(*by, q_id).agg(F.max("rank").alias("__n"))
    picks = have.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    picks = picks.withColumn("rank", (key_hash(seed, *by, q_id, "pick") % F.col("__n") + 1).cast("int")).drop("__n")
    return picks.join(near, [*by, q_id, "rank"]).drop("rank")


def interpolation_weights(near: DataFrame, by=SCAN, q_id="query_id") -> DataFrame:
    """Weights 1/max(d2, 1e-16) normalised per query; the table can be stored and reused."""
    w = near.withColumn("w", F.lit(1.0) / F.greatest("d2", F.lit(1e-16)))
    total = F.sum("w").over(W.partitionBy(*by, q_id))
    return w.withColumn("w", F.col("w") / total)


def knn_interpolate(src, dst, k: int, cols, by=SCAN, q_id="query_id", s_id="point_id", weights=None) -> DataFrame:
    """Values at dst from the k nearest rows of src, weighted by inverse squared distance."""
    weights = weights if weights is not None else interpolation_weights(knn_join(dst, src, k, by, q_id, s_id), by, q_id)
    joined = weights.join(src.select(*by, s_id, *cols), [*by, s_id])
    return joined.groupBy(*by, q_id).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])


def neighbour_counts(q, s, r, by=SCAN, q_id="query_id", axes=XYZ) -> DataFrame:
    """Neighbours within r per query, zeros included. Copies of a place count once each but join once."""
    by, ax = list(by), list(axes)
    mass = s.groupBy(*by, *ax).agg(F.count("*").alias("__m"), F.min(F.lit(0)).alias("__s"))
    sites = q.groupBy(*by, *ax).agg(F.min(q_id).alias("__site"))
    near = radius_join(sites, mass, r, by, "__site", "__m", ax)
    n = near.groupBy(*by, "__site").agg(F.sum("__m").alias("n"))
    sites = sites.join(n, by + ["__site"], "left").select(*by, *ax, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return q.select(*by, q_id, *ax).join(sites, by + ax).select(*by, q_id, "n")


def neighbour_histogram(q, s, radii, by=SCAN, q_id="query_id", normalised=False) -> DataFrame:
    """How many queries have n neighbours, per radius; one join at the largest radius serves all."""
    by = list(by)
    mass = s.groupBy(*by, *XYZ).agg(F.count("*").alias("__m"))
    sites = q.groupBy(*by, *XYZ).agg(F.min(q_id).alias("__site"), F.count("*").alias("__w"))
    near = radius_join(sites, mass, max(radii), by, "__site", "__m")
    per = near.groupBy(*by, "__site").agg(
        *[F.sum(F.when(F.col("d2") <= r * r, F.col("__m")).otherwise(0)).alias(f"n{i}") for i, r in enumerate(radii)])
    sites = sites.join(per, by + ["__site"], "left").na.fill(0)
    flat = sites.select("__w", F.explode(F.array(*[
        F.struct(F.lit(float(r)).alias("radius"), F.col(f"n{i}").alias("n")) for i, r in enumerate(radii)])).alias("e"))
    hist = flat.groupBy(F.col("e.radius").alias("radius"), F.col("e.n").alias("n")).agg(F.sum("__w").alias("queries"))
    if normalised:
        hist = hist.withColumn("share", F.col("queries") / F.sum("queries").over(W.partitionBy("radius")))
    return hist


def nearest_distance(a: DataFrame, b: DataFrame, kind: str = "squared", delta: float = 1.0, by=SCAN, point_id="point_id",
                     euclid: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Nearest point both ways: (by, side, point_id, other, dist).

    For L1 the nearest L1 neighbour lies within the L1 distance of the nearest
    Euclidean one, which bounds a second search; the Huber distance, a sum over
    the axes that grows with each difference, is bounded in the same way, and by
    the distance itself where that is below delta. ``euclid`` gives what
    ``nearest_both`` found, so that several kinds share it.
    """
    def one_way(q, s, side, near):
        qs = q.select(*by, F.col(point_id).alias("query_id"), *XYZ)
        if kind == "squared":
            return near.select(*by, F.lit(side).alias("side"), F.col("query_id").alias(point_id), F.col(point_id).alias("other"), F.col("d2").alias("dist"))
        first = near.select(*by, "query_id", F.col("d2"))
        # Euclid <= L1, and Huber < bound implies each |difference| below bound/delta + delta/2.
        bounded = qs.join(first, [*by, "query_id"])
        # Below delta every axis of a better place is below delta too, where Huber orders as Euclid does.
        radius = F.sqrt(F.lit(3.0) * F.col("d2")) if kind == "l1" else F.when(F.sqrt("d2") < delta * (1 - 1e-9), F.sqrt("d2")).otherwise(
            F.sqrt(F.lit(3.0)) * F.greatest(F.sqrt(F.col("d2")), F.col("d2") / (2 * delta) + F.lit(delta / 2)))
        bounded = bounded.withColumn("__rad", radius * (1 + 1e-9) + 1e-12)
        # One cell size per power of two of the radius keeps the cover small.
        bounded = cut(bounded.withColumn("__s", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("__rad"))))))
        sizes = bounded.select(*by, "__s").distinct()
        cells = [f"__c{x}" for x in XYZ]
        left = bounded.select(*by, "query_id", "__rad", "__s", *[F.col(x).alias(f"__q{x}") for x in XYZ])
        left = _cover(left, XYZ, F.col("__s"), F.col("__rad"), "__q")
        right = s.groupBy(*by, *XYZ).agg(F.min(point_id).alias(point_id)).join(sizes, list(by)).withColumns(
            {f"__c{x}": F.floor(F.col(x) / F.col("__s")).cast("long") for x in XYZ})
        both = left.join(right, [*by, "__s", *cells])
        diff = [F.abs(F.col(f"__q{x}") - F.col(x)) for x in XYZ]
        each = diff if kind == "l1" else [
            F.when(d < delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)) for d in diff]
        both = both.withColumn("dist", each[0] + each[1] + each[2])
        return both.groupBy(*by, "query_id").agg(F.min(F.struct("dist", point_id)).alias("__m")).select(
            *by, F.lit(side).alias("side"), F.col("query_id").alias(point_id),
            F.col(f"__m.{point_id}").alias("other"), F.col("__m.dist").alias("dist"))

    ab, ba = euclid or nearest_both(a, b, by, point_id)
    return one_way(a, b, "a", ab).unionByName(one_way(b, a, "b", ba))


def nearest_both(a: DataFrame, b: DataFrame, by=SCAN, point_id="point_id") -> tuple[DataFrame, DataFrame]:
    """The nearest Euclidean point of each point of a in b, and of b in a, stored."""
    return tuple(cut(nearest_join(q.select(*by, F.col(point_id).alias("query_id"), *XYZ), s, 1, by=by, s_id=point_id)) for q, s in ((a, b), (b, a)))


def chamfer(distances: DataFrame, by=SCAN) -> DataFrame:
    return distances.groupBy(*by).agg(
        (F.avg(F.when(F.col("side") == "a", F.col("dist"))) + F.avg(F.when(F.col("side") == "b", F.col("dist")))).alias("chamfer"))


def dirichlet_energy(df: DataFrame, r: float, col: str, by=SCAN, point_id="point_id") -> DataFrame:
    """Half of the mean over points of the summed squared differences to the neighbours within r.

    Copies of one place are first folded into (n, sum, sum of squares), so the join sees places only.
    """
    by = list(by)
    v = F.col(col).cast("double")
    site = df.groupBy(*by, *XYZ).agg(F.min(point_id).alias("site"), F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    pairs = radius_join(site.withColumnRenamed("site", "query_id").withColumnsRenamed({"n": "n1", "s": "s1", "q": "q1"}),
                        site, r, by, "query_id", "site", carry=("n", "s", "q"), q_carry=("n1", "s1", "q1"))
    term = F.col("q1") * F.col("n") - 2 * F.col("s1") * F.col("s") + F.col("q") * F.col("n1")
    size = df.groupBy(*by).agg(F.count("*").alias("n_points"))
    total = pairs.groupBy(*by).agg(F.sum(term).alias("t"))
    return total.join(size, by).select(*by, (F.col("t") / F.col("n_points") / 2).alias("energy"))


#: Vectors of a cell, and queries there, that a task holds at once.
CELL_PART, QUERY_PART = 8192, 8192


def _met_in_cells(q: DataFrame, s: DataFrame, k: int, by, q_id: str, s_id: str) -> DataFrame:
    """(by, q_id, s_id, d2) of the k nearest in each part of a cell: q(by, q_id, __cell, __p), s(by, s_id, __cell, __t).

    Pairs are never rows: the vectors of a part of a cell are held by a task and the queries that look into it are multiplied with them.
    """
    by = list(by)
    on = [*by, "__cell"]
    zero = F.lit(0).cast("long")
    n = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(s.groupBy(*on).agg(F.floor((F.count("*") - 1) / CELL_PART).cast("long").alias("__last")))  # a row for each cell and group
    # Queries of a crowded cell are dealt to several tasks, each of which holds the part.
    asked = cut(q.groupBy(*on).agg(F.floor((F.count("*") - 1) / QUERY_PART).cast("long").alias("__turns")))
    sizes = sizes.join(asked, on)
    left = q.join(sizes, on).withColumn("__turn", F.pmod(F.xxhash64(q_id, "__p"), F.col("__turns") + 1)).withColumn("__part", F.explode(F.sequence(zero, F.col("__last"))))
    right = s.join(sizes, on).withColumn("__part", F.pmod(F.xxhash64(s_id, "__t"), F.col("__last") + 1)).withColumn("__turn", F.explode(F.sequence(zero, F.col("__turns"))))
    key = [*on, "__part", "__turn"]
    kind = {q_id: q.schema[q_id].dataType, s_id: s.schema[s_id].dataType, **{c: q.schema[c].dataType for c in by}}
    left = left.select(*key, F.lit(True).alias("__asks"), F.col(q_id).alias("__q"), F.lit(None).cast(kind[s_id]).alias("__s"), F.col("__p").alias("__v"))
    right = right.select(*key, F.lit(False).alias("__asks"), F.lit(None).cast(kind[q_id]).alias("__q"), F.col(s_id).alias("__s"), F.col("__t").alias("__v"))
    both = left.unionByName(right).repartition(n, *key).sortWithinPartitions(*key, "__asks")
    names = [*by, q_id, s_id, "d2"]

    def run(batches):
        now, held, near = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in [*key, "__asks"]:
                column = b.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                name = tuple(b.column(c)[lo].as_py() for c in key)
                if name != now:
                    now, held, near = name, [], None
                if not b.column("__asks")[lo].as_py():
                    held.append(b.slice(lo, hi - lo))
                    continue
                if near is None:
                    if not held:
                        continue
                    near = Nearest(np.concatenate([vectors(h.column("__v")) for h in held]), [i for h in held for i in h.column("__s").to_pylist()], k)
                    held = []
                for at in range(lo, hi, TILE):
                    part = b.slice(at, min(TILE, hi - at))
                    row, d2, found = near.find(vectors(part.column("__v")))
                    part = part.take(pa.array(row))
                    ids = pa.array([near.ids[i] for i in found], b.schema.field("__s").type)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in by), part.column("__q"), ids, pa.array(d2)], names=names)

    return both.mapInArrow(run, T.StructType([*[T.StructField(c, kind[c]) for c in names[:-1]], T.StructField("d2", T.DoubleType())]))


def approximate_knn(q, s, k: int, probes: int = 8, cells: int | None = None, by=SCAN, q_id="query_id", s_id="point_id",
                    axes=XYZ, vector: str | None = None, seed: int = 1, recall: float = 0.9, sample: int = 512) -> DataFrame:
    """Inverted-file search: k-means cells learnt on s, each query looks into its nearest cells.

    ``probes`` is where the number of cells looked into starts. It is raised until a sample of queries, whose true
    neighbours are found by brute force over all of s, loses at most half of what ``recall`` allows. Queries with fewer
    than k hits look into twice as many cells, and again, until they have k or all rows of their group.
    """
    import math

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    by = list(by)
    n = s.count()
    cells = max(1, min(cells or int(1.6 * math.sqrt(n)), 65536))
    if vector:
        vec = lambda d: d.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    else:
        vec = VectorAssembler(inputCols=list(axes), outputCol="__v").transform
    point = F.array(*[F.col(a).cast("double") for a in axes]) if not vector else F.col(vector).cast("array<double>")
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    qs = q.select(*by, q_id, point.alias("__p"))
    if not n:
        return qs.join(s.select(*by, s_id).limit(0), by).select(*by, q_id, s_id, F.lit(0.0).alias("d2"), F.lit(0).alias("rank"))
    model = KMeans(k=cells, seed=seed, featuresCol="__v", predictionCol="__cell", maxIter=10).fit(vec(s))
    centres = np.array(model.clusterCenters())  # bounded: at most 65536 rows
    square = (centres * centres).sum(1)
    ss = cut(model.transform(vec(s)).select(*by, s_id, point.alias("__t"), "__cell"))

    def nearest_cells(n_probes: int):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def pick(p: pd.Series) -> pd.Series:
            out = []
            for lo in range(0, len(p), 256):  # small blocks keep the distance matrix small
                x = np.stack(p.iloc[lo: lo + 256].to_numpy()).astype(float)
                d = square[None] - 2 * x @ centres.T
                out += list(np.argpartition(d, n_probes - 1, 1)[:, :n_probes].astype("int32"))
            return pd.Series(out)
        return pick

    def learnt_probes() -> int:
        asked = qs.withColumn("__g", group).orderBy(F.xxhash64(F.lit(seed), *by, q_id)).limit(sample).select("__g", "__p").collect()
        if not asked:
            return 1
        g = np.array([r[0] for r in asked], dtype=np.int64)
        x = np.array([r[1] for r in asked], dtype=float)

        def best(batches):
            """The k nearest rows of a partition for each sampled query: query, cell, squared distance."""
            d, c = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int32)
            for b in batches:
                for lo in range(0, len(b), 512):
                    part = b.iloc[lo: lo + 512]
                    t = np.stack(part["__t"].to_numpy()).astype(float)
                    e = np.maximum((x * x).sum(1)[:, None] - 2 * x @ t.T + (t * t).sum(1)[None], 0)
                    e[g[:, None] != part["__g"].to_numpy()[None]] = np.inf
                    d = np.concatenate([d, e], 1)
                    c = np.concatenate([c, np.broadcast_to(part["__cell"].to_numpy().astype(np.int32), e.shape)], 1)
                    keep = np.argpartition(d, k - 1, 1)[:, :k]
                    d, c = np.take_along_axis(d, keep, 1), np.take_along_axis(c, keep, 1)
            at = np.nonzero(np.isfinite(d))
            yield pd.DataFrame({"i": at[0].astype(np.int32), "cell": c[at], "d": d[at]})

        near = ss.select(group.alias("__g"), "__t", "__cell").mapInPandas(best, "i int, cell int, d double")
        near = top_per_group(near, ["i"], ["d", "cell"], k).collect()  # at most sample * k rows
        if not near:
            return 1
        places = {}
        for i in {r["i"] for r in near}:
            place = np.empty(len(centres), np.int64)
            place[np.argsort(square - 2 * centres @ x[i], kind="stable")] = np.arange(1, len(centres) + 1)
            places[i] = place
        needed = np.sort([places[r["i"]][r["cell"]] for r in near])
        return int(needed[math.ceil((1 + recall) / 2 * len(needed)) - 1])

    n_probes = min(probes, len(centres))
    if n_probes < len(centres):
        n_probes = max(n_probes, learnt_probes())
    size = ss.groupBy(*by).agg(F.least(F.count("*"), F.lit(k)).alias("__want"))
    parts = []
    while True:
        probed = qs.withColumn("__cell", F.explode(nearest_cells(n_probes)("__p")))
        found = _met_in_cells(probed, ss, k, by, q_id, s_id)
        found = top_per_group(found.select(*by, q_id, s_id, "d2"), by + [q_id], [F.col("d2"), F.col(s_id)], k, rank="rank")
        if n_probes == len(centres):  # everything was looked at
            parts.append(found)
            break
        found = cut(found)
        have = found.groupBy(*by, q_id).agg(F.count("*").alias("__have"))
        short = qs.join(size, by).join(have, by + [q_id], "left").where(F.coalesce("__have", F.lit(0)) < F.col("__want"))
        short = cut(short.select(*by, q_id, "__p"))
        if short.isEmpty():
            parts.append(found)
            break
        parts.append(found.join(short.select(*by, q_id), by + [q_id], "left_anti"))
        qs, n_probes = short, min(2 * n_probes, len(centres))
    return reduce(DataFrame.unionByName, parts)


def pyramid(df: DataFrame, levels, by=SCAN, point_id="point_id") -> DataFrame:
    """Levels of (grid size, k): neighbours of each sampled point in the level below, and the
    weights that bring values back up; one table with a level and a kind column."""
    from .voxel import grid_sample

    by = list(by)
    below = df.select(*by, point_id, *XYZ, "label")
    parts = []
    for i, (size, k) in enumerate(levels, start=1):
        level = grid_sample(below, size, by=by).select(*by, point_id, *XYZ, "label")
        down = knn_join(level.withColumnRenamed(point_id, "query_id"), below, k, by, s_id=point_id)
        up = knn_join(below.withColumnRenamed(point_id, "query_id"), level, min(k, 3), by, s_id=point_id)
        up = interpolation_weights(up, by)
        parts.append(down.select(*by, F.lit(i).alias("level"), F.lit("neighbour").alias("kind"), "query_id", point_id, F.col("d2").alias("value")))
        parts.append(up.select(*by, F.lit(i).alias("level"), F.lit("weight").alias("kind"), "query_id", point_id, F.col("w").alias("value")))
        below = level
    return reduce(lambda a, b: a.unionByName(b), parts)
