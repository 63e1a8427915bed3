"""Which point is seen at which pixel of which image."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.lineage import cut
from .camera import boxes_of, camera_columns, in_view, pixels_of, prepare_images
from .neighbours import _cells, _cover, _parted, nearest_join, radius_join

SCAN = ("scan_id",)
# Rows of a block of points, and of a block of images, that meet at once.
POINT_BLOCK, IMAGE_BLOCK = 8192, 8
# Images that go to a block of points together, images of a group that points go to, and pixels of the images that a task paints at once.
IMAGES, IMAGE_GROUP, PIXELS = 32, 1024, 1 << 22
FEATURES = ("depth", "linearity", "planarity", "scattering", "orientation", "height")
CAMERA = ("camera", "px_w", "px_h", "cx", "cy", "cz", "fx", "fy", "mx", "my", "xi", "k1", "k2", "gamma1", "gamma2", "u0", "v0",
          *[f"m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)], "t1", "t2", "t3")


def candidate_views(points: DataFrame, images: DataFrame, r_max: float, r_min: float = 0.0, cylinder=False, by=SCAN,
                    carry=(), q_carry=(), cell: float | None = None) -> DataFrame:
    """Points strictly between r_min and r_max of a camera (xy only for the cylinder form)."""
    axes = ("x", "y") if cylinder else ("x", "y", "z")
    cams = images.select(*by, "image_id", *q_carry, *[F.col(f"c{a}").alias(a) for a in axes])
    out = radius_join(cams, points, r_max, by, "image_id", "point_id", axes, carry=carry, q_carry=q_carry,
                      size=cell or r_max / 2, strict=True)
    return out.where(F.col("d2") > r_min * r_min)


def _unpack(column: pa.ListArray, row: int) -> pa.StructArray:
    return column.values.slice(column.offsets[row].as_py(), column.offsets[row + 1].as_py() - column.offsets[row].as_py())


def _pairs(keys, axes, near, far, needs, carried, pose, inside, splat, schema):
    """Rows of images, of points that meet the images before them, or of both: the distances of all, then the camera formulas of those in reach."""
    def met(batch, row, cams, code, kinds, pts):
        side = {True: cams, False: pts}
        place = {n: np.asarray(pts.field(n).to_numpy(zero_copy_only=False), dtype=float) for n in "xyz"}
        d2 = 0.0
        for a in axes:
            gap = np.asarray(cams.field(f"c{a}").to_numpy(zero_copy_only=False), dtype=float)[:, None] - place[a][None]
            d2 = d2 + gap * gap
        i, j = np.nonzero((d2 < far * far) & (d2 > near * near))
        if not len(i):
            return None
        c = {n: cams.field(n).to_numpy(zero_copy_only=False)[i] for n in needs if n != "camera"} | {n: v[j] for n, v in place.items()}
        c["camera"] = code[i]
        c["u"], c["v"], c["depth_z"], c["dist"] = pixels_of(c, pose, kinds)
        d2 = d2[i, j]
        if inside is not None:
            top, bottom = inside
            with np.errstate(invalid="ignore"):
                at = np.flatnonzero((c["u"] >= 0) & (c["u"] < c["px_w"]) & (c["v"] >= top) & (c["v"] < c["px_h"] - bottom) & (c["depth_z"] > 0))
            c, i, j, d2 = {n: v[at] for n, v in c.items()}, i[at], j[at], d2[at]
        if not len(i):
            return None
        out = {k: pa.repeat(batch.column(k)[row], len(i)) for k in keys}
        out["image_id"], out["point_id"], out["d2"] = cams.field("image_id").take(pa.array(i)), pts.field("point_id").take(pa.array(j)), pa.array(d2)
        for n, of_image in carried:
            out[n] = side[of_image].field(n).take(pa.array(i if of_image else j))
        out |= {n: pa.array(c[n], from_pandas=True) for n in ("u", "v", "depth_z", "dist")}  # no pixel: null
        if splat is not None:
            out |= {n: pa.array(v) for n, v in zip(("xa", "xb", "ya", "yb"), boxes_of(c, *splat, kinds))}
        return pa.RecordBatch.from_arrays([out[n] for n in schema], names=list(schema))

    def run(batches):
        cams = place = None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("__images")[row].is_valid:
                    cams = pa.concat_arrays([_unpack(batch.column("__images"), row)])  # of its own, without the batch
                    code, kinds = pd.factorize(cams.field("camera").to_numpy(zero_copy_only=False))
                    place = [np.asarray(cams.field(f"c{a}").to_numpy(zero_copy_only=False), dtype=float) for a in axes]
                if not batch.column("__points")[row].is_valid:
                    continue
                pts = _unpack(batch.column("__points"), row)
                gap = 0.0
                for a, at in zip(axes, place):  # images that the block lies beyond the reach of
                    v = np.asarray(pts.field(a).to_numpy(zero_copy_only=False), dtype=float)
                    gap = gap + np.maximum(np.maximum(np.fmin.reduce(v) - at, at - np.fmax.reduce(v)), 0) ** 2
                some = np.flatnonzero(gap <= far * far * (1 + 1e-9))
                for lo in range(0, len(some), IMAGE_BLOCK):
                    here = some[lo: lo + IMAGE_BLOCK]
                    out = met(batch, row, cams.take(pa.array(here)), code[here], list(kinds), pts)
                    if out is not None:
                        yield out
    return run


def _images_to_points(points, cams, by, axes, own, theirs, on, size, r_max) -> DataFrame:
    """A row for each block of points and each block of images in reach of its cell."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _cover(cams.select(*by, "image_id", *own, *[F.col(f"c{a}").alias(f"__q{a}") for a in axes]), axes, size, r_max, "__q")
    n_blocks = F.floor((F.count("*").over(W.partitionBy(*on)) - 1) / IMAGES).cast("long") + 1
    left = left.withColumn("__block", F.pmod(F.xxhash64("image_id"), n_blocks))
    left, right = _parted(left, points, on, F.xxhash64("point_id", *axes), POINT_BLOCK)
    on = [*on, "__part"]
    left = left.repartition(n, *on).groupBy(*on, "__block").agg(F.collect_list(F.struct("image_id", *own)).alias("__images"))
    right = right.repartition(n, *on).groupBy(*on).agg(F.collect_list(F.struct("point_id", *theirs)).alias("__points"))
    return left.hint("merge").join(right, on).select(*by, "__images", "__points")


def _points_to_groups(points, cams, by, axes, own, theirs, on, size, r_max) -> DataFrame:
    """A row for each group of near images, followed in its partition by a row for each block of points that it has in reach."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    area = F.max(F.col("px_w").cast("long") * F.col("px_h")) if {"px_w", "px_h"} <= set(cams.columns) else F.lit(None)
    n_images, area = cams.agg(F.count("*"), area).first()
    # The images of a group are painted at once; more groups than tasks need would only repeat the points.
    per = max(1, min(IMAGE_GROUP, PIXELS // max(1, int(area or 1)), -(-n_images // (2 * n))))
    splits = max(1, -(-n * per // max(1, n_images)))
    at = [F.floor(F.col(f"c{a}") / r_max).cast("long").alias(f"__g{a}") for a in axes]
    group = [*by, *[f"__g{a}" for a in axes], "__block"]
    cams = cams.select(*by, "image_id", *own, *at)
    n_blocks = F.floor((F.count("*").over(W.partitionBy(*group[:-1])) - 1) / per).cast("long") + 1
    cams = cams.withColumn("__block", F.pmod(F.xxhash64("image_id"), n_blocks))
    left = _cover(cams.select(*group, *[F.col(f"c{a}").alias(f"__q{a}") for a in axes]), axes, size, r_max, "__q").select(*group, *on[len(by):]).distinct()
    left, right = _parted(left, points, on, F.xxhash64("point_id", *axes), POINT_BLOCK)
    on = [*on, "__part"]
    right = right.repartition(n, *on).groupBy(*on).agg(F.collect_list(F.struct("point_id", *theirs)).alias("__points"))
    split = F.pmod(F.xxhash64(*on), F.lit(splits))
    right = left.repartition(n, *on).hint("merge").join(right, on).select(*group, split.alias("__split"), "__points")
    left = cams.groupBy(*group).agg(F.collect_list(F.struct("image_id", *own)).alias("__images"))
    left = left.withColumn("__split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))
    both = left.withColumn("__points", F.lit(None).cast(right.schema["__points"].dataType)).unionByName(
        right.withColumn("__images", F.lit(None).cast(left.schema["__images"].dataType)))
    both = both.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group)).withColumn("__later", F.col("__images").isNull())
    group = [*group, "__split"]
    return both.repartition(n, *group).sortWithinPartitions(*group, "__later").select(*by, "__images", "__points")


def projected_views(points: DataFrame, cams: DataFrame, r_max: float, r_min: float = 0.0, cylinder=False, by=SCAN, carry=(), cell: float | None = None,
                    pose="c2w", inside: tuple[int, int] | None = None, splat: tuple | None = None, keep=None, together=False) -> DataFrame:
    """``project`` of the ``candidate_views``: (by, image_id, point_id, d2, carried columns, u, v, depth_z, dist).

    The pairs are by far the most rows, and a camera has some thirty columns. So not pairs are joined but blocks: a cell's
    points and the images in reach of it, as rows of arrays, which numpy pairs. Images are far fewer than points, so they go
    to the points. With ``together`` the points go to groups of near images, so that the views of an image are made in one
    task, or a few if there are few images, and ``z_buffer`` can paint them before they move. With ``inside`` (top, bottom)
    only views in the field of view come out, with ``splat`` (voxel, k, d, top, bottom) they have their box. ``keep`` names
    the carried columns that come out, all if None.
    """
    by, axes = list(by), ("x", "y") if cylinder else ("x", "y", "z")
    needs = camera_columns(cams, pose)
    own = [c for c in CAMERA if c in cams.columns] + (["setting_id"] if "setting_id" in cams.columns else [])
    own = list(dict.fromkeys([*own, *needs]))
    theirs = list(dict.fromkeys(["x", "y", "z", *carry]))
    on = by + [f"__c{a}" for a in axes]
    size = float(cell or r_max / 2)
    meet = _points_to_groups if together else _images_to_points
    blocks = meet(points.select(*by, "point_id", *theirs, *_cells(axes, size)), cams, by, axes, own, theirs, on, size, float(r_max))
    carried = [(c, True) for c in own] + [(c, False) for c in theirs if c not in own]
    if keep is not None:
        carried = [(c, of_image) for c, of_image in carried if c in keep]
    kinds = {f.name: f.dataType for f in [*points.schema.fields, *cams.schema.fields]}
    schema = {**{k: kinds[k] for k in [*by, "image_id", "point_id"]}, "d2": T.DoubleType(), **{c: kinds[c] for c, _ in carried},
              **{c: T.DoubleType() for c in ("u", "v", "depth_z", "dist")}}
    if splat is not None:
        schema |= {c: T.LongType() for c in ("xa", "xb", "ya", "yb")}
    run = _pairs(by, axes, float(r_min), float(r_max), needs, carried, pose, inside, splat, list(schema))
    return blocks.mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in schema.items()]))


class _Canvas:
    """An image as it is painted: the distance of the nearest view so far at each pixel, and that view's row."""

    def __init__(self):
        self.dist, self.top, self.rows, self.settled = np.zeros((0, 0)), np.zeros((0, 0), np.int32), None, 0

    @staticmethod
    def _order(rows: pa.Table, i: int, cols):
        """What decides between views of equal distance; nulls last."""
        values = [rows.column(c)[i].as_py() for c in cols]
        return [(v is None or v != v, v) for v in values]

    def add(self, rows: pa.RecordBatch, dist: np.ndarray, box: np.ndarray, cols) -> None:
        grow = [max(int(box[:, e].max()) - size, 0) for e, size in zip((1, 3), self.top.shape)]
        if any(grow):
            self.dist = np.pad(self.dist, [(0, g) for g in grow], constant_values=np.inf)
            self.top = np.pad(self.top, [(0, g) for g in grow], constant_values=-1)
        x0, y0 = int(box[:, 0].min()), int(box[:, 2].min())
        part = slice(x0, int(box[:, 1].max())), slice(y0, int(box[:, 3].max()))
        order = np.argsort(dist, kind="stable")
        if (dist[order[1:]] == dist[order[:-1]]).any():
            values = [rows.column(c).to_numpy(zero_copy_only=False) for c in cols]
            if any(v.dtype == object for v in values):
                order = rows.select(cols).to_pandas().sort_values(cols, kind="stable").index.to_numpy()
            else:
                order = np.lexsort(values[::-1])
        new = np.full(self.top[part].shape, -1, np.int32)
        far = order[::-1]
        for at, (xa, xb, ya, yb) in zip(far.tolist(), (box[far] - [x0, x0, y0, y0]).tolist()):
            new[xa:xb, ya:yb] = at  # from far to near: the nearest stays on top
        old, top = self.dist[part], self.top[part]
        there = np.append(dist, np.inf)[new]
        nearer = (new >= 0) & ((top < 0) | (there < old))
        first = 0 if self.rows is None else self.rows.num_rows
        tied = (new >= 0) & (top >= 0) & (there == old)
        self.rows = pa.Table.from_batches([rows]) if self.rows is None else pa.concat_tables([self.rows, pa.Table.from_batches([rows])])
        if tied.any():
            pairs, where = np.unique(np.stack([new[tied], top[tied]], 1), axis=0, return_inverse=True)
            before = [self._order(self.rows, first + int(i), cols[1:]) < self._order(self.rows, int(j), cols[1:]) for i, j in pairs]
            nearer[tied] = np.array(before)[where.ravel()]
        self.dist[part] = np.where(nearer, there, old)
        self.top[part] = np.where(nearer, new + first, top)
        if self.rows.num_rows > 4096 + 2 * self.settled:
            self.settle()

    def settle(self) -> pa.Table:
        """The rows that are seen somewhere; the others are forgotten."""
        used = np.flatnonzero(np.bincount(self.top[self.top >= 0], minlength=self.rows.num_rows))
        if len(used) < self.rows.num_rows:
            number = np.full(self.rows.num_rows + 1, -1, np.int32)
            number[used] = np.arange(len(used))
            self.top, self.rows = number[self.top], self.rows.take(pa.array(used))
        self.rows, self.settled = self.rows.combine_chunks(), self.rows.num_rows
        return self.rows


def _painted(keys, cols, last: bool):
    """Views painted over what is seen so far of their image, batch by batch.

    Without ``last`` out come the views that are seen somewhere, of the images at hand; an image that gives way to others
    starts anew if more of it comes. With ``last`` batches are sorted by image, and out come the pixels.
    """
    def finish(canvas):
        rows = canvas.settle()
        if not last:
            return rows
        x, y = np.nonzero(canvas.top >= 0)
        rows = rows.take(pa.array(canvas.top[x, y]))
        out = {k: rows.column(k) for k in keys} | {"px": pa.array(x), "py": pa.array(y)} | {c: rows.column(c) for c in cols}
        return pa.table(out)

    def run(batches):
        open_, pixels = {}, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                d = b.column(k).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            dist = np.asarray(b.column("dist").to_numpy(zero_copy_only=False), dtype=float)
            dist = np.where(np.isnan(dist), np.inf, dist)
            box = np.stack([b.column(c).to_numpy() for c in ("xa", "xb", "ya", "yb")], 1)
            end = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            for rows in np.split(order, starts[1:]):
                key = tuple(b.column(k)[int(rows[0])].as_py() for k in keys)
                canvas = open_.pop(key, None) or _Canvas()
                pixels -= canvas.top.size
                canvas.add(b.take(pa.array(rows)), dist[rows], box[rows], cols)
                pixels += canvas.top.size
                open_[key] = canvas
            for key in [k for k in open_ if k != end]:
                if last or pixels > PIXELS:
                    canvas = open_.pop(key)
                    pixels -= canvas.top.size
                    yield from finish(canvas).to_batches()
        for canvas in open_.values():
            yield from finish(canvas).to_batches()
    return run


def z_buffer(df: DataFrame, keys=("scan_id", "image_id"), exact: bool = False, carry=()) -> DataFrame:
    """(keys, px, py, point_id, carry): the nearest point per pixel, equal distance to the lowest id.

    Unfolding the boxes would make by far the most rows, and even the views are too many to move. So each task paints the
    views it has of an image, in memory for the pixels of the images at hand, and only views that are seen somewhere are
    brought together by image, which is painted again. With ``exact`` a seen point holds only the pixel it projects to, and
    of several the highest id.
    """
    keys, carry = list(keys), list(carry)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col("u").cast("long").alias("__u"), F.col("v").cast("long").alias("__v")] if exact else []
    narrow = df.select(*keys, "point_id", "dist", "xa", "xb", "ya", "yb", *carry, *own).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    cols = ["dist", "point_id", *carry, *(["__u", "__v"] if exact else [])]
    front = narrow.mapInArrow(_painted(keys, cols, False), narrow.schema)
    kinds = {f.name: f.dataType for f in narrow.schema.fields}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in [*keys, "px", "py", *cols]])
    near = front.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_painted(keys, cols, True), schema)
    if not exact:
        return near.select(*keys, "px", "py", "point_id", *carry)
    seen = near.select(*keys, F.col("__u").alias("px"), F.col("__v").alias("py"), "point_id", *carry)
    last = seen.groupBy(*keys, "px", "py").agg(F.max(F.struct("point_id", *carry)).alias("__m"))
    return last.select(*keys, "px", "py", "__m.*")


def visible_by_depth(df: DataFrame, depth: DataFrame, threshold: float) -> DataFrame:
    """Points whose distance agrees with the depth raster (image_id, px, py, depth) at their pixel."""
    at = df.withColumns({"px": F.col("u").cast("long"), "py": F.col("v").cast("long")})
    d = depth.select("image_id", "px", "py", "depth")
    return at.join(d, ["image_id", "px", "py"]).where(F.abs(F.col("depth") - F.col("dist")) <= threshold)


def depth_from_raster(pixels: DataFrame, scale: float = 512.0) -> DataFrame:
    """16-bit raster to metres; 65535 is missing and becomes -1."""
    return pixels.select("image_id", "px", "py", F.when(F.col("raw") == 65535, F.lit(-1.0)).otherwise(F.col("raw") / scale).alias("depth"))


def visible_by_knn(df: DataFrame, k: int = 75, margin: float | None = None, threshold: float | None = None, keys=("scan_id", "image_id")) -> DataFrame:
    """Points near the front among their k neighbours in the image plane; the seam is bridged by a margin."""
    keys = list(keys)
    # Read several times below, so the projected points are written once.
    plane = cut(df.select(*keys, "point_id", "u", "v", "dist", "px_w"))
    wrapped = plane.withColumn("copy", F.lit(0))
    if margin:
        w = F.col("px_w").cast("double")
        left = plane.where(F.col("u") < margin).withColumns({"u": F.col("u") + w, "copy": F.lit(1)})
        right = plane.where(F.col("u") >= w - margin).withColumns({"u": F.col("u") - w, "copy": F.lit(2)})
        wrapped = wrapped.unionByName(left).unionByName(right)
    wrapped = wrapped.withColumn("slot", F.col("point_id") * 3 + F.col("copy"))
    near = nearest_join(plane.withColumnRenamed("point_id", "query_id"), wrapped, k, by=keys, s_id="slot", axes=("u", "v"))
    d = near.join(wrapped.select(*keys, "slot", F.col("dist").alias("dn")), keys + ["slot"])
    span = d.groupBy(*keys, "query_id").agg(F.min("dn").alias("lo"), F.max("dn").alias("hi"))
    own = plane.withColumnRenamed("point_id", "query_id").join(span, keys + ["query_id"])
    t = (F.col("dist") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    own = own.withColumn("alpha", F.coalesce(F.exp(-(t * t)), F.lit(1.0)))
    if threshold is None:
        mean = own.groupBy(*keys).agg(F.avg("alpha").alias("limit"))
        own = own.join(mean, keys)
    else:
        own = own.withColumn("limit", F.lit(float(threshold)))
    return own.where(F.col("alpha") >= F.col("limit")).select(*keys, F.col("query_id").alias("point_id"), "alpha")


def view_features(df: DataFrame, r_min: float, r_max: float) -> DataFrame:
    """depth, height and, where the columns exist, linearity, planarity, scattering and orientation."""
    cols = {"depth": (F.col("dist") - r_min) / (r_max + 1e-4), "height": F.col("v") / F.col("px_h")}
    if {"nx", "ny", "nz"} <= set(df.columns):
        ray = [(F.col(a) - F.col(f"c{a}")) / (F.col("dist") + 1e-4) for a in "xyz"]
        cols["orientation"] = F.abs(ray[0] * F.col("nx") + ray[1] * F.col("ny") + ray[2] * F.col("nz"))
    return df.withColumns(cols)


def project_views(points: DataFrame, images: DataFrame, r_max: float, r_min: float = 0.0, cylinder=False, masks=None,
                  top=0, bottom=0, voxel=0.02, k_swell=1.0, d_swell=1000.0, pose="c2w", by=SCAN, carry=(), cell=None, keep=None, together=False) -> DataFrame:
    """Candidates, projection, field of view and splat box, camera model by camera model; ``together`` if they are painted next."""
    seen = projected_views(points, prepare_images(images), r_max, r_min, cylinder, by, carry, cell, pose, (top, bottom),
                           (float(voxel), float(k_swell), float(d_swell), top, bottom), keep if masks is None else None, together)
    return seen if masks is None else in_view(seen, masks, top, bottom)


def map_images(points: DataFrame, images: DataFrame, method: str = "splat", r_max: float = 8.0, r_min: float = 0.5,
               exact=False, upscale: int = 1, downscale: int = 1, crop=None, depth: DataFrame | None = None,
               threshold: float = 0.05, k: int = 75, margin: float | None = None, knn_threshold=None, masks=None, by=SCAN, carry=(), **params) -> DataFrame:
    """The mapping: one row per (scan, image, point, px, py) with the view features.

    ``crop`` is (off_x, off_y, width, height) in pixels after the upscale
    factor is taken out. Images that see nothing are absent.
    """
    keep = ("px_w", "px_h", "x", "y", "z", "cx", "cy", "cz", *carry)
    seen = project_views(points, images, r_max, r_min, masks=masks, by=by, carry=carry, **{"keep": keep, "together": method == "splat", **params})
    seen = view_features(seen, r_min, r_max)
    names = [c for c in FEATURES if c in seen.columns]
    keys = [*by, "image_id"]
    at = [F.col("u").cast("long").alias("px"), F.col("v").cast("long").alias("py")]
    if method == "splat":
        pixels = z_buffer(seen, keys, exact, names)
    elif method == "depth":
        pixels = visible_by_depth(seen, depth, threshold).select(*keys, "px", "py", "point_id", *names)
    elif method == "knn":
        flat = visible_by_knn(seen, k, margin, knn_threshold, keys)
        pixels = seen.select(*keys, "point_id", *names, *at).join(flat.select(*keys, "point_id"), keys + ["point_id"], "left_semi")
    else:
        raise ValueError(f"unknown visibility method {method!r}")
    return finish_mapping(pixels, names, upscale, downscale, crop, by)


def finish_mapping(pixels, names, upscale=1, downscale=1, crop=None, by=SCAN) -> DataFrame:
    """Pixels without the upscale factor, inside the crop, divided by the downscale; one row per (point, pixel)."""
    keys = [*by, "image_id"]
    pixels = pixels.withColumns({c: F.floor(F.col(c) / upscale) for c in ("px", "py")})
    if crop is not None:
        ox, oy, w, h = crop
        pixels = pixels.withColumns({"px": F.col("px") - ox, "py": F.col("py") - oy})
        pixels = pixels.where((F.col("px") >= 0) & (F.col("px") < w) & (F.col("py") >= 0) & (F.col("py") < h))
    pixels = pixels.withColumns({c: F.floor(F.col(c) / downscale) for c in ("px", "py")})
    pixels = pixels.select(*keys, "point_id", "px", "py", *names)
    # The features belong to the view, so the copies that the division makes are equal rows.
    return pixels.dropDuplicates([*keys, "point_id", "px", "py"]) if upscale * downscale > 1 else pixels


def number_images(maps: DataFrame, images: DataFrame, by=SCAN) -> DataFrame:
    """Images present in the mapping with their new number per scan."""
    seen = images.join(maps.select(*by, "image_id").distinct(), [*by, "image_id"], "left_semi")
    return seen.withColumn("image_no", F.row_number().over(W.partitionBy(*by).orderBy("image_id")).cast("long") - 1)


def reference_pixels(pixels: DataFrame, channels=("r", "g", "b"), on=("setting_id",)) -> DataFrame:
    """The pixels of the image with the lowest id, per setting. Ids are aggregated alone, which needs no sort."""
    at = [*on, "px", "py"]
    first = pixels.groupBy(*at).agg(F.min("image_id").alias("image_id"))
    return pixels.join(first, [*at, "image_id"]).select(*at, *channels).dropDuplicates(at)


def non_static_mask(pixels: DataFrame, reference: DataFrame, channels=("r", "g", "b"), on=("setting_id",)) -> DataFrame:
    """Usable pixels: in some image all channels differ from the reference image; with fewer than two images all are."""
    ref = reference.select(*on, "px", "py", *[F.col(c).alias(f"__{c}") for c in channels])
    differ = reduce(lambda a, b: a & b, [F.col(c) != F.col(f"__{c}") for c in channels])
    per = pixels.join(ref, [*on, "px", "py"]).groupBy(*on, "px", "py").agg(
        F.bool_or(differ).alias("usable"), F.count("*").alias("__n"))
    return per.select(*on, "px", "py", (F.col("usable") | (F.col("__n") < 2)).alias("usable"))


def render(maps: DataFrame, points: DataFrame, by=SCAN, colours=("r", "g", "b")) -> DataFrame:
    """Pixels take the colour of the mapped point; of several points the highest id."""
    last = maps.groupBy(*by, "image_id", "px", "py").agg(F.max("point_id").alias("point_id"))
    return last.join(points.select(*by, "point_id", *colours), [*by, "point_id"])
