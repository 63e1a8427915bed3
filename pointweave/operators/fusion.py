"""Depth frames to points, volume bounds and signed distance volumes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.prefix import number_rows
from ..functions.maths import bind, rigid_inverse
from ..functions.rand import key_hash


def _gathered(df: DataFrame, keys, cols) -> DataFrame:
    """(keys, cols as arrays): the rows of a key in a batch as one row, so that fewer and larger rows are shuffled. A key may come again."""
    keys, cols = list(keys), list(cols)
    df = df.select(*keys, *cols)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b, sort_keys=[(k, "ascending") for k in keys]))
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for k in keys:
                column = b.column(k)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            ends = pa.array(np.append(starts, b.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, b.column(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(starts)) for k in keys), *lists], names=[*keys, *cols])

    kinds = {f.name: f.dataType for f in df.schema.fields}
    shape = [T.StructField(k, kinds[k]) for k in keys] + [T.StructField(c, T.ArrayType(kinds[c])) for c in cols]
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).mapInArrow(run, T.StructType(shape))


def depth_to_points(depth: DataFrame, frames: DataFrame, z_max: float = 6.0, carry=()) -> DataFrame:
    """Pixels (seq, frame, u, v, mm) to world points; frames(seq, frame, fx, fy, cx, cy, pose).

    The frames are as many as the pictures, each with a pose, so they are not collected for a broadcast; their pixels move as arrays.
    """
    cols = list(dict.fromkeys(["u", "v", "mm", *carry]))
    near = _gathered(depth.where((F.col("mm") > 0) & (F.col("mm") < z_max * 1000)), ["seq", "frame"], cols)
    j = near.join(frames.select("seq", "frame", "fx", "fy", "cx", "cy", "pose").hint("merge"), ["seq", "frame"])
    j = j.select("seq", "frame", "fx", "fy", "cx", "cy", "pose", F.inline(F.arrays_zip(*cols)))
    z = F.col("mm") / 1000.0
    j = bind(j, __x=(F.col("u") + 0.5 - F.col("cx")) * z / F.col("fx"), __y=(F.col("v") + 0.5 - F.col("cy")) * z / F.col("fy"), __z=z)
    m = F.col("pose")
    new = [m[i][0] * F.col("__x") + m[i][1] * F.col("__y") + m[i][2] * F.col("__z") + m[i][3] for i in range(3)]
    return j.select("seq", "frame", "u", "v", *carry, *[e.alias(a) for e, a in zip(new, "xyz")])


def frame_fragments(frames: DataFrame, n: int) -> DataFrame:
    """(seq, frame, fragment): n frames in a row; an unfinished last group is left out."""
    at = number_rows(frames.select("seq", "frame"), ["seq"], "frame", "__no")  # frame numbers may have gaps
    at = at.select("seq", "frame", F.floor((F.col("__no") - 1) / n).alias("fragment"))
    full = at.groupBy("seq", "fragment").agg(F.count("*").alias("__n")).where(F.col("__n") == n).select("seq", "fragment")
    return at.join(full, ["seq", "fragment"])


def view_frustum(depth: DataFrame, frames: DataFrame, width: int, height: int, z_max: float | None = None) -> DataFrame:
    """Camera centre and the four corners at the largest depth, in world coordinates: (seq, frame, corner, x, y, z)."""
    mm = F.when(F.col("mm") > z_max * 1000, 0).otherwise(F.col("mm")) if z_max else F.col("mm")
    far = depth.groupBy("seq", "frame").agg((F.max(mm) / 1000.0).alias("__d"))
    j = frames.join(far, ["seq", "frame"])
    corners = [(0, 0, 0), (0, 0, 1), (0, height, 1), (width, 0, 1), (width, height, 1)]
    five = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit(float(u)).alias("__u"), F.lit(float(v)).alias("__v"), (F.col("__d") * s).alias("__z")) for i, (u, v, s) in enumerate(corners)])
    j = j.select("seq", "frame", "fx", "fy", "cx", "cy", "pose", F.inline(five))
    x, y, z = (F.col("__u") - F.col("cx")) * F.col("__z") / F.col("fx"), (F.col("__v") - F.col("cy")) * F.col("__z") / F.col("fy"), F.col("__z")
    m = F.col("pose")
    return j.select("seq", "frame", "corner", *[(m[i][0] * x + m[i][1] * y + m[i][2] * z + m[i][3]).alias(a) for i, a in enumerate("xyz")])


def volume_bounds(frusta: DataFrame, voxel: float, limit: int | None = None, by=("seq", "fragment")) -> DataFrame:
    """lo_a, hi_a and the number of voxels n_a per volume: quantiles 0.1 and 0.9 over its frames, trimmed to a limit if one is given."""
    per = frusta.groupBy(*by, "frame").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    b = per.groupBy(*by).agg(*[F.percentile(f"{n}_{a}", q).alias(f"{n}_{a}") for a in "xyz" for n, q in (("lo", 0.1), ("hi", 0.9))])
    for a in "xyz" if limit is not None else "":
        size = (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / voxel
        delta = F.when(size > limit, (size - limit) * voxel * 0.5).otherwise(0.0)
        b = bind(b, **{f"__d{a}": delta})
        b = b.withColumns({f"lo_{a}": F.col(f"lo_{a}") + F.col(f"__d{a}"), f"hi_{a}": F.col(f"hi_{a}") - F.col(f"__d{a}")}).drop(f"__d{a}")
    return b.withColumns({f"n_{a}": F.greatest(F.lit(0), F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / voxel)).cast("long") for a in "xyz"})


#: Voxels that one task holds at once.
CELLS = 1 << 20


def packed_depth(depth: DataFrame, width: int, height: int) -> DataFrame:
    """(seq, frame, pieces): the depths of a frame as pieces, each with places (v * width + u) and values; bounded by the picture."""
    inside = depth.where((F.col("mm") > 0) & F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    flat = inside.select("seq", "frame", (F.col("v") * width + F.col("u")).cast("int").alias("at"), F.col("mm").cast("int").alias("mm"))
    return _gathered(flat, ["seq", "frame"], ["at", "mm"]).groupBy("seq", "frame").agg(F.collect_list(F.struct("at", "mm")).alias("pieces"))


def _fuse(by, voxel: float, trunc: float, width: int, height: int, schema):
    """Arrow pass over pictures sorted by volume, part and frame, to the voxels of each part."""
    volume = [*by, "__part", "__parts", "__copies", "lo_x", "lo_y", "lo_z", "n_x", "n_y", "n_z"]
    entries = [f"__e{i}{j}" for i in range(3) for j in range(4)]

    class Part:
        def __init__(self, row):
            self.key, self.copies = [row[c] for c in by], row["__copies"]
            flat = np.arange(row["__part"], row["n_x"] * row["n_y"], row["__parts"])
            self.i, self.j = flat // row["n_y"], flat % row["n_y"]
            k = np.arange(row["n_z"])
            self.p = [(row["lo_x"] + self.i * voxel)[:, None], (row["lo_y"] + self.j * voxel)[:, None], (row["lo_z"] + k * voxel)[None]]
            self.total, self.count = np.zeros((len(flat), len(k))), np.zeros((len(flat), len(k)), np.int64)
            self.stack = max(1, CELLS // max(1, self.total.size, width * height))

        def add(self, c, at, mm, ends):
            """Pictures in the order of their frames: camera columns, and places and values from one end to the next."""
            n = len(ends) - 1
            pictures = np.zeros((n, width * height), np.int32)
            pictures[np.repeat(np.arange(n), np.diff(ends)), at[ends[0]: ends[-1]]] = mm[ends[0]: ends[-1]]
            wide = {name: v[:, None, None] for name, v in c.items()}
            p = self.p
            with np.errstate(all="ignore"):
                x, y, z = (wide[f"__e{r}0"] * p[0] + wide[f"__e{r}1"] * p[1] + wide[f"__e{r}2"] * p[2] + wide[f"__e{r}3"] for r in range(3))
                a, b = np.rint(x * wide["fx"] / z + wide["cx"]), np.rint(y * wide["fy"] / z + wide["cy"])
                ok = (z > 0) & (a >= 0) & (a < width) & (b >= 0) & (b < height)
                place = np.where(ok, b * width + a, 0).astype(np.int64) + (np.arange(n) * (width * height))[:, None, None]
                depth = pictures.ravel()[place]
                gap = depth / 1000.0 - z
                ok &= (depth > 0) & (gap >= -trunc)
                near = np.where(ok, np.minimum(1.0, gap / trunc), 0.0)
            for f in range(n):  # one by one, as the last bits of a sum depend on its order
                for _ in range(self.copies):
                    self.total += near[f]
            self.count += ok.sum(0) * self.copies

        def rows(self):
            at = np.nonzero(self.count)
            return [np.tile(v, self.copies) for v in (self.i[at[0]], self.j[at[0]], at[1], self.total[at] / self.count[at], self.count[at])]

    def ready(out):
        columns = [np.concatenate([rows[q] for _, rows in out]) for q in range(5)]
        repeat = pa.array(np.repeat(np.arange(len(out)), [len(rows[0]) for _, rows in out]))
        keys = [pa.array([key[q] for key, _ in out], schema.field(c).type).take(repeat) for q, c in enumerate(by)]
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(v) for v in columns]], schema=schema)

    def run(batches):
        now, part, out, size = None, None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in volume:
                column = b.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            heads = b.select(volume).take(pa.array(starts)).to_pylist()
            camera = {c: b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("fx", "fy", "cx", "cy", *entries)}
            pieces = b.column("pieces")
            lists = pieces.values.field("at")
            ends = lists.offsets.to_numpy()[pieces.offsets.to_numpy()]
            at, mm = lists.values.to_numpy(), pieces.values.field("mm").values.to_numpy()
            for head, lo, hi in zip(heads, starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                if head != now:
                    if part is not None:
                        out.append((part.key, part.rows()))
                        size += len(out[-1][1][0])
                    now, part = head, Part(head)
                for first in range(lo, hi, part.stack):
                    last = min(first + part.stack, hi)
                    part.add({c: v[first:last] for c, v in camera.items()}, at, mm, ends[first: last + 1])
            if size >= 10_000:
                yield ready(out)
                out, size = [], 0
        if part is not None:
            out.append((part.key, part.rows()))
            yield ready(out)

    return run


def tsdf(volumes: DataFrame, frames: DataFrame, depth: DataFrame, voxel: float, width: int, height: int, by=("seq", "fragment")) -> DataFrame:
    """(by, i, j, k, tsdf, w): mean of min(1, (depth - z)/(5 voxel)) over the frames that see the voxel.

    volumes(by, lo_x.., n_x..), frames(by, frame, fx.., pose), depth(seq, frame, u, v, mm).
    A volume is cut into parts of its columns (i, j), at most some CELLS voxels each. The packed frames of a fragment come
    to each part one after another: what moves are pictures, never voxels times frames.
    """
    by = list(by)
    n = F.col("n_x") * F.col("n_y") * F.col("n_z")
    corner, extent = [f"lo_{a}" for a in "xyz"], [f"n_{a}" for a in "xyz"]
    v = volumes.where("n_x > 0 AND n_y > 0 AND n_z > 0 AND lo_x IS NOT NULL AND lo_y IS NOT NULL AND lo_z IS NOT NULL")
    v = v.select(*by, *[F.col(c).cast("double").alias(c) for c in corner], *[F.col(c).cast("long").alias(c) for c in extent])
    v = v.groupBy(*by, *corner, *extent).agg(F.count("*").alias("__copies")).withColumn("__parts", F.ceil(n / CELLS).cast("long"))
    zero = F.lit(0).cast("long")
    e = rigid_inverse("pose")
    poses = [e[i][j].alias(f"__e{i}{j}") for i in range(3) for j in range(4)]
    camera = [F.col(c).cast("double").alias(c) for c in ("fx", "fy", "cx", "cy")]
    key = list(dict.fromkeys([*by, "seq", "frame"]))
    seen = frames.select(*key, *camera, *poses).hint("merge").join(packed_depth(depth, width, height), ["seq", "frame"])
    seen = seen.join(v.hint("merge"), by).withColumn("__part", F.explode(F.sequence(zero, F.col("__parts") - 1)))
    seen = seen.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "__part")
    seen = seen.sortWithinPartitions(*by, *corner, *extent, "__part", "frame")
    schema = T.StructType([*[T.StructField(c, v.schema[c].dataType) for c in by], *[T.StructField(c, T.LongType()) for c in "ijk"],
                           T.StructField("tsdf", T.DoubleType()), T.StructField("w", T.LongType())])
    return seen.mapInArrow(_fuse(by, voxel, 5.0 * voxel, width, height, to_arrow_schema(schema)), schema)


def surface_points(volume: DataFrame, origins: DataFrame, voxel: float, a: float, b: float, by=("seq", "fragment")) -> DataFrame:
    """Voxels with |tsdf| < a and weight > b as points. |tsdf| is compared to nine digits: it is a mean, whose last bits
    depend on the order of its sum, and voxels exactly at the threshold are common."""
    near = volume.where((F.floor(F.abs("tsdf") * 1e9 + 0.5) < F.floor(F.lit(a * 1e9 + 0.5))) & (F.col("w") > b))
    j = near.join(origins.select(*by, "lo_x", "lo_y", "lo_z"), list(by))
    return j.select(*by, "i", "j", "k", *[(F.col(c) * voxel + F.col(f"lo_{x}")).alias(x) for x, c in zip("xyz", "ijk")])


def fuse_frames(frames: DataFrame, depth: DataFrame, n: int, voxel: float, width: int, height: int, z_max: float = 6.0,
                limit: int | None = None, a: float = 0.2, b: float = 2) -> DataFrame:
    """Groups of n frames to surface points: fragments, bounds, volume, surface, with far depths cut."""
    depth = depth.where(F.col("mm") <= z_max * 1000)
    groups = frame_fragments(frames, n)
    members = frames.join(groups, ["seq", "frame"])
    frusta = view_frustum(depth, frames, width, height, z_max).join(groups, ["seq", "frame"])
    bounds = volume_bounds(frusta, voxel, limit)
    return surface_points(tsdf(bounds, members, depth, voxel, width, height), bounds, voxel, a, b)
