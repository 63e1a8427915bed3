"""Camera models as column expressions: rotation, projection, splat size, intrinsics.

A table of (point, image) rows carries the point as x, y, z, the camera
position as cx, cy, cz and the camera's own columns. Rotations are column
expressions on the image table; the long projection formulas run on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.maths import rigid_inverse

# The guards of the projection formulas.
FISHEYE_EPS = 1e-4
POLE_EPS = 0.001


def opk_rotation(omega, phi, kappa) -> list[list[Column]]:
    """Rows of Ro (Rp Rk) for angles about x, y and z."""
    co, so, cp, sp, ck, sk = F.cos(omega), F.sin(omega), F.cos(phi), F.sin(phi), F.cos(kappa), F.sin(kappa)
    # Rp Rk
    a = [[cp * ck, -(cp * sk), sp], [sk, ck, F.lit(0.0)], [-(sp * ck), sp * sk, cp]]
    return [a[0],
            [co * a[1][j] - so * a[2][j] for j in range(3)],
            [so * a[1][j] + co * a[2][j] for j in range(3)]]


def prepare_images(images: DataFrame, pose_kind: str = "c2w") -> DataFrame:
    """Add the nine numbers m11..m33 and the shift t1..t3 that take a point to the camera frame.

    Computed once per image, never per point. ``pose_kind`` 'c2w' reads a pose
    from camera to world (p = Rt (x - T)), 'inv' the inverse of the 4x4 pose.
    """
    rot = opk_rotation(F.col("omega"), F.col("phi"), F.col("kappa"))
    panorama = F.col("camera") == "equirectangular"
    has_pose = "pose" in images.columns
    inv = rigid_inverse("pose") if has_pose else None
    cols = {}
    for i in range(3):
        for j in range(3):
            cols[f"m{i+1}{j+1}"] = F.when(panorama, rot[i][j]).otherwise(F.col("pose")[j][i]) if has_pose else rot[i][j]
        if has_pose:
            cols[f"t{i+1}"] = inv[i][3]
    out = images.withColumns(cols)
    if has_pose and pose_kind == "c2w":
        return out
    return out if has_pose else out.withColumns({f"t{i}": F.lit(0.0) for i in (1, 2, 3)})


def offset_to_camera() -> list[Column]:
    return [F.col(a) - F.col(f"c{a}") for a in "xyz"]


def _doubles(*names):
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _turn(c, v) -> list[np.ndarray]:
    return [c[f"m{i}1"] * v[0] + c[f"m{i}2"] * v[1] + c[f"m{i}3"] * v[2] for i in (1, 2, 3)]


def _length(v) -> np.ndarray:
    return np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def equirectangular_pixel(c, p, r):
    w, h = c["px_w"].astype(float), c["px_h"].astype(float)
    u = np.mod((w - 1) * (1 - np.arctan2(p[1], p[0]) / math.pi) / 2, w)
    v = np.mod((h - 1) * np.arccos(np.clip(p[2] / r, -1.0, 1.0)) / math.pi, h)
    return np.nan_to_num(u), np.nan_to_num(v), r


def pinhole_pixel(c, p):
    """A point in the camera plane has no pixel."""
    depth = np.where(p[2] == 0, np.nan, p[2])
    return p[0] * c["fx"] / depth + c["mx"], p[1] * c["fy"] / depth + c["my"], p[2]


def fisheye_pixel(c, p):
    """Unit sphere shifted by xi, radial k1 and k2, then gamma and centre."""
    n = _length(p)
    down = p[2] / (n + FISHEYE_EPS) + c["xi"]
    x, y = p[0] / (n + FISHEYE_EPS) / down, p[1] / (n + FISHEYE_EPS) / down
    r2 = x * x + y * y
    radial = 1 + c["k1"] * r2 + c["k2"] * (r2 * r2)
    return (c["gamma1"] * radial * x + c["u0"], c["gamma2"] * radial * y + c["v0"],
            n * p[2] / np.abs(p[2] + FISHEYE_EPS))


# The camera formulas are long: as generated code they outgrow what the JIT compiles, so
# Arrow batches go through numpy instead, one call per batch of views. Columns are arrays by name.
def _some(c: dict, at) -> dict:
    return {n: v[at] for n, v in c.items()}


def pixels_of(c: dict, pose: str, kinds: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, depth_z and dist of views. The camera column names the model or, with ``kinds``, is its place there."""
    xyz = [c[a] for a in "xyz"]
    d = [q - c[f"c{a}"] for q, a in zip(xyz, "xyz")]
    dist = _length(d)
    code, kinds = (c["camera"], kinds) if kinds is not None else pd.factorize(c["camera"])
    out = np.full((3, len(dist)), np.nan)
    with np.errstate(all="ignore"):
        for number, camera in enumerate(kinds):
            at = np.flatnonzero(code == number)
            if not len(at):
                continue
            part = _some(c, at)
            p = _turn(part, [q[at] for q in d])
            if camera == "equirectangular":
                model = equirectangular_pixel(part, p, dist[at])
            elif camera == "fisheye":
                model = fisheye_pixel(part, p)
            elif pose == "inv":
                p = [q + part[f"t{i + 1}"] for i, q in enumerate(_turn(part, [q[at] for q in xyz]))]
                model = pinhole_pixel(part, p)
            else:
                model = pinhole_pixel(part, p)
            out[:, at] = model
    return out[0], out[1], out[2], dist


def _arrays(c: pd.DataFrame) -> dict:
    return {n: c[n].to_numpy() for n in c.columns}


def _pixel_udf(pose: str):
    @F.pandas_udf(_doubles("u", "v", "depth_z", "dist"))
    def pixels(c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("u", "v", "depth_z", "dist"), pixels_of(_arrays(c), pose))))
    # Not repeated by the optimizer: a filter on its result must not run it twice.
    return pixels.asNondeterministic()


XYZ = ("x", "y", "z")
_CAMERA_COLUMNS = ("camera", "px_w", "px_h", "x", "y", "z", "cx", "cy", "cz", *[f"m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)],
                   "fx", "fy", "mx", "my", "xi", "k1", "k2", "gamma1", "gamma2", "u0", "v0")


def camera_columns(df: DataFrame, pose: str = "c2w") -> list[str]:
    """The columns of the cameras, without the point's, that the formulas read."""
    extra = [f"t{i}" for i in (1, 2, 3)] if pose == "inv" else []
    return [c for c in (*_CAMERA_COLUMNS, *extra) if c in df.columns and c not in XYZ]


def project(df: DataFrame, pose: str = "c2w") -> DataFrame:
    """Add fractional pixel u, v, the depth along the view axis and the distance to the camera.

    The row's camera column picks the model. For pinhole cameras ``pose`` 'c2w'
    is p = Rt (x - T), 'inv' is p = E^-1 x with the precomputed inverse.
    """
    extra = [f"t{i}" for i in (1, 2, 3)] if pose == "inv" else []
    have = [c for c in (*_CAMERA_COLUMNS, *extra) if c in df.columns]
    return df.withColumn("__p", _pixel_udf(pose)(F.struct(*have))).select("*", "__p.*").drop("__p")


def in_view(df: DataFrame, masks: DataFrame | None = None, top: int = 0, bottom: int = 0, on=("setting_id",)) -> DataFrame:
    """0 <= u < W, top <= v < H - bottom, depth > 0, and the static mask true at the floor pixel."""
    inside = ((F.col("u") >= 0) & (F.col("u") < F.col("px_w")) & (F.col("v") >= top)
              & (F.col("v") < F.col("px_h") - bottom) & (F.col("depth_z") > 0))
    out = df.where(inside)
    if masks is None:
        return out
    m = masks.select(*on, F.col("px").alias("__mx"), F.col("py").alias("__my"))
    out = out.withColumns({"__mx": F.floor("u"), "__my": F.floor("v")})
    return out.join(m, [*on, "__mx", "__my"], "left_semi").drop("__mx", "__my")


def boxes_of(c: dict, voxel: float, k: float, d: float, top: int, bottom: int, kinds: list | None = None) -> list[np.ndarray]:
    """xa, xb, ya and yb of views with their u, v and dist; ``kinds`` as in ``pixels_of``."""
    u, v, dist = (c[n] for n in ("u", "v", "dist"))
    of = lambda camera: c["camera"] == (camera if kinds is None else kinds.index(camera) if camera in kinds else len(kinds))
    w, h = c["px_w"].astype(float), c["px_h"].astype(float)
    with np.errstate(all="ignore"):
        angle = (1 + k * np.exp(-dist / math.log(d))) * voxel / dist
        pan = of("equirectangular")
        wx = np.where(pan, angle * w / (2 * math.pi) / (np.sin(math.pi / h * v) + POLE_EPS), angle * c["fx"] if "fx" in c else 0.0)
        wy = np.where(pan, angle * h / math.pi, angle * c["fy"] if "fy" in c else 0.0)
        fish = of("fisheye")
        if fish.any():
            # Twice the pixel distance to the lifted voxel top. The length in its
            # swell is that of the point itself, not of its offset to the camera.
            f = _some(c, fish)
            xyz = [f[a] for a in "xyz"]
            lift = (1 + k * np.exp(-_length(xyz) / math.log(d))) * voxel / 2
            off = [xyz[0] - f["cx"], xyz[1] - f["cy"], xyz[2] + lift - f["cz"]]
            u2, v2, _ = fisheye_pixel(f, _turn(f, off))
            wx[fish] = wy[fish] = 2 * np.sqrt((u[fish] - u2) ** 2 + (v[fish] - v2) ** 2)
        box = lambda e, lo, hi: np.clip(np.rint(np.nan_to_num(e)), lo, hi).astype("int64")
        return [box(u - wx / 2, 0, w - 1), box(u + wx / 2 + 1, 1, w),
                box(v - wy / 2, top, h - bottom - 1), box(v + wy / 2 + 1, top + 1, h - bottom)]


def _splat_udf(voxel: float, k: float, d: float, top: int, bottom: int):
    @F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("xa", "xb", "ya", "yb")]))
    def boxes(c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("xa", "xb", "ya", "yb"), boxes_of(_arrays(c), voxel, k, d, top, bottom))))
    return boxes.asNondeterministic()


def splat_box(df: DataFrame, voxel: float = 0.02, k: float = 1.0, d: float = 1000.0, top=0, bottom=0) -> DataFrame:
    """Pixel box xa <= px < xb, ya <= py < yb that a point covers, from its angular size."""
    have = [c for c in (*_CAMERA_COLUMNS, "u", "v", "dist") if c in df.columns]
    return df.withColumn("__b", _splat_udf(float(voxel), float(k), float(d), top, bottom)(F.struct(*have))).select("*", "__b.*").drop("__b")


def adjust_intrinsics(images: DataFrame, width: int, height: int, off_x=0, off_y=0) -> DataFrame:
    """Intrinsics after a resize to width x height and a crop at the offset."""
    w, h = F.col("px_w").cast("double"), F.col("px_h").cast("double")
    return images.withColumns({
        "fx": F.col("fx") * F.floor(F.lit(float(height)) * w / h) / w,
        "fy": F.col("fy") * F.lit(float(height)) / h,
        "mx": F.col("mx") * F.lit(float(width - 1)) / (w - 1) - F.lit(float(off_x)),
        "my": F.col("my") * F.lit(float(height - 1)) / (h - 1) - F.lit(float(off_y)),
        "px_w": F.lit(width), "px_h": F.lit(height)})


def camera_axes(images: DataFrame) -> DataFrame:
    """The three axes of each camera in world coordinates: ax_x .. az_z."""
    p = prepare_images(images)
    return p.select("image_id", *[F.col(f"m{i+1}{j+1}").alias(f"a{a}_{b}") for i, a in enumerate("xyz") for j, b in enumerate("xyz")])
