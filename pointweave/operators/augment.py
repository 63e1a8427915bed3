"""Random changes for training sets; a draw per scan or per point from hashed keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.groups import with_stats
from ..functions.lineage import cut
from ..functions.prefix import number_by_hash
from ..functions.rand import key_hash, normal, uniform

SCAN = ("scan_id",)
XYZ = ("x", "y", "z")
RGB = ("r", "g", "b")


def jitter(df: DataFrame, cols, sigma: float, clip: float | None, p: float = 1.0, seed=0, by=SCAN, row_id="point_id") -> DataFrame:
    """Add clipped normal noise per row and column, with chance p per scan."""
    def noise(c):
        n = normal(f"{seed}/{c}", *by, row_id) * sigma
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), n)) if clip is not None else n
    on = uniform(f"{seed}/on", *by) < p
    return df.withColumns({c: F.when(on, F.col(c) + noise(c)).otherwise(F.col(c)) for c in cols})


def rotate(df: DataFrame, degs=(180.0, 180.0, 180.0), seed=0, by=SCAN, normals=False) -> DataFrame:
    """Turn each scan by random angles about x, y, z in random order."""
    scans = df.select(*by).distinct()
    ang = [(uniform(f"{seed}/{a}", *by) - 0.5) * 2 * math.radians(d) for a, d in zip(XYZ, degs)]
    order = key_hash(f"{seed}/order", *by) % 6
    one, zero = F.lit(1.0), F.lit(0.0)

    def turn(axis):
        c, s = F.cos(F.col(f"__a{axis}")), F.sin(F.col(f"__a{axis}"))
        rows = {"x": [[one, zero, zero], [zero, c, -s], [zero, s, c]], "y": [[c, zero, s], [zero, one, zero], [-s, zero, c]],
                "z": [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]
        return rows

    def product(a, b):
        return [[reduce(lambda u, v: u + v, [a[i][k] * b[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]

    scans = scans.withColumns({**{f"__a{a}": e for a, e in zip(XYZ, ang)}, "__o": order})
    orders = ["xyz", "xzy", "yxz", "yzx", "zxy", "zyx"]
    mats = [product(turn(o[2]), product(turn(o[1]), turn(o[0]))) for o in orders]
    cell = lambda i, j: F.coalesce(*[F.when(F.col("__o") == n, m[i][j]) for n, m in enumerate(mats)])
    scans = scans.select(*by, *[cell(i, j).alias(f"__m{i}{j}") for i in range(3) for j in range(3)])
    out = df.join(scans, list(by))
    spin = lambda cols: {c: F.col(f"__m{i}0") * F.col(cols[0]) + F.col(f"__m{i}1") * F.col(cols[1]) + F.col(f"__m{i}2") * F.col(cols[2]) for i, c in enumerate(cols)}
    out = out.withColumns(spin(XYZ))
    if normals:
        out = out.withColumns(spin(("nx", "ny", "nz")))
    return out.drop(*[f"__m{i}{j}" for i in range(3) for j in range(3)])


def rotate_axis(df, deg: float, axis: str, seed, by=SCAN) -> DataFrame:
    return rotate(df, tuple(deg if a == axis else 0.0 for a in XYZ), seed, by)


def translate(df, lo: float, hi: float, seed, by=SCAN) -> DataFrame:
    return df.withColumns({a: F.col(a) + lo + uniform(f"{seed}/{a}", *by) * (hi - lo) for a in XYZ})


def scale_random(df, lo: float, hi: float, seed, by=SCAN) -> DataFrame:
    """Per-axis factor; normals are divided by it and made unit again."""
    f = {a: lo + uniform(f"{seed}/{a}", *by) * (hi - lo) for a in XYZ}
    new = {a: F.col(a) * f[a] for a in XYZ}
    if {"nx", "ny", "nz"} <= set(df.columns):
        n = [F.col(f"n{a}") / f[a] for a in XYZ]
        length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
        new |= {f"n{a}": F.when(length > 0, e / length).otherwise(e) for a, e in zip(XYZ, n)}
    return df.withColumns(new)


def mirror(df, axes, p: float, seed, by=SCAN) -> DataFrame:
    """Per axis with chance p: c becomes max - c (also the flip of integer voxel coordinates)."""
    s = with_stats(df, by, **{f"__{a}": F.max(a) for a in axes})
    return s.withColumns({a: F.when(uniform(f"{seed}/{a}", *by) < p, F.col(f"__{a}") - F.col(a)).otherwise(F.col(a)) for a in axes}).drop(*[f"__{a}" for a in axes])


def shift_voxels(df, seed, by=SCAN, cols=("vx", "vy", "vz")) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.floor(uniform(f"{seed}/{c}", *by) * 100) for c in cols})


def _unit(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def colour_shift(df, ratio: float, seed, p=0.95, by=SCAN) -> DataFrame:
    on = uniform(f"{seed}/on", *by) < p
    return df.withColumns({c: F.when(on, _unit(F.col(c) + (uniform(f"{seed}/{c}", *by) - 0.5) * 2 * ratio)).otherwise(F.col(c)) for c in RGB})


def colour_contrast(df, seed, p=0.2, blend: float | None = None, by=SCAN) -> DataFrame:
    """Stretch each channel of the scan to 0..1, blended with the original."""
    s = with_stats(df, by, **{f"__{n}{c}": f(c) for c in RGB for n, f in (("lo", F.min), ("hi", F.max))})
    on, t = uniform(f"{seed}/on", *by) < p, uniform(f"{seed}/blend", *by) if blend is None else F.lit(float(blend))
    span = lambda c: F.col(f"__hi{c}") - F.col(f"__lo{c}")
    new = {c: F.when(on & (span(c) > 0), (1 - t) * F.col(c) + t * ((F.col(c) - F.col(f"__lo{c}")) / F.when(span(c) > 0, span(c)))).otherwise(F.col(c)) for c in RGB}
    return s.withColumns(new).drop(*[f"__{n}{c}" for c in RGB for n in ("lo", "hi")])


def colour_noise(df, std: float, seed, p=0.95, by=SCAN) -> DataFrame:
    on = uniform(f"{seed}/on", *by) < p
    return df.withColumns({c: F.when(on, _unit(F.col(c) + normal(f"{seed}/{c}", *by, "point_id") * std)).otherwise(F.col(c)) for c in RGB})


def drop_feature(df, col: str, p: float, seed, by=SCAN) -> DataFrame:
    return df.withColumn(col, F.when(uniform(seed, *by) < p, F.lit(0.0)).otherwise(F.col(col)))


def elastic(df: DataFrame, grains, mags, seed, p: float = 0.95, by=SCAN) -> DataFrame:
    """Smooth random displacement: lattice noise, smoothed twice by three taps per axis with zero
    borders, added by trilinear interpolation, for each (granularity, magnitude) in turn.

    The two smoothings of an axis are one known matrix, and the axes commute,
    so a node's value is a weighted sum of the hashed noise of its 125 nearest
    nodes. Only nodes next to points are made, and no lattice is shuffled.
    """
    by = list(by)
    on = uniform(f"{seed}/on", *by) < p
    out = df
    for g, m in zip(grains, mags):
        box = out.groupBy(*by).agg(*[F.min(a).alias(f"__o{a}") for a in XYZ], *[(F.floor((F.max(a) - F.min(a)) / g) + 3).alias(f"__n{a}") for a in XYZ])
        pts = out.join(box, by)
        pts = pts.withColumns({f"__t{a}": (F.col(a) - F.col(f"__o{a}")) / g + 1 for a in XYZ})
        pts = pts.withColumns({f"__i{a}": F.floor(f"__t{a}") for a in XYZ})
        dims = [f"__n{a}" for a in XYZ]
        cells = pts.select(*by, *dims, *[f"__i{a}" for a in XYZ]).distinct()
        corner = F.array(*[F.struct(*[F.lit(d).alias(f"__d{a}") for a, d in zip(XYZ, (i, j, k))]) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
        nodes = cells.select(*by, *dims, *[f"__i{a}" for a in XYZ], F.inline(corner))
        nodes = nodes.select(*by, *dims, *[(F.col(f"__i{a}") + F.col(f"__d{a}")).alias(f"__k{a}") for a in XYZ]).distinct()
        taps = nodes
        for a in XYZ:
            taps = taps.withColumn(f"__s{a}", F.explode(F.sequence(F.greatest(F.col(f"__k{a}") - 2, F.lit(0)), F.least(F.col(f"__k{a}") + 2, F.col(f"__n{a}") - 1))))
        # Entry (k, s) of the twice-applied three-tap matrix: how many nodes lie within one of both.
        weight = reduce(lambda u, v: u * v, [
            (F.least(F.col(f"__k{a}") + 1, F.col(f"__s{a}") + 1, F.col(f"__n{a}") - 1) - F.greatest(F.col(f"__k{a}") - 1, F.col(f"__s{a}") - 1, F.lit(0)) + 1) / 9.0 for a in XYZ])
        noise = {a: normal(f"{seed}/{g}/{a}", *by, "__sx", "__sy", "__sz") for a in XYZ}
        node = taps.groupBy(*by, "__kx", "__ky", "__kz").agg(*[F.sum(weight * noise[a]).alias(f"__v{a}") for a in XYZ])
        near = pts.select(*by, "point_id", *[f"__t{a}" for a in XYZ], *[f"__i{a}" for a in XYZ], F.inline(corner))
        w = reduce(lambda u, v: u * v, [F.when(F.col(f"__d{a}") == 1, F.col(f"__t{a}") - F.col(f"__i{a}")).otherwise(1 - F.col(f"__t{a}") + F.col(f"__i{a}")) for a in XYZ])
        near = near.select(*by, "point_id", w.alias("__w"), *[(F.col(f"__i{a}") + F.col(f"__d{a}")).alias(f"__k{a}") for a in XYZ])
        move = near.join(node, by + ["__kx", "__ky", "__kz"]).groupBy(*by, "point_id").agg(*[F.sum(F.col("__w") * F.col(f"__v{a}")).alias(f"__v{a}") for a in XYZ])
        out = out.join(move, by + ["point_id"])
        out = out.withColumns({a: F.when(on, F.col(a) + F.col(f"__v{a}") * m).otherwise(F.col(a)) for a in XYZ}).drop(*[f"__v{a}" for a in XYZ])
        if g != list(grains)[-1]:
            out = cut(out)
    return out


def shuffle_ids(df, seed, by=SCAN, out="shuffled") -> DataFrame:
    """A random order of each scan as a new id."""
    keyed = df.withColumn("__h", key_hash(seed, *by, "point_id"))
    ranked = number_by_hash(keyed, by, "__h", "point_id", out)
    return ranked.withColumn(out, F.col(out) - 1).drop("__h")


def one_of(df, steps, seed, by=SCAN) -> DataFrame:
    """One step per scan, picked by a hash; each step sees its own scans only."""
    pick = key_hash(seed, *by) % len(steps)
    parts = [step(df.where(pick == i)) for i, step in enumerate(steps)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_random_params(step, ranges: dict, seed):
    """A step whose named parameters are drawn between bounds, once per build."""
    import hashlib

    def draw(name, lo, hi):
        u = int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) / 4294967296.0
        return lo + u * (hi - lo)

    params = {n: draw(n, lo, hi) for n, (lo, hi) in ranges.items()}
    return lambda df: step(df, **params)


def compose(*steps):
    return lambda df: reduce(lambda d, s: d.transform(s), steps, df)


def on_pair(step):
    """The same step on both members of a pair."""
    return lambda pair: (step(pair[0]), step(pair[1]))
