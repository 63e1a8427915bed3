"""Shaping of point tables: ids, columns, labels, splits, targets, stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.groups import top_per_group, with_stats
from ..functions.maths import as_col
from ..functions.prefix import hash_levels, id_levels, number_by_hash, number_rows, running
from ..functions.rand import key_hash, uniform

SCAN = ("scan_id",)


# ------------------------------------------------------------------ ids and columns

def with_point_id(df: DataFrame, col: str, order: str, by=SCAN) -> DataFrame:
    """Running id 0..n-1 per scan in the order of a unique integer, unless the column exists."""
    if col in df.columns:
        return df
    return number_rows(df, by, order, col).withColumn(col, F.col(col) - 1)


def remove_columns(df: DataFrame, names, strict: bool = False) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*names)


def _as_features(df: DataFrame, name: str, width: int | None) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        out = F.col(name).cast("array<double>")
        if width is not None:
            out = F.when(F.assert_true(F.size(name) == width, f"width of {name}").isNull(), out)
        return out
    if width not in (None, 1):
        raise ValueError(f"{name} is one number wide, not {width}")
    return F.array(F.col(name).cast("double"))


def add_features(df: DataFrame, names, flags=None, widths=None, strict=True, delete=None, out="feat") -> DataFrame:
    """Append the flagged columns, in the given order, to the feature vector."""
    names = list(names)
    flags = flags or [True] * len(names)
    widths = widths or [None] * len(names)
    delete = delete or [False] * len(names)
    missing = [n for n, f in zip(names, flags) if f and n not in df.columns]
    if strict and missing:
        raise ValueError(f"columns not found: {missing}")
    parts = [F.col(out)] if out in df.columns else []
    parts += [_as_features(df, n, w) for n, f, w in zip(names, flags, widths) if f and n in df.columns]
    df = df.withColumn(out, F.concat(*parts)) if parts else df
    return df.drop(*[n for n, d in zip(names, delete) if d])


def add_ones(df: DataFrame, name: str = "ones") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def axis_features(df: DataFrame, axes=("z",)) -> DataFrame:
    return df.withColumns({f"pos_{a}": F.col(a) for a in axes})


def normal_feature(df: DataFrame, out: str = "feat") -> DataFrame:
    if not {"nx", "ny", "nz"} <= set(df.columns):
        raise ValueError("the table has no normals")
    return add_features(df, ["nx", "ny", "nz"], out=out)


# ------------------------------------------------------------------ labels and splits

def remap_labels(df: DataFrame, valid_ids, dont_care=(), ignore: int = -1, col="label", out=None) -> DataFrame:
    """Raw ids to their position in the list of valid ids; all others to the ignore label."""
    valid = [v for v in valid_ids if v not in set(dont_care)]
    table = F.create_map(*[F.lit(x) for i, v in enumerate(valid_ids) if v in valid for x in (v, i)])
    raw = F.col(col).cast("int")
    return df.withColumn(out or col, F.coalesce(F.try_element_at(table, raw), F.lit(ignore)))


def inverse_labels(df: DataFrame, valid_ids, col="pred", out=None) -> DataFrame:
    """Prediction index back to the raw id."""
    return df.withColumn(out or col, F.try_element_at(F.array(*[F.lit(v) for v in valid_ids]), F.col(col).cast("int") + 1))


def fuse(df: DataFrame, from_col: str, to_col: str, order: str, point_id="point_id") -> DataFrame:
    """Rooms become areas: the finer key goes and point ids are renewed per coarser key."""
    out = df.withColumnRenamed(point_id, "__old")
    key = "__old" if order == point_id else order
    # Old ids repeat between rooms, so the room comes first; then the order is the same in every evaluation.
    finer = [F.col(from_col)] if from_col != to_col else []
    out = running(out, [to_col], finer + id_levels(key), [F.col(key), F.col("__old")], {point_id: F.lit(1).cast("long")})
    return out.withColumn(point_id, F.col(point_id) - 1).drop("__old", *([from_col] if finer else []))


def split_fold(df: DataFrame, test_area, val_rooms, area="area", room="room") -> DataFrame:
    split = (F.when(F.col(area) == test_area, "test").when(F.col(room).isin(*val_rooms), "val").otherwise("train"))
    return df.withColumn("split", split).withColumn("is_val", split == "val")


def half_turn(df: DataFrame, scans, by="scan_id") -> DataFrame:
    """Turn the listed scans by half a turn about the vertical axis through the middle of their box."""
    stats = with_stats(df, [by], __x=F.min("x") + F.max("x"), __y=F.min("y") + F.max("y"))
    turn = F.col(by).isin(*scans)
    return stats.withColumns({
        "x": F.when(turn, F.col("__x") - F.col("x")).otherwise(F.col("x")),
        "y": F.when(turn, F.col("__y") - F.col("y")).otherwise(F.col("y"))}).drop("__x", "__y")


def rigid_transform(df: DataFrame, poses: DataFrame, on=SCAN, pose="pose", sensor=False) -> DataFrame:
    """Points times R transposed plus t, with one 4x4 matrix per key."""
    m = F.col("__m")
    joined = df.join(poses.select(*on, F.col(pose).alias("__m")), list(on))
    new = {a: m[i][0] * F.col("x") + m[i][1] * F.col("y") + m[i][2] * F.col("z") + m[i][3] for i, a in enumerate("xyz")}
    if sensor:
        new |= {f"sensor_{a}": m[i][3] for i, a in enumerate("xyz")}
    return joined.withColumns(new).drop("__m")


def drop_classes(df: DataFrame, ids, col="label") -> DataFrame:
    return df.where(~F.col(col).isin(*ids))


def cap_points(df: DataFrame, n: int, seed, by=SCAN, point_id="point_id") -> DataFrame:
    """At most n random points per scan, without replacement."""
    keyed = df.withColumn("__h", key_hash(seed, *by, point_id))
    return number_by_hash(keyed, by, "__h", point_id, "__rn").where(F.col("__rn") <= n).drop("__rn", "__h")


def segments_to_labels(verts: DataFrame, groups: DataFrame, label_map: DataFrame, by=SCAN) -> DataFrame:
    """Vertices take object and class of their segment; the later object wins; class 0 without one.

    verts(scan, vertex, segment), groups(scan, object, raw, segment), label_map(raw, label).
    """
    by = list(by)
    g = groups.join(label_map, "raw", "left").select(*by, "segment", "object", F.coalesce("label", F.lit(0)).alias("label"))
    g = g.groupBy(*by, "segment").agg(F.max(F.struct("object", "label")).alias("__g"))
    return verts.join(g, by + ["segment"], "left").select(
        *verts.columns, F.coalesce("__g.object", F.lit(0)).cast("long").alias("object"),
        F.coalesce("__g.label", F.lit(0)).cast("int").alias("label"))


# ------------------------------------------------------------------ instances and boxes

def _box(prefix=""):
    lo = {a: F.min(a).alias(f"lo_{a}") for a in "xyz"}
    hi = {a: F.max(a).alias(f"hi_{a}") for a in "xyz"}
    return [*lo.values(), *hi.values()]


def instance_boxes(points: DataFrame, objects: DataFrame | None = None, by=SCAN, instance="instance", classes=None) -> DataFrame:
    """Centre, size and class of the box of every object; objects with no points keep zeros."""
    keys = [*by, instance]
    box = points.groupBy(*keys).agg(*_box(), F.min_by("label", "point_id").alias("label"))
    box = box.select(*keys, *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2).alias(f"c{a}") for a in "xyz"],
                     *[(F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias(f"d{a}") for a in "xyz"], "label")
    if objects is not None:
        box = objects.select(*keys).join(box, keys, "left").na.fill(0)
    return box.where(F.col("label").isin(*classes)) if classes is not None else box


def instance_targets(df: DataFrame, classes, max_objects: int | None = None, by=SCAN, instance="instance") -> DataFrame:
    """Instances of the listed classes renumbered from 1, with centre, vote and mask per point."""
    by = list(by)
    box = instance_boxes(df, by=by, instance=instance, classes=classes)
    w = W.partitionBy(*by).orderBy(instance)
    box = box.withColumn("instance_no", F.row_number().over(w).cast("long"))
    if max_objects is not None:
        fits = F.assert_true(F.col("instance_no") <= max_objects, "too many objects in a scan")
        box = box.withColumn("instance_no", F.when(fits.isNull(), F.col("instance_no")))
    box = box.withColumnRenamed("label", "instance_label")
    out = df.join(box, by + [instance], "left")
    return out.withColumns({
        "instance_no": F.coalesce("instance_no", F.lit(0).cast("long")),
        "instance_mask": F.col("instance_no").isNotNull(),
        **{f"vote_{a}": F.coalesce(F.col(f"c{a}") - F.col(a), F.lit(0.0)) for a in "xyz"}})


def box_targets(df: DataFrame, class_index: dict, mean_sizes, max_objects: int | None = None, by=SCAN, instance="instance") -> DataFrame:
    """One target box per instance: centre, class index and size minus the mean size of the class."""
    box = instance_boxes(df, by=by, instance=instance, classes=list(class_index))
    index = F.create_map(*[F.lit(v) for pair in class_index.items() for v in pair])
    sizes = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in mean_sizes])
    w = W.partitionBy(*by).orderBy(instance)
    box = box.withColumn("size_class", index[F.col("label")]).withColumn("object_no", F.row_number().over(w).cast("long"))
    if max_objects is not None:
        box = box.withColumn("object_no", F.when(
            F.assert_true(F.col("object_no") <= max_objects, "too many objects in a scan").isNull(), F.col("object_no")))
    return box.withColumns({f"residual_{a}": F.col(f"d{a}") - sizes[F.col("size_class")][i] for i, a in enumerate("xyz")})


# ------------------------------------------------------------------ nested and stacked forms

def to_arrays(df: DataFrame, cols, by=SCAN, point_id="point_id", chunk: int = 65536) -> DataFrame:
    """Scans as rows of arrays, in point order, at most ``chunk`` points per row."""
    numbered = number_rows(df, by, point_id, "__rn").withColumn("chunk", F.floor((F.col("__rn") - 1) / chunk))
    items = F.array_sort(F.collect_list(F.struct("__rn", point_id, *cols)))
    rows = numbered.groupBy(*by, "chunk").agg(items.alias("__i"))
    return rows.select(*by, "chunk", F.size("__i").alias("n"),
                       *[F.col(f"__i.{c}").alias(c) for c in (point_id, *cols)])


def from_arrays(df: DataFrame, cols, by=SCAN, point_id="point_id") -> DataFrame:
    names = [point_id, *cols]
    return df.select(*by, F.inline(F.arrays_zip(*names)))


def stack_scans(points: DataFrame, sizes: DataFrame | None = None, by="scan_id", point_id="point_id", out="stacked_id") -> DataFrame:
    """Ids local to a scan become ids of the batch: shifted by the sizes of the scans before."""
    sizes = sizes if sizes is not None else points.groupBy(by).agg(F.count("*").alias("n"))
    total = running(sizes, [], [F.shiftright(by, 16)], [F.col(by)], {"__end": F.col("n")})
    offsets = total.select(by, (F.col("__end") - F.col("n")).alias("offset"))
    return points.join(offsets, by).withColumn(out, F.col(point_id) + F.col("offset"))


def unstack_scans(stacked: DataFrame, point_id="point_id", out="stacked_id") -> DataFrame:
    return stacked.withColumn(point_id, F.col(out) - F.col("offset")).drop(out, "offset")


def rows_to_csr(df: DataFrame, n_groups: int | Column, group="group", value_order="value", by=()) -> tuple[DataFrame, DataFrame]:
    """Pointer table (group, start, stop) over 0..n-1 with empty groups, and values with their position."""
    spark = df.sparkSession
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    ids = spark.range(n_groups).withColumnRenamed("id", group)
    full = ids.join(counts, group, "left").na.fill(0)
    pointers = running(full, [], [F.shiftright(group, 16)], [F.col(group)], {"stop": F.col("n")})
    pointers = pointers.select(group, (F.col("stop") - F.col("n")).alias("start"), "stop")
    inner = number_rows(df, [group], value_order, "__rn")
    values = inner.join(pointers.select(group, "start"), group).select(
        (F.col("start") + F.col("__rn") - 1).alias("position"), *[c for c in df.columns if c != group])
    return pointers, values


def csr_to_rows(pointers: DataFrame, values: DataFrame, group="group") -> DataFrame:
    """Group of every value: the pointers are spread over positions and joined."""
    spread = pointers.where("stop > start").select(group, F.explode(F.sequence("start", F.col("stop") - 1)).alias("position"))
    return spread.join(values, "position").drop("position")


def with_setting_id(images: DataFrame, settings, out="setting_id") -> DataFrame:
    """Images with the same settings share an id: a digest, so no shuffle is needed."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in settings])
    return images.withColumn(out, F.md5(text))


# ------------------------------------------------------------------ lexicographic operators

def lex_sort(df: DataFrame, cols) -> DataFrame:
    return df.orderBy(*cols)


def lex_position(df: DataFrame, cols, row_id, out="position") -> DataFrame:
    """Place of each row in the lexicographic order (argsort turned round)."""
    levels = [F.col(c) for c in cols] + [F.shiftright(as_col(row_id), 16)]
    return running(df, [], levels, [as_col(row_id)], {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)


def lex_unique(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols).distinct()


def first_per_key(df: DataFrame, cols, order) -> DataFrame:
    rest = [c for c in df.columns if c not in cols]
    best = df.groupBy(*cols).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f"))
    return best.select(*cols, "__f.*")


def clamp_batches(samples: DataFrame, budget: int, batch="batch_id", pos="sample_pos", n="n_points") -> DataFrame:
    """Samples of a batch in order; one that would exceed the budget is skipped, later ones go on."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(n).cast("long").alias("n"))))
    fold = F.aggregate(
        items,
        F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, s: F.when(acc.t + s.n <= budget, F.struct(
            (acc.t + s.n).alias("t"), F.concat(acc.kept, F.array(s.p.cast("bigint"))).alias("kept"))).otherwise(acc),
        lambda acc: acc.kept)
    kept = samples.groupBy(batch).agg(fold.alias("__k"))
    return kept.select(batch, F.explode("__k").alias(pos)).join(samples, [batch, pos])


# ------------------------------------------------------------------ scaling, colours, filters

def normalise_feature(df: DataFrame, col: str, standardise: bool = False, out=None) -> DataFrame:
    """Over the whole table: (f-min)/(max-min) or (f-mean)/sample std; a vector counts by all its entries."""
    vector = isinstance(df.schema[col].dataType, T.ArrayType)
    flat = df.select(F.explode(col).alias("v")) if vector else df.select(F.col(col).alias("v"))
    flat = flat.select(F.col("v").cast("double"))
    stats = flat.agg(*([F.avg("v").alias("a"), F.stddev_samp("v").alias("b")] if standardise
                       else [F.min("v").alias("a"), (F.max("v") - F.min("v")).alias("b")]))
    a, b = stats.select("a").scalar(), stats.select("b").scalar()
    df = df.withColumns({"__a": a, "__b": b})
    f = (lambda v: (v - F.col("__a")) / F.col("__b"))
    return df.withColumn(out or col, F.transform(col, f) if vector else f(F.col(col))).drop("__a", "__b")


def normalise_rgb(df: DataFrame, by=SCAN) -> DataFrame:
    """rgb/255 when some value of the scan lies outside 0..1."""
    s = with_stats(df, by, __hi=F.max(F.greatest("r", "g", "b")), __lo=F.min(F.least("r", "g", "b")))
    big = (F.col("__hi") > 1) | (F.col("__lo") < 0)
    return s.withColumns({c: F.when(big, F.col(c) / 255).otherwise(F.col(c)) for c in "rgb"}).drop("__hi", "__lo")


def filter_scans(df: DataFrame, *verdicts: DataFrame, op: str = "and", by=SCAN) -> DataFrame:
    """Keep the scans whose verdict tables (scan, keep) agree."""
    all_ = reduce(lambda a, b: a.unionByName(b), [v.select(*by, "keep") for v in verdicts])
    rule = F.bool_and("keep") if op == "and" else F.bool_or("keep")
    good = all_.groupBy(*by).agg(rule.alias("keep")).where("keep").select(*by)
    return df.join(good, list(by), "left_semi")


def random_verdict(df: DataFrame, p: float, seed, by=SCAN) -> DataFrame:
    return df.select(*by).distinct().withColumn("keep", uniform(seed, *by) < p)


def scale_pos(df: DataFrame, s: float) -> DataFrame:
    return df.withColumns({a: F.col(a) * s for a in "xyz"})


def centre(df: DataFrame, by=SCAN, axes="xyz") -> DataFrame:
    s = with_stats(df, by, **{f"__m{a}": F.avg(a) for a in axes})
    return s.withColumns({a: F.col(a) - F.col(f"__m{a}") for a in axes}).drop(*[f"__m{a}" for a in axes])


def normalise_scale(df: DataFrame, by=SCAN) -> DataFrame:
    """Centre, then into (-1, 1) by 0.999999 over the largest absolute coordinate."""
    return _fit(df, by, "xyz")


def cylinder_normalise(df: DataFrame, z: bool = False, by=SCAN) -> DataFrame:
    """Centre; scale xy by 0.999999 over the largest absolute of x and y; z with its own scale when asked."""
    out = _fit(df, by, "xy", centre_axes="xyz")
    return _fit(out, by, "z", centre_axes="") if z else out


def _fit(df, by, axes, centre_axes=None):
    # One aggregate: the largest absolute of a centred axis follows from its min, max and mean.
    centre_axes = axes if centre_axes is None else centre_axes
    aggs = {f"__{f.__name__}_{a}": f(a) for a in sorted(set(axes) | set(centre_axes)) for f in (F.min, F.max, F.avg)}
    s = with_stats(df, by, **aggs)
    mid = {a: F.col(f"__avg_{a}") if a in centre_axes else F.lit(0.0) for a in "xyz" if f"__avg_{a}" in aggs}
    reach = [F.greatest(F.abs(F.col(f"__max_{a}") - mid[a]), F.abs(F.col(f"__min_{a}") - mid[a])) for a in axes]
    top = F.greatest(*reach) if len(reach) > 1 else reach[0]
    factor = F.when(top > 0, F.lit(0.999999) / top).otherwise(F.lit(1.0))
    new = {a: (F.col(a) - mid[a]) * (factor if a in axes else F.lit(1.0)) for a in mid}
    return s.withColumns(new).drop(*aggs)


def drop_corrupt_frames(frames: DataFrame, k: int, seq="seq", frame="frame", values="values", bits: int = 12) -> DataFrame:
    """Every k-th frame; a frame with inf or NaN does not use up its turn, so the next one is tried.

    The count modulo k is the only memory of the walk, so a chunk of frames is a
    map from k start states to k end states. The maps are folded along the
    sequence (one short row per chunk), then each chunk picks from its start.
    """
    bad = F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    f = F.col(frame).cast("long")
    chunks = frames.groupBy(seq, F.shiftright(f, bits).alias("__c")).agg(
        F.array_sort(F.collect_list(F.struct(f.alias("f"), bad.alias("bad")))).alias("__i"))

    def after(state, item):
        return F.when((state == 0) & item["bad"], state).otherwise((state + 1) % k)

    ends = F.array(*[F.aggregate("__i", F.lit(start), after) for start in range(k)])
    maps = chunks.select(seq, "__c", ends.alias("__e"))
    walk = F.aggregate(
        F.array_sort(F.collect_list(F.struct("__c", "__e"))),
        F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<c:bigint,s:int>>").alias("at")),
        lambda acc, m: F.struct(
            F.element_at(m["__e"], acc["s"] + 1).alias("s"),
            F.concat(acc["at"], F.array(F.struct(m["__c"].alias("c"), acc["s"].alias("s")))).alias("at")),
        lambda acc: acc["at"])
    starts = maps.groupBy(seq).agg(walk.alias("__w")).select(seq, F.inline("__w")).withColumnsRenamed({"c": "__c", "s": "__s"})
    pick = F.aggregate(
        "__i", F.struct(F.col("__s").alias("s"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, m: F.struct(after(acc["s"], m).alias("s"), F.when((acc["s"] == 0) & ~m["bad"], F.concat(acc["kept"], F.array(m["f"]))).otherwise(acc["kept"]).alias("kept")),
        lambda acc: acc["kept"])
    kept = chunks.join(starts, [seq, "__c"]).select(seq, F.explode(pick).alias(frame))
    return kept.join(frames, [seq, frame])
