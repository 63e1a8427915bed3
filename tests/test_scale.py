"""What moves between tasks: plans and passes that keep large inputs bounded, beside plain reference results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pointweave.functions import products
from pointweave.operators import boxes, fusion, neighbours, registration, visibility
from pointweave.streaming import accumulators


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def _camera(spark):
    pose = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(4)]) for i in range(4)])
    one = [F.lit(v).alias(c) for c, v in (("fx", 4.0), ("fy", 4.0), ("cx", 2.0), ("cy", 2.0))]
    return spark.range(6).select(F.floor(F.col("id") / 3).alias("seq"), (F.col("id") % 3).alias("frame"), *one, pose.alias("pose"))


def _depth(spark):
    d = spark.range(96).select(F.floor(F.col("id") / 48).alias("seq"), (F.floor(F.col("id") / 16) % 3).alias("frame"), (F.col("id") % 4).alias("u"), (F.floor(F.col("id") / 4) % 4).alias("v"))
    return d.withColumn("mm", (F.pmod(F.xxhash64("seq", "frame", "u", "v"), F.lit(2000))).cast("int"))


def test_depth_to_points_moves_pictures_and_broadcasts_no_poses(spark):
    got = fusion.depth_to_points(_depth(spark).repartition(7), _camera(spark), 1.5, carry=("mm",))
    assert "Broadcast" not in plan(got)
    want = {(r.seq, r.frame, r.u, r.v): r.mm for r in _depth(spark).collect() if 0 < r.mm < 1500}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        z = want[r.seq, r.frame, r.u, r.v] / 1000
        assert (r.mm, r.z) == (want[r.seq, r.frame, r.u, r.v], z)
        assert np.allclose([r.x, r.y], [(r.u + 0.5 - 2) * z / 4, (r.v + 0.5 - 2) * z / 4])


def test_tsdf_streams_pictures_to_the_parts_of_a_volume(spark, monkeypatch):
    monkeypatch.setattr(fusion, "CELLS", 20)  # several parts, and pictures one by one
    volumes = spark.range(2).select(F.col("id").alias("seq"), *[F.lit(v).alias(f"lo_{a}") for a, v in zip("xyz", (-0.31, -0.27, 0.43))],
                                    *[F.lit(n).cast("long").alias(f"n_{a}") for a, n in zip("xyz", (4, 3, 5))])
    out = fusion.tsdf(volumes, _camera(spark), _depth(spark).repartition(5), 0.17, 4, 4, by=("seq",))
    assert "CoGroup" not in plan(out)
    got = {(r.seq, r.i, r.j, r.k): (r.tsdf, r.w) for r in out.collect()}
    mm = {(r.seq, r.frame, r.u, r.v): r.mm for r in _depth(spark).collect()}
    want = {}
    for seq, i, j, k in np.ndindex(2, 4, 3, 5):
        x, y, z = -0.31 + i * 0.17, -0.27 + j * 0.17, 0.43 + k * 0.17
        u, v = np.rint(x * 4 / z + 2), np.rint(y * 4 / z + 2)
        gaps = [mm.get((seq, f, u, v), 0) / 1000 - z for f in range(3) if mm.get((seq, f, u, v), 0) > 0]
        near = [min(1.0, g / 0.85) for g in gaps if g >= -0.85]
        if near:
            want[seq, i, j, k] = (sum(near) / len(near), len(near))
    assert want.keys() == got.keys()
    assert all(np.allclose(got[key], want[key]) for key in want)


def _boxes(spark, n, tag):
    u = lambda t: (F.pmod(F.xxhash64(F.lit(tag + t), "id"), F.lit(1000)) / 1000.0)
    return spark.range(n).select(F.lit(0).alias("scan_id"), F.col("id").alias("box_id"), *[(u(c) * 4).alias(c) for c in ("cx", "cy", "cz")],
                                 *[(u(c) + 0.5).alias(c) for c in ("dx", "dy", "dz")], (u("h") * 6.283).alias("heading"))


def test_box_overlaps_are_dealt_to_all_tasks(spark):
    a, b = _boxes(spark, 60, "a"), _boxes(spark, 60, "b")
    got = boxes.box_iou(a, b, rotated=True)
    assert "Broadcast" not in plan(got)
    left, right = a.toPandas().to_numpy(float).T, b.toPandas().to_numpy(float).T
    i, j = np.indices((60, 60)).reshape(2, -1)
    flat = boxes._clipped(*[left[c][i] for c in (2, 3, 5, 6, 8)], *[right[c][j] for c in (2, 3, 5, 6, 8)])
    tall = np.minimum(left[4][i] + left[7][i] / 2, right[4][j] + right[7][j] / 2) - np.maximum(left[4][i] - left[7][i] / 2, right[4][j] - right[7][j] / 2)
    inter = flat * np.maximum(tall, 0)
    want = inter / (left[5:8].prod(0)[i] + right[5:8].prod(0)[j] - inter)
    rows = {(r.a_box_id, r.b_box_id): r.iou for r in got.collect()}
    assert rows.keys() == {(int(i[k]), int(j[k])) for k in np.flatnonzero(want > 0)}
    assert all(abs(rows[int(i[k]), int(j[k])] - want[k]) < 1e-12 for k in np.flatnonzero(want > 0))


def test_overlap_area_where_rectangles_touch_or_are_equal():
    a = [np.array(v, float) for v in ([0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [2, 2, 2, 2, 2], [2, 2, 2, 2, 2], [0, 0, 0, np.pi / 4, 0.3])]
    b = [np.array(v, float) for v in ([2, 2, 0, 0, 0], [0, 2, 0, 0, 0], [2, 2, 2, 2, 1], [2, 2, 2, 2, 1], [0, 0, 0, 0, 1.3])]
    assert np.allclose(boxes._overlap(*a, *b), [0, 0, 4, 8 * (np.sqrt(2) - 1), 1], atol=1e-12)
    assert list(boxes._overlap(*a, *b) > 0) == list(boxes._clipped(*a, *b) > 0)


def test_only_views_that_are_seen_are_shuffled():
    rng = np.random.default_rng(2)
    n = 3000
    xa, ya = rng.integers(0, 9, n), rng.integers(0, 5, n)
    views = pa.table({"image_id": np.arange(n) % 3, "point_id": rng.permutation(n) // 2, "dist": rng.integers(1, 400, n) / 8,
                      "xa": xa, "xb": xa + 2, "ya": ya, "yb": ya + 3, "depth": rng.random(n)})
    want = {}
    for r in views.to_pylist():
        for px, py in np.ndindex(2, 3):
            at = r["image_id"], r["xa"] + px, r["ya"] + py
            want[at] = min(want.get(at, (np.inf, 0, 0)), (r["dist"], r["point_id"], r["depth"]))
    cols = ["dist", "point_id", "depth"]
    front = pa.Table.from_batches(visibility._painted(["image_id"], cols, False)(iter(views.to_batches(100))))
    assert front.num_rows <= len(want) < n // 10
    near = front.sort_by("image_id").to_batches(7)
    pixels = pa.Table.from_batches(visibility._painted(["image_id"], cols, True)(iter(near))).to_pylist()
    assert {(r["image_id"], r["px"], r["py"]): (r["dist"], r["point_id"], r["depth"]) for r in pixels} == want and len(pixels) == len(want)


def test_images_that_give_way_to_others_start_anew(monkeypatch):
    monkeypatch.setattr(visibility, "PIXELS", 4)
    b = [pa.RecordBatch.from_pydict({"image_id": [i], "point_id": [p], "dist": [float(p)], "xa": [0], "xb": [2], "ya": [0], "yb": [2]}) for p in (3, 1, 2) for i in (0, 1)]
    front = pa.Table.from_batches(visibility._painted(["image_id"], ["dist", "point_id"], False)(iter(b)))
    assert {(r["image_id"], r["point_id"]) for r in front.to_pylist()} >= {(0, 1), (1, 1)}


def _brute(q, x, ids, k):
    d2 = ((q[:, None] - x[None]) ** 2).sum(2)
    return [sorted(zip(row.tolist(), ids))[:k] for row in d2]


def test_nearest_by_products_is_exact_with_ties_and_copies():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (1300, 6)).astype(float)  # many tied distances, more rows than a tile
    q, ids = np.concatenate([x[:40], rng.random((30, 6)) * 1e6]), rng.permutation(1300).tolist()
    for k in (1, 7):
        row, d2, found = products.Nearest(x, ids, k).find(q)
        near = products.Nearest(x, ids, k)
        got = [[] for _ in q]
        for r, d, f in zip(row.tolist(), d2.tolist(), found.tolist()):
            got[r].append((d, near.ids[f]))
        for g, w in zip(got, _brute(q, x, ids, k)):
            assert [i for _, i in g] == [i for _, i in w] and np.allclose([d for d, _ in g], [d for d, _ in w])


def test_descriptors_meet_as_matrices(spark, monkeypatch):
    monkeypatch.setattr(registration, "REFERENCES", 40)
    monkeypatch.setattr(registration, "QUERIES", 30)
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, (150, 5)).astype(float), rng.integers(0, 4, (170, 5)).astype(float)
    frame = lambda v: spark.createDataFrame([(i % 2, i, row) for i, row in enumerate(v.tolist())], "pair_id long, id long, feat array<double>")
    out = registration.nearest_descriptor(frame(a), frame(b))
    assert "lambda" not in plan(out)  # no distance as a row of its own
    got = {(r.pair_id, r.a_id): (r.d2, r.b_id) for r in out.collect()}
    want = {(g, int(i)): w[0] for g in (0, 1) for i, w in zip(np.arange(150)[g::2], _brute(a[g::2], b[g::2], list(range(g, 170, 2)), 1))}
    assert got == want


def test_vectors_of_probed_cells_meet_as_matrices(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_PART", 25)
    monkeypatch.setattr(neighbours, "QUERY_PART", 20)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, (200, 4)).astype(float)
    e = spark.createDataFrame([(0, i, row) for i, row in enumerate(x.tolist())], "scan_id int, vec_id long, v array<double>")
    out = neighbours.approximate_knn(e.withColumnRenamed("vec_id", "query_id"), e, 3, probes=4, cells=4, s_id="vec_id", vector="v")
    assert "zip_with" not in plan(out)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.d2, r.vec_id))
    assert got == {i: w for i, w in enumerate(_brute(x, x, list(range(200)), 3))}


def test_votes_of_a_bucket_keep_samples_apart_and_null_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(accumulators, "BUCKETS", 2)
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = [(0, p, s, p * 10 + s, [float(p), float(s)], day(1 + s)) for p in range(9) for s in range(3)]
    rows += [(0, None, 1, 500, [5.0, 5.0], day(2)), (0, 3, 1, 900, [7.0, 7.0], day(2)), (0, 3, 0, 901, [8.0, 8.0], day(3))]
    df = spark.createDataFrame(rows, "scan_id long, point_id long, sample_id long, row_id long, scores array<double>, t string")
    df = df.withColumn("sample_ts", F.to_timestamp("t")).drop("t")
    path = f"{tmp_path}/in"
    for d in (1, 2, 3):
        df.where(F.dayofmonth("sample_ts") == d).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    voted = accumulators.vote_by_window(stream, 2, watermark="10 days")
    assert "__bucket" in plan(voted)  # a call for each bucket, not for each point
    out = accumulators.run_to_end(voted, "votes", "update", f"{tmp_path}/check").collect()
    last = {}
    for r in out:
        if r.n_votes >= last.get(r.point_id, (0,))[0]:
            last[r.point_id] = (r.n_votes, *r.scores)
    # Of point 3 the second day has two rows of sample 1, of which the later row counts; sample 0 is known on the third.
    want = {p: (3, 3.0 * p, 3.0) for p in range(9)} | {3: (3, 3.0 + 7.0 + 3.0, 0.0 + 7.0 + 2.0), None: (1, 5.0, 5.0)}
    assert last == want


def test_views_of_an_image_are_made_in_one_task(spark, monkeypatch):
    from test_properties import _views_tables

    points, images = _views_tables(spark)
    monkeypatch.setattr(visibility, "POINT_BLOCK", 40)
    apart, together = (visibility.project_views(points, images, 5.0, 0.5, voxel=0.25, carry=("label",), together=t) for t in (False, True))
    order = ["scan_id", "image_id", "point_id"]
    a, b = (d.toPandas().sort_values(order, ignore_index=True) for d in (apart, together.select(*apart.columns)))
    assert len(a) > 500 and a.equals(b)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # enough images for the tasks: no group is split
    try:
        one = visibility.project_views(points, images, 5.0, 0.5, voxel=0.25, together=True)
        tasks = one.withColumn("task", F.spark_partition_id()).groupBy("scan_id", "image_id").agg(F.count_distinct("task").alias("n"))
        assert {r.n for r in tasks.collect()} == {1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
