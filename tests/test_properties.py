"""Operators without SQL, compared with brute force or with what they promise."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave.functions.graphs import components, greedy_keep
from pointweave.functions.prefix import running, score_levels
from pointweave.operators import balance, boxes, fusion, images, celltree, neighbours, regions, registration, tables

RNG = np.random.default_rng(7)


def cloud(n=300, scans=2, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    xyz = rng.random((n, 3)) * np.array([8, 6, 3])
    xyz[: n // 3] = xyz[: n // 3] / 200 + 1.0  # a third of the rows in one small spot
    if copies:
        xyz[-copies:] = xyz[0]
    return pd.DataFrame({"scan_id": np.arange(n) % scans, "point_id": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "label": np.arange(n) % 5})


def brute_knn(q, s, k, r=np.inf):
    out = set()
    for scan, qs in q.groupby("scan_id"):
        ss = s[s.scan_id == scan]
        for row in qs.itertuples():
            d = ((row.x - ss.x) ** 2 + (row.y - ss.y) ** 2 + (row.z - ss.z) ** 2).to_numpy()
            order = np.lexsort((ss.point_id.to_numpy(), d))[:k]
            out |= {(row.point_id, rank + 1, int(ss.point_id.iloc[i])) for rank, i in enumerate(order) if d[i] <= r * r}
    return out


def got_knn(df):
    return {(r.query_id, r.rank, r.point_id) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_knn_with_a_dense_spot_and_copies(spark, partitions):
    pdf = cloud(copies=40)
    s = spark.createDataFrame(pdf).repartition(partitions)
    assert got_knn(neighbours.knn_join(s.withColumnRenamed("point_id", "query_id"), s, 6)) == brute_knn(pdf, pdf, 6)


def test_knn_of_far_queries_and_small_clouds(spark):
    s, q = cloud(90), cloud(30, seed=3)
    q["x"] += 500.0
    s = pd.concat([s[s.scan_id == 0], s[s.scan_id == 1].head(3)])  # the second scan has fewer points than k
    df = neighbours.knn_join(spark.createDataFrame(q).withColumnRenamed("point_id", "query_id"), spark.createDataFrame(s), 5)
    assert got_knn(df) == brute_knn(q, s, 5)


def test_knn_within_a_radius(spark):
    pdf = cloud(200)
    s = spark.createDataFrame(pdf)
    df = neighbours.nearest_join(s.withColumnRenamed("point_id", "query_id"), s, 4, 0.7)
    assert got_knn(df) == brute_knn(pdf, pdf, 4, 0.7)


def test_knn_of_nothing(spark):
    s = spark.createDataFrame(cloud(20))
    assert neighbours.knn_join(s.withColumnRenamed("point_id", "query_id"), s.limit(0), 3).count() == 0
    assert neighbours.knn_join(s.withColumnRenamed("point_id", "query_id").limit(0), s, 3).count() == 0


def test_approximate_knn_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("scan_id", F.lit(0)).where("vec_id < 200")
    got = neighbours.approximate_knn(e.withColumnRenamed("vec_id", "query_id"), e, 5, probes=8, s_id="vec_id", vector="embedding").toPandas()
    pdf = e.toPandas()
    v = np.stack(pdf.embedding)
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    ids = pdf.vec_id.to_numpy()
    want = {(ids[i], ids[j]) for i in range(len(v)) for j in np.argsort(d[i], kind="stable")[:5]}
    assert len(want & set(zip(got.query_id, got.vec_id))) > 0.6 * len(want)


def test_approximate_knn_recall_of_the_whole_table(spark, sf):
    e = spark.read.parquet(f"{os.path.dirname(sf.rstrip('/'))}/sf0.1/embeddings.parquet").withColumn("scan_id", F.lit(0))
    got = neighbours.approximate_knn(e.withColumnRenamed("vec_id", "query_id"), e, 5, probes=8, s_id="vec_id", vector="embedding").toPandas()
    pdf = e.toPandas()
    v, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    want = set()
    for i in range(len(v)):
        d = ((v[i] - v) ** 2).sum(1)
        want |= {(ids[i], ids[j]) for j in np.lexsort((ids, d))[:5]}
    share = len(want & set(zip(got.query_id, got.vec_id))) / len(want)
    print("recall", share)
    assert len(got) == len(want) and share >= 0.9


def test_approximate_knn_fills_up_small_groups(spark):
    pdf = cloud(1500)
    rng = np.random.default_rng(4)
    small = pd.DataFrame({"scan_id": 2 + np.arange(9) // 6, "point_id": 5000 + np.arange(9), **dict(zip("xyz", rng.random((3, 9)) * 8)), "label": 0})
    s = spark.createDataFrame(pd.concat([pdf, small]))
    got = neighbours.approximate_knn(s.withColumnRenamed("point_id", "query_id"), s, 4, probes=1).groupBy("scan_id", "query_id").count().collect()
    assert len(got) == 1509 and all(r["count"] == (3 if r.scan_id == 3 else 4) for r in got)


@pytest.mark.parametrize("width", [8, 1024])
def test_farthest_points_equal_the_one_by_one_form(spark, width):
    pdf = cloud(150, copies=3)
    got = regions.fps(spark.createDataFrame(pdf), 20, width=width).toPandas().sort_values("turn")
    for scan, part in pdf.groupby("scan_id"):
        part = part.sort_values("point_id")
        xyz, ids = part[["x", "y", "z"]].to_numpy(), part.point_id.to_numpy()
        d, picks = np.full(len(part), np.inf), [0]
        for _ in range(19):
            d = np.minimum(d, ((xyz - xyz[picks[-1]]) ** 2).sum(1))
            d[picks] = -1
            picks.append(int(np.argmax(d)))
        assert got[got.scan_id == scan].point_id.tolist() == ids[picks].tolist()


def test_greedy_selection(spark):
    e = {(int(a), int(b)) for a, b in RNG.integers(0, 60, (200, 2)) if a < b}
    gone, kept = set(), []
    for i in range(60):
        if not any((k, i) in e for k in kept):
            kept.append(i)
        else:
            gone.add(i)
    df = spark.createDataFrame(sorted(e), "winner long, loser long")
    assert {r.id for r in greedy_keep(df).collect()} == gone


def test_components(spark):
    e = [(int(a), int(b)) for a, b in RNG.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(find(k) == v for k, v in got.items())
    assert {x for p in e for x in p if p[0] != p[1]} == set(got)


def test_running_sums_of_tied_scores(spark):
    pdf = pd.DataFrame({"k": np.arange(500) % 2, "id": RNG.permutation(500) * 1000, "s": np.round(RNG.random(500), 1)})
    df = running(spark.createDataFrame(pdf), ["k"], score_levels("s", "id"), [-F.col("s"), F.col("id")], {"n": F.lit(1).cast("long"), "t": F.col("id")})
    got = df.toPandas().sort_values(["k", "n"])
    want = pdf.sort_values(["k", "s", "id"], ascending=[True, False, True])
    assert got.id.tolist() == want.id.tolist()
    assert got.t.tolist() == want.groupby("k").id.cumsum().tolist()


def test_box_nms_keeps_no_overlap_and_drops_only_for_a_reason(spark, sf):
    from catalog.box_cases import box_pred

    all_ = box_pred(spark, sf)
    kept = boxes.box_nms(all_, 0.1)
    pairs = boxes.box_iou(kept, kept, ["scan_id", "class"]).where("a_box_id < b_box_id AND iou > 0.1")
    assert pairs.count() == 0
    dropped = all_.join(kept, ["scan_id", "box_id"], "left_anti")
    why = boxes.box_iou(dropped, kept, ["scan_id", "class"], carry=("score",)).where("iou > 0.1 AND b_score >= a_score")
    assert why.select("scan_id", "a_box_id").distinct().count() == dropped.count()


def test_rotated_overlap_of_known_pairs(spark):
    row = lambda i, cx, dx, dy, h: (0, i, cx, 0.0, 0.0, dx, dy, 1.0, h)
    cols = "scan_id long, box_id long, cx double, cy double, cz double, dx double, dy double, dz double, heading double"
    a = spark.createDataFrame([row(1, 0.0, 2.0, 2.0, 0.0)], cols)
    b = spark.createDataFrame([row(1, 0.0, 2.0, 2.0, np.pi / 4), row(2, 0.0, 1.0, 1.0, 0.3), row(3, 1.0, 2.0, 2.0, np.pi / 2)], cols)
    got = {r.b_box_id: r.iou for r in boxes.box_iou(a, b, rotated=True).collect()}
    octagon = 8 * (np.sqrt(2) - 1)
    assert got[1] == pytest.approx(octagon / (8 - octagon)) and got[2] == pytest.approx(0.25) and got[3] == pytest.approx(1 / 3)


def test_alignment_recovers_a_known_motion(spark, sf):
    from catalog.registration_cases import known_matches, known_pose

    clean = known_matches(spark, sf).where("tx < 12").withColumn("tx", F.cos(F.col("pair_id") * 0.1 + 0.05) * F.col("sx") - F.sin(F.col("pair_id") * 0.1 + 0.05) * F.col("sy") + 0.5)
    for fit, df, limit in ((registration.fit_rigid, clean, 1e-9), (registration.fit_robust, known_matches(spark, sf), 0.05)):
        for r in fit(df).withColumn("truth", known_pose()).collect():
            assert np.abs(np.array(r.pose) - np.array(r.truth)).max() < limit


def test_credit_is_kept_and_spent(spark):
    i = spark.createDataFrame([(0, n, 10 + n % 3 * 20) for n in range(12)], "scan_id long, image_id long, size long")
    v = spark.createDataFrame([(0, n, p) for n in range(12) for p in range(n % 4 * 5, n % 4 * 5 + 8)], "scan_id long, image_id long, point_id long")
    for mode in ("random", "greedy"):
        got = images.pick_by_credit(i, v, 100, seed="t", mode=mode).join(i, ["scan_id", "image_id"]).toPandas()
        left = 100 - got["size"].sum()
        assert left >= 0 and not (set(range(12)) - set(got.image_id)) & {n for n in range(12) if 10 + n % 3 * 20 <= left}


def test_balanced_draws_even_out_classes(spark):
    df = spark.createDataFrame([(i, 0 if i < 900 else 1) for i in range(1000)], "point_id long, label int")
    got = balance.draw_balanced(df, 4000, "t", "point_id").groupBy("label").count().toPandas().set_index("label")["count"]
    assert got[1] / 4000 == pytest.approx(0.75, abs=0.03)  # weights 1/sqrt(900) and 1/sqrt(100): the rare class is drawn three times as often


def test_random_walk_only_drops_walked_points(spark):
    pdf = cloud(120)
    out = regions.random_walk_drop(spark.createDataFrame(pdf), 30, 0.3, 1.0, "t")
    n = out.count()
    assert 120 - 2 * 60 <= n < 120
    assert out.count() == n


def test_stacking_is_undone(spark):
    p = tables.with_point_id(spark.createDataFrame(cloud(50, 3)), "local", "point_id").select("scan_id", "local")
    back = tables.unstack_scans(tables.stack_scans(p, point_id="local").drop("local"), "local")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in p.collect()}
    assert tables.stack_scans(p, point_id="local").select("stacked_id").distinct().count() == 50


def test_equal_rows_on_any_partitioning(spark, sf):
    from catalog import fixtures as fx
    from pointweave.operators.voxel import grid_sample

    p = fx.points(spark, sf)
    rows = lambda n: sorted(map(tuple, grid_sample(p.repartition(n), 0.5, coords=True).collect()))
    assert rows(1) == rows(7)


def test_one_task_never_holds_a_group(spark, sf):
    """A numbering over one big group is cut into buckets: no window is over the group alone."""
    df = spark.range(200000).select(F.lit(0).alias("scan_id"), F.col("id").alias("point_id"))
    out = tables.with_point_id(df, "n", "point_id")
    assert out.where("n <> point_id").count() == 0
    assert "specifiedwindowframe" in out._jdf.queryExecution().toString().lower()


def _cloud(spark, xyz, name):
    return spark.createDataFrame(pd.DataFrame({"scan_id": 0, name: np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


@pytest.mark.parametrize("case", ["outlier", "far query", "tight cluster"])
def test_nearest_join_at_any_spread(spark, case):
    rng = np.random.default_rng(4)
    u = rng.random((800, 3)) * 10
    q, s = {"outlier": (np.vstack([u, [[1e6] * 3]]),) * 2, "far query": (np.vstack([u[:50], [[1e5] * 3]]), u), "tight cluster": (np.vstack([u[:400], 5 + u[:400] * 1e-7]),) * 2}[case]
    got = neighbours.knn_join(_cloud(spark, q, "query_id"), _cloud(spark, s, "point_id"), 5).toPandas().sort_values(["query_id", "rank"])
    want = np.sort(((q[:, None] - s[None]) ** 2).sum(2), 1)[:, :5]
    assert np.allclose(got["d2"].to_numpy().reshape(-1, 5), want, rtol=1e-9, atol=0)


def test_draws_keep_their_scan_when_ids_repeat(spark):
    df = spark.createDataFrame([(s, i, i % 3) for s in range(4) for i in range(30)], "scan_id long, point_id long, label int")
    got = balance.draw_balanced(df, 100, "t", "point_id", by=["scan_id"])
    assert got.count() == 100 and got.join(df, ["scan_id", "point_id", "label"]).count() == 100
    assert got.select("scan_id").distinct().count() == 4


def test_fused_ids_do_not_depend_on_the_partitioning(spark):
    df = spark.createDataFrame([("a", r, i, float(r * 100 + i)) for r in range(3) for i in range(20)], "area string, room long, point_id long, x double")
    one = tables.fuse(df.repartition(1), "room", "area", "point_id").select("point_id", "x").toPandas().sort_values("x")
    many = tables.fuse(df.repartition(7, "x"), "room", "area", "point_id").select("point_id", "x").toPandas().sort_values("x")
    assert one.point_id.tolist() == many.point_id.tolist() == list(range(60))


def test_fragments_skip_gaps_in_frame_numbers(spark):
    frames = spark.createDataFrame([(0, f) for f in (0, 1, 3, 7, 8, 9, 20)], "seq long, frame long")
    got = {r.frame: r.fragment for r in fusion.frame_fragments(frames, 3).collect()}
    assert got == {0: 0, 1: 0, 3: 0, 7: 1, 8: 1, 9: 1}


def test_one_poor_pair_leaves_the_others_alone(spark):
    rows = [("poor", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)] + [("good", float(i), float(i * i % 7), float(i % 3), i + 0.5, i * i % 7 - 0.25, float(i % 3)) for i in range(20)]
    m = spark.createDataFrame(rows, "pair_id string, sx double, sy double, sz double, tx double, ty double, tz double")
    got = {r.pair_id: r.pose for r in registration.fit_robust(m, rounds=6).collect()}
    assert set(got) == {"poor", "good"} and abs(got["good"][0][3] - 0.5) < 1e-6 and abs(got["good"][1][3] + 0.25) < 1e-6


def test_walk_without_restarts_ends(spark):
    df = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(10)] + [(0, 99, 500.0, 0.0, 0.0)], "scan_id long, point_id long, x double, y double, z double")
    kept = regions.random_walk_drop(df, 6, 0.0, 1.5, "t").count()
    assert 5 <= kept <= 10


@pytest.mark.parametrize("m, w, h", [(4, 32, 16), (64, 1024, 512), (64, 1408, 376), (64, 50, 80), (5, 5, 5), (3, 100, 4)])
def test_crop_ladder(m, w, h):
    from pointweave.operators.images import _crop_sizes

    sizes = _crop_sizes(m, w, h)
    assert sizes[-1] == (w, h) and sizes == sorted(set(sizes))
    assert m > min(w, h) or sizes == list(dict.fromkeys((min(m * 2 ** -(-t // 2), w), min(m * 2 ** (t // 2), h)) for t in range(40)))


def test_self_pairs_draw_until_every_fragment_is_served(spark):
    rng = np.random.default_rng(12)
    wide = pd.DataFrame(rng.random((400, 3)) * np.array([400.0, 400.0, 0.0]), columns=list("xyz")).assign(frag_id=0)
    near = pd.DataFrame(rng.random((60, 3)), columns=list("xyz")).assign(frag_id=1)
    none = pd.DataFrame([[np.nan, 0.0, 0.0], [0.0, np.nan, 1.0]], columns=list("xyz")).assign(frag_id=2)
    pdf = pd.concat([wide, near, none]).assign(scene=0)
    pdf["point_id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    matches, served = registration.self_pairs(df, 2.0, 0.1, (0.5, 1.0), "many", at_once=64)
    draws = {r.frag_id: r.draw for r in served.collect()}
    assert draws[0] >= 32 and draws[1] is not None and draws[2] is None and len(draws) == 3
    assert {(r.frag_id, r.draw) for r in matches.collect()} == {(f, d) for f, d in draws.items() if d is not None}
    assert {r.frag_id: r.draw is None for r in registration.self_pairs(df, 2.0, 0.1, (0.5, 1.0), "two", min_matches=20, at_once=4)[1].collect()} == {0: True, 1: False, 2: True}


def _rows_joined(df):
    """Rows that the joins and Python passes of the plans made, by the plan's own counts."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if any(x in node.nodeName() for x in ("Join", "MapInArrow")) and node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
        for child in [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else []:
            walk(child)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return max(out)


@pytest.mark.parametrize("case", ["uniform", "clusters"])
def test_joined_rows_do_not_follow_the_points(spark, case):
    """Queries between tight clusters do not meet whole clusters, however many points these have."""
    most = []
    for n in (4_000, 32_000):
        rng = np.random.default_rng(7)
        centres = rng.random((20, 3))
        s = rng.random((n, 3)) if case == "uniform" else np.repeat(centres, n // 20, 0) + 1e-4 * rng.random((n, 3))
        q = rng.random((300, 3))
        got = neighbours.knn_join(_cloud(spark, q, "query_id"), _cloud(spark, s, "point_id"), 8)
        most.append(_rows_joined(got) / len(q))
        found = got.toPandas().sort_values(["query_id", "rank"])["d2"].to_numpy().reshape(-1, 8)
        assert np.allclose(found, np.sort(((q[:, None] - s[None]) ** 2).sum(2), 1)[:, :8], rtol=1e-9, atol=0)
    assert max(most) < 8 * 20 and most[1] < 3 * most[0] + 8


def test_search_below_the_levels_that_are_sent(spark, monkeypatch):
    """With next to no nodes sent, each level is a join; with small groups many are taken apart."""
    rng = np.random.default_rng(9)
    s = np.vstack([rng.random((1500, 3)), 0.5 + 1e-5 * rng.random((700, 3)), np.repeat(rng.random((3, 3)), 30, 0)])
    q = np.vstack([s[::5], rng.random((200, 3)) * 3 - 1])
    want = np.sort(((q[:, None] - s[None]) ** 2).sum(2), 1)[:, :6]
    for top, wide in ((0, 512), (40, 20), (300_000, 5)):
        monkeypatch.setattr(celltree, "TOP", top)
        monkeypatch.setattr(celltree, "WIDE", wide)
        got = neighbours.knn_join(_cloud(spark, q, "query_id"), _cloud(spark, s, "point_id"), 6).toPandas().sort_values(["query_id", "rank"])
        assert (got["d2"].to_numpy().reshape(-1, 6) == want).all()


@pytest.mark.parametrize("crowd", [3, 4096])
def test_radius_join_cuts_crowded_cells_into_parts(spark, crowd):
    pdf = cloud(120, copies=20)
    s = spark.createDataFrame(pdf).repartition(3)
    got = neighbours.radius_join(s.withColumnRenamed("point_id", "query_id"), s, 0.5, crowd=crowd).select("query_id", "point_id").collect()
    d = lambda a, b: (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2
    rows = [*pdf.itertuples()]
    assert sorted(map(tuple, got)) == sorted((a.point_id, b.point_id) for a in rows for b in rows if a.scan_id == b.scan_id and d(a, b) <= 0.25)


def test_radius_join_never_broadcasts_the_queries_written_per_cell(spark, tmp_path):
    spark.createDataFrame(cloud(50)).write.parquet(f"{tmp_path}/cloud")  # small files, many cells in reach
    s = spark.read.parquet(f"{tmp_path}/cloud")
    out = neighbours.radius_join(s.withColumnRenamed("point_id", "query_id"), s, 2.0, size=0.1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pooling_runs_over_batches_of_groups(spark):
    """As the grouped aggregate, but no round trip per group: groups across batches, null keys, nulls and NaN results."""
    from pointweave.plans import pipeline as pl

    def span(v: pd.Series) -> float:
        return float(v.max() - v.min()) if len(v) else 0.0

    pl.register_pool("range", span)
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else int(k), None if i % 5 == 0 else int(i) + 2**55, float(rng.random()), None if i % 3 else 1.5)
            for i, k in enumerate(np.repeat(np.arange(40), 10))] + [(99, 1, float("nan"), None)]
    df = spark.createDataFrame(rows, "a long, b long, v double, w double").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = pl.pool_with(df, "range", ["a", "b"], ["v", "w"])
        assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
        want = df.groupBy("a", "b").agg(*[F.pandas_udf(span, "double")(c).alias(c) for c in ("v", "w")])
        assert out.schema == want.schema
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reference_pixels_without_sorting(spark):
    from pointweave.operators.visibility import reference_pixels

    rows = [(s, i, p, 0, float(10 * i + p)) for s in (1, 2) for i in (4, 3, 5) for p in (0, 1)] * 2
    df = spark.createDataFrame(rows, "setting_id long, image_id long, px long, py long, r double").withColumns({"g": F.col("r"), "b": F.col("r")})
    out = reference_pixels(df)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.setting_id, x.px, x.r) for x in out.collect()) == [(s, p, 30.0 + p) for s in (1, 2) for p in (0, 1)]


def _spied(monkeypatch, module, name):
    """Calls of a function of the module: (arguments, result)."""
    calls, real = [], getattr(module, name)

    def spy(*args, **how):
        out = real(*args, **how)
        calls.append((args, out))
        return out

    monkeypatch.setattr(module, name, spy)
    return calls


def test_crowded_cells_are_dense_without_pairs(spark, monkeypatch):
    pdf = cloud(900, copies=40)
    calls = _spied(monkeypatch, regions, "radius_join")
    got = {r.point_id for r in regions.density_filter(spark.createDataFrame(pdf), 0.5, 20).collect()}
    want = set()
    for _, s in pdf.groupby("scan_id"):
        x = s[["x", "y", "z"]].to_numpy()
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        want |= set(s.point_id[((d <= 0.25) & (d > 0)).sum(1) > 20])
    assert got == want and len(calls) == 1 and calls[0][0][0].where("x < 1.05 AND y < 1.05 AND z < 1.05 AND x > 1 AND y > 1 AND z > 1").isEmpty()


def test_walk_makes_edges_only_where_it_stands(spark, monkeypatch):
    calls = _spied(monkeypatch, regions, "ball_join")
    regions.random_walk_drop(spark.createDataFrame(cloud(3000)), 20, 0.3, 1.0, "t").count()
    assert calls and all(args[0].count() <= 2 * 6 for args, _ in calls)  # six walks in each of two scans


def test_huber_looks_no_further_than_the_nearest_point(spark, monkeypatch):
    a, b = cloud(400, seed=1), cloud(400, seed=2, copies=30)
    calls = _spied(monkeypatch, neighbours, "_cover")
    got = {(r.scan_id, r.side, r.point_id): (r.other, r.dist) for r in neighbours.nearest_distance(spark.createDataFrame(a), spark.createDataFrame(b), "huber", 0.25).collect()}
    for side, q, s in (("a", a, b), ("b", b, a)):
        for row in q.itertuples():
            t = s[s.scan_id == row.scan_id]
            d = np.abs(t[["x", "y", "z"]].to_numpy() - [row.x, row.y, row.z])
            h = np.where(d < 0.25, 0.5 * d * d, 0.25 * (d - 0.125)).sum(1)
            other, dist = got[row.scan_id, side, row.point_id]
            assert dist == pytest.approx(h.min(), rel=1e-9, abs=1e-15) and h[t.point_id == other][0] == pytest.approx(h.min(), rel=1e-9, abs=1e-15)
    assert len(got) == 800
    near = [r for args, _ in calls if "__rad" in args[0].columns for r in args[0].select("__rad").collect() if r[0] < 0.2]
    assert near


def test_sphere_labels_go_with_the_centres(spark, monkeypatch):
    pdf = cloud(300)
    calls = _spied(monkeypatch, regions, "sphere_sample")
    got = regions.grid_spheres(spark.createDataFrame(pdf), 1.0, 3.0)
    assert got.columns == ["scan_id", "centre_id", "point_id", "x", "y", "z", "label", "centre_label"]
    assert calls[0][1].columns[-1] == "__labels"  # known before the join, so the samples never shuffle by centre
    c = regions.grid_centres(spark.createDataFrame(pdf), 3.0).toPandas()
    want = {(r.scan_id, r.centre_id, p, r.centre_label) for r in c.itertuples() for p in pdf.point_id[(pdf.scan_id == r.scan_id) & ((pdf.x - r.x) ** 2 + (pdf.y - r.y) ** 2 + (pdf.z - r.z) ** 2 <= 1)]}
    assert {(r.scan_id, r.centre_id, r.point_id, r.centre_label) for r in got.collect()} == want


def test_pose_files_are_listed_many_by_a_task(spark, monkeypatch, tmp_path):
    from pointweave.sources import text

    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, seen = spark.conf.get(listing), []
    real = type(spark.read).json
    monkeypatch.setattr(type(spark.read), "json", lambda self, path: seen.append(spark.conf.get(listing)) or real(self, path))
    (tmp_path / "camera_1_pose.json").write_text('{"camera_location": [1, 2, 3], "final_camera_rotation": [0, 0, 1]}')
    assert text.read_pose_json(spark, f"file://{tmp_path}/*.json").count() == 1
    assert seen == [spark.conf.get("spark.sql.shuffle.partitions")] and spark.conf.get(listing) == before


def _views_tables(spark, n=400, n_images=18):
    rng = np.random.default_rng(11)
    pts = pd.DataFrame({"scan_id": np.arange(n) % 2, "point_id": np.arange(n), **dict(zip("xyz", (rng.random((3, n)).T * [8, 6, 3]).T)), "label": np.arange(n) % 5})
    pts = pd.concat([pts, pts.head(20)])  # rows may repeat
    rows = []
    for i in range(n_images):
        x, y, z = (rng.random(3) * [8, 6, 3]).tolist()
        a = float(rng.random() * 6)
        pose = [[np.cos(a), -np.sin(a), 0.0, x], [np.sin(a), np.cos(a), 0.0, y], [0.0, 0.0, 1.0, z], [0.0, 0.0, 0.0, 1.0]]
        rows.append((i % 2, i, ("equirectangular", "pinhole", "fisheye")[i % 3], 64, 32, x, y, z, 0.0, float(rng.random() / 3), a,
                     [[float(v) for v in r] for r in pose], 20.0, 20.0, 32.0, 16.0, 1.5, 0.0625, 0.015625, 30.0, 30.0, 32.0, 16.0))
    kinds = ("scan_id long, image_id long, camera string, px_w int, px_h int, cx double, cy double, cz double, omega double, phi double, kappa double, "
             "pose array<array<double>>, fx double, fy double, mx double, my double, xi double, k1 double, k2 double, gamma1 double, gamma2 double, u0 double, v0 double")
    return spark.createDataFrame(pts), spark.createDataFrame([*rows, rows[0]], kinds)


@pytest.mark.parametrize("pose", ["c2w", "inv"])
@pytest.mark.parametrize("cylinder", [False, True])
def test_views_by_blocks_equal_the_projection_of_each_pair(spark, monkeypatch, pose, cylinder):
    from pointweave.operators import camera as cam, visibility as vis

    points, images = _views_tables(spark)
    cams = cam.prepare_images(images, pose)
    names = [c for c in vis.CAMERA if c in cams.columns]
    pairs = vis.candidate_views(points, cams, 5.0, 0.5, cylinder, carry=("x", "y", "z", "label"), q_carry=names)
    want = cam.splat_box(cam.in_view(cam.project(pairs, pose), None, 1, 2), 0.25, top=1, bottom=2)
    monkeypatch.setattr(vis, "POINT_BLOCK", 7)
    monkeypatch.setattr(vis, "IMAGE_BLOCK", 2)
    got = vis.project_views(points, images, 5.0, 0.5, cylinder, top=1, bottom=2, voxel=0.25, pose=pose, carry=("label",))
    assert set(got.columns) == set(want.columns)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # no camera columns per pair
    order = ["scan_id", "image_id", "point_id"]
    a, b = (d.select(*want.columns).toPandas().sort_values(order, ignore_index=True) for d in (got, want))
    assert len(b) > 500
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


@pytest.mark.parametrize("exact", [False, True])
def test_z_buffer_paints_an_image_once(spark, exact):
    from pointweave.operators import visibility as vis

    rng = np.random.default_rng(5)
    n = 300
    xa, ya = rng.integers(0, 40, n), rng.integers(0, 20, n)
    pdf = pd.DataFrame({"scan_id": 0, "image_id": np.arange(n) % 3, "point_id": np.arange(n) // 2, "dist": rng.integers(1, 9, n) / 2,
                        "xa": xa, "xb": xa + rng.integers(1, 9, n), "ya": ya, "yb": ya + rng.integers(1, 9, n), "u": xa + 0.5, "v": ya + 0.5})
    best = {}
    for r in pdf.itertuples():
        for px in range(r.xa, r.xb):
            for py in range(r.ya, r.yb):
                key = (r.image_id, px, py)
                best[key] = min(best.get(key, (np.inf, 0, 0, 0)), (r.dist, r.point_id, int(r.u), int(r.v)))
    want = {(*k, b[1]) for k, b in best.items()}
    if exact:
        last = {}
        for (image, _, _), (_, point, px, py) in best.items():
            last[image, px, py] = max(last.get((image, px, py), -1), point)
        want = {(*k, p) for k, p in last.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # an image comes in many batches
    try:
        out = vis.z_buffer(spark.createDataFrame(pdf).repartition(5), exact=exact)
        got = [(r.image_id, r.px, r.py, r.point_id) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == want
    assert exact or "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()  # no second reduction


def test_a_point_in_the_camera_plane_has_no_pixel(spark):
    from pointweave.operators import camera as cam, visibility as vis

    _, images = _views_tables(spark)
    cams = cam.prepare_images(images.where("camera = 'pinhole'").withColumn("cz", F.lit(1.0)))
    points = spark.createDataFrame([(s, 7 + s, x, 2.0, 1.0) for s in (0, 1) for x in (1.0, 5.0)], "scan_id long, point_id long, x double, y double, z double")
    got = vis.projected_views(points, cams, 5.0, 0.5).collect()
    assert got and all(r.u is None and r.v is None and r.depth_z == 0 for r in got)


def test_nearest_join_across_many_blocks(spark, monkeypatch):
    """Tied distances, copies, a scan without points and blocks smaller than k: what lies behind a border is found, by few visits."""
    monkeypatch.setattr(celltree, "SMALL", 64)
    monkeypatch.setattr(celltree, "BLOCK", 64)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.integers(0, 12, (2400, 3)) / 4.0, columns=list("xyz"))
    pdf = pdf.assign(scan_id=np.arange(len(pdf)) % 2, point_id=rng.permutation(len(pdf)))
    q = pd.concat([pdf[:300], pdf[:5].assign(scan_id=9)])
    schema = "scan_id long, {} long, x double, y double, z double"
    frame = lambda p, name: spark.createDataFrame(p[["scan_id", "point_id", *"xyz"]], schema.format(name))
    for k in (7, 90):
        got = neighbours.knn_join(frame(q, "query_id"), frame(pdf, "point_id"), k)
        assert got_knn(got) == brute_knn(q, pdf, k)
    assert _rows_joined(neighbours.knn_join(frame(q, "query_id"), frame(pdf, "point_id"), 7)) <= 7 * len(q)


def test_best_overlaps_and_suppression_by_turns(spark):
    """One pair for each box, ties to the lower id; turns of suppression do not change what one turn keeps."""
    rng = np.random.default_rng(5)
    n = 240
    pdf = pd.DataFrame(rng.integers(0, 24, (n, 3)) / 8.0, columns=["cx", "cy", "cz"]).assign(dx=1.0, dy=1.0, dz=1.0, scan_id=0, box_id=np.arange(n))
    pdf["class"], pdf["score"] = np.arange(n) % 2, rng.integers(0, 50, n) / 64
    b = spark.createDataFrame(pdf)
    every = boxes.box_iou(b, b.where("box_id % 3 = 0"), ["class"]).toPandas()
    want = every.sort_values(["iou", "b_box_id"], ascending=[False, True]).groupby(["class", "a_box_id"]).first()["b_box_id"].to_dict()
    got = boxes.box_iou(b, b.where("box_id % 3 = 0"), ["class"], best=True).collect()
    assert {(r["class"], r.a_box_id): r.b_box_id for r in got} == want and len(got) == len(want)
    kept = lambda first: sorted(r.box_id for r in boxes.box_nms(b, 0.1, first=first).collect())
    assert kept(4) == kept(10**6)
