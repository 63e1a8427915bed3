"""Readers of formats that Spark does not write itself."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.sources import binary, poses, sinks, text


def test_lidar_bits_keep_the_sign(spark, tmp_path):
    seq = tmp_path / "00"
    (seq / "velodyne").mkdir(parents=True)
    (seq / "labels").mkdir()
    xyz = np.arange(12, dtype="<f4").reshape(3, 4)
    raw = np.array([0x00010005, 0xFFFF0007, 0x7FFF0001], dtype="<u4")
    (seq / "velodyne" / "000001.bin").write_bytes(xyz.tobytes())
    (seq / "labels" / "000001.label").write_bytes(raw.tobytes())
    df = binary.read_lidar_bin(spark, f"{tmp_path}/*/velodyne/*.bin", f"{tmp_path}/*/labels/*.label").orderBy("point_id")
    assert [(r.sequence, r.frame, r.x, r.label, r.instance) for r in df.collect()] == [("00", "000001", 0.0, 5, 1), ("00", "000001", 4.0, 7, -1), ("00", "000001", 8.0, 1, 32767)]
    (seq / "labels" / "000001.label").write_bytes(raw[:2].tobytes())
    with pytest.raises(Exception, match="different lengths"):
        binary.read_lidar_bin(spark, f"{tmp_path}/*/velodyne/*.bin", f"{tmp_path}/*/labels/*.label").collect()


def test_shape_parts_number_val_after_train(spark, tmp_path):
    (tmp_path / "train_test_split").mkdir()
    files = {"train": ["shape_data/A/a1", "shape_data/B/b1", "shape_data/A/a2"], "val": ["shape_data/A/a3"]}
    for k, v in files.items():
        (tmp_path / "train_test_split" / f"shuffled_{k}_file_list.json").write_text(json.dumps(v))
    for n in ("a1", "a2", "a3"):
        (tmp_path / "A").mkdir(exist_ok=True)
        (tmp_path / "A" / f"{n}.txt").write_text("0.5 1 2 0 0 1 3.000000\n1 1 1 0 1 0 2.0\n")
    got = text.read_shape_text(spark, str(tmp_path), "trainval", {"A": 0})
    assert sorted({(r.scan_id, r.part) for r in got.collect()}) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 2), (2, 3)]


def test_odometry_moves_points_and_keeps_the_sensor(spark, tmp_path):
    d = tmp_path / "05"
    d.mkdir()
    eye = "1 0 0 {} 0 1 0 {} 0 0 1 {}"
    (d / "calib.txt").write_text("P0: 1 2 3\nTr: " + eye.format(1, 0, 0) + "\n")
    (d / "poses.txt").write_text(eye.format(0, 10, 0) + "\n" + eye.format(0, 20, 0) + "\n")
    pts = spark.createDataFrame([("05", "a", 0.0, 0.0, 0.0), ("05", "b", 1.0, 1.0, 1.0)], "sequence string, frame string, x double, y double, z double")
    got = {r.frame: (r.x, r.y, r.z, r.sensor_x, r.sensor_y) for r in poses.read_odometry(spark, str(tmp_path), "05", pts).collect()}
    assert got == {"a": (1.0, 10.0, 0.0, 1.0, 10.0), "b": (2.0, 21.0, 1.0, 1.0, 20.0)}


def test_scan_images_follow_the_alignment(spark, tmp_path):
    for scan, align in (("s1", True), ("s2", False)):
        (tmp_path / scan / "pose").mkdir(parents=True)
        (tmp_path / scan / "intrinsic").mkdir()
        (tmp_path / scan / "pose" / "7.txt").write_text("1 0 0 2\n0 1 0 3\n0 0 1 4\n0 0 0 1\n")
        (tmp_path / scan / "intrinsic" / "intrinsic_depth.txt").write_text("580 0 320 0\n0 580 240 0\n0 0 1 0\n0 0 0 1\n")
        line = "axisAlignment = 1 0 0 5 0 1 0 0 0 0 1 0 0 0 0 1\n" if align else ""
        (tmp_path / scan / f"{scan}.txt").write_text(f"scan = 1\n{line}")
    got = {r.scan: r for r in poses.read_scan_images(spark, str(tmp_path), 320, 240).collect()}
    assert (got["s1"].cx, got["s2"].cx, got["s1"].cy, got["s1"].fx, got["s1"].image_id) == (7.0, 2.0, 3.0, 290.0, 7)


def test_stages_rebuild_after_a_missing_one(spark, tmp_path):
    built = []

    def make(name, n):
        return lambda: built.append(name) or spark.range(n)

    for _ in range(2):
        s = sinks.Stages(spark, str(tmp_path))
        s.stage("a", make("a", 1)), s.stage("b", make("b", 2)), s.stage("c", make("c", 3))
    assert built == ["a", "b", "c"]
    (tmp_path / "b" / "_SUCCESS").unlink()
    s = sinks.Stages(spark, str(tmp_path))
    s.stage("a", make("a", 1)), s.stage("b", make("b", 2)), s.stage("c", make("c", 3))
    assert built == ["a", "b", "c", "b", "c"]
