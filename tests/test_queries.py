"""Registered queries against their SQL. All of them with TEST_ALL=1, otherwise one or two per family."""

import os

import pytest

from catalog import CASES
from tools.check import compare, duck

SOME = ["C1_save_point_id", "C14_instance_targets", "C18_rows_to_csr", "C21_clamp_batch", "A23_drop_corrupt_frames", "D0_grid_sample",
        "D1_radius_join_nearest", "D2_knn_join", "D5_neighbour_histogram", "E1_cloud_pca", "E6_occlusion", "H6_splat_box", "H8_z_buffer_exact",
        "H12_map_images", "H12_map_images_rows", "I8_merge_points", "J7_crop_groups", "J11_gather_bilinear", "K4_attention_pool", "L5_sampling_plan",
        "M6_lovasz_score", "M7_vote", "M13_average_precision", "N9_detection_ap", "N12_grow_regions", "O1_overlap_matches", "O10_feature_matches",
        "P4_volume_bounds", "P5_tsdf", "F7_fixed_count_and_drop", "F14_density_filter", "G2_rotate", "G9_elastic", "A1_read_room_text",
        "A16_read_pair_log", "B2_write_window_predictions", "Q4_steps_from_config", "S2_streaming_votes", "S4_window_grouping"]
NAMES = [n for n, (_, sql) in CASES.items() if sql and (os.environ.get("TEST_ALL") or n in SOME)]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf, name):
    fn, sql = CASES[name]
    assert compare(fn(spark, sf).toPandas(), con.execute(sql).df()) is None


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["scan_id", "image_id", "n_points", "n_pixels", "mean_depth"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
