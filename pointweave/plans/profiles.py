"""Data set profiles: reader, label table, splits and pipeline options under one name."""

from __future__ import annotations

from ..sources import binary, text

# The classes of the indoor scans and of the lidar sequences by raw id, and fold lists.
SCAN_CLASSES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 24, 28, 33, 34, 36, 39]
ROOM_VALIDATION = ["hallway_1", "hallway_6", "hallway_11", "office_1", "office_6", "office_11", "office_16", "office_21", "office_26",
                   "office_31", "office_36", "WC_2", "storage_1", "storage_5", "conferenceRoom_2", "auditorium_1"]
LIDAR_SPLITS = {"train": ["00", "01", "02", "03", "04", "05", "06", "07", "09", "10"], "val": ["08"],
                "test": ["11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "21"]}

PROFILES = {
    "rooms": dict(reader=text.read_room_text, voxel=0.02, classes=text.ROOM_CLASSES, val_rooms=ROOM_VALIDATION, region="sphere", radius=2.0),
    "rooms-blocks": dict(reader=text.read_room_text, voxel=0.02, classes=text.ROOM_CLASSES, val_rooms=ROOM_VALIDATION, region="cylinder", radius=0.5),
    "rooms-cylinders": dict(reader=text.read_room_text, voxel=0.02, classes=text.ROOM_CLASSES, val_rooms=ROOM_VALIDATION, region="cylinder", radius=2.0),
    "rooms-images": dict(reader=text.read_room_text, voxel=0.02, classes=text.ROOM_CLASSES, val_rooms=ROOM_VALIDATION, region="sphere", radius=2.0,
                         mapping=dict(r_max=8.0, upscale=2, k=50, width=1024, height=512)),
    "scans": dict(reader=binary.read_mesh_vertices, voxel=0.02, valid_ids=SCAN_CLASSES, region="scan"),
    "scans-panoptic": dict(reader=binary.read_mesh_vertices, voxel=0.02, valid_ids=SCAN_CLASSES, region="scan", instances=True),
    "scans-boxes": dict(reader=binary.read_mesh_vertices, voxel=0.02, valid_ids=SCAN_CLASSES, region="scan", boxes=True),
    "scans-images": dict(reader=binary.read_mesh_vertices, voxel=0.02, valid_ids=SCAN_CLASSES, region="scan", mapping=dict(r_max=4.0, method="depth")),
    "streets": dict(reader=binary.read_ply_windows, voxel=0.05, region="cylinder", radius=6.0),
    "streets-images": dict(reader=binary.read_ply_windows, voxel=0.05, region="cylinder", radius=6.0, mapping=dict(r_max=20.0, width=1408, height=376, every=5)),
    "lidar": dict(reader=binary.read_lidar_bin, voxel=0.05, splits=LIDAR_SPLITS, region="scan"),
    "shape-parts": dict(reader=text.read_shape_text, region="scan"),
    "shapes": dict(reader=text.read_classified_shapes, region="scan"),
    "pairs-fragments": dict(reader=binary.read_mesh_vertices, voxel=0.02, pairs=text.read_pair_log),
    "pairs-clouds": dict(reader=text.read_cloud_csv, voxel=0.08, pairs=text.read_pair_file),
    "pairs-pcd": dict(reader=text.read_pcd_ascii, voxel=0.06, pairs=text.read_pair_file),
}


def profile(name: str, **options) -> dict:
    """The options of a named profile with the caller's changes."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}, known: {sorted(PROFILES)}")
    return {**PROFILES[name], **options}


def load(spark, name: str, root: str, **options):
    """Read a profile's point table from a root folder."""
    p = profile(name, **options)
    return p["reader"](spark, root, **p.get("reader_options", {}))
