"""Binary point files. A file is one row; each task turns its files into rows with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# PLY type names and their numpy codes.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
             "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
CHUNK = 500_000


def ply_vertices(content: bytes) -> np.ndarray:
    """The vertex element of a binary PLY as a structured array."""
    end = content.index(b"end_header\n") + len(b"end_header\n")
    order, fields, count, here = "<", [], 0, False
    for line in content[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            order = ">" if words[1] == "binary_big_endian" else "<"
        elif words[:1] == ["element"]:
            here = words[1] == "vertex"
            count = int(words[2]) if here else count
        elif words[:1] == ["property"] and here:
            fields.append((words[2], order + PLY_TYPES[words[1]]))
    return np.frombuffer(content, dtype=np.dtype(fields), count=count, offset=end)


def read_ply(spark: SparkSession, path: str, columns) -> DataFrame:
    """(path, point_id, asked columns); a column the file lacks is NULL."""
    columns = list(columns)

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                v = ply_vertices(content)
                for lo in range(0, len(v), CHUNK):
                    part = v[lo: lo + CHUNK]
                    out = {"path": name, "point_id": np.arange(lo, lo + len(part))}
                    out |= {c: part[c].astype(float) if c in v.dtype.names else np.full(len(part), np.nan) for c in columns}
                    yield pd.DataFrame(out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(parse, "path string, point_id long, " + ", ".join(f"{c} double" for c in columns))
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def read_ply_windows(spark, path: str, columns=("x", "y", "z", "red", "green", "blue", "semantic", "instance"), train_ids: dict | None = None) -> DataFrame:
    """Street windows: colours as 0..1, semantic ids remapped, columns on demand."""
    df = read_ply(spark, path, columns)
    names = {"red": "r", "green": "g", "blue": "b", "semantic": "label"}
    df = df.withColumns({c: F.col(c) / 255 for c in ("red", "green", "blue") if c in columns})
    df = df.withColumns({c: F.col(c).cast("int") for c in ("semantic", "instance") if c in columns}).withColumnsRenamed({k: v for k, v in names.items() if k in columns})
    if train_ids is not None and "semantic" in columns:
        table = F.create_map(*[F.lit(x) for pair in train_ids.items() for x in pair])
        df = df.withColumn("label", F.when(F.col("label").isNotNull(), F.coalesce(F.try_element_at(table, F.col("label")), F.lit(-1))))
    return df.withColumn("window_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.ply$", "")).drop("path")


def read_mesh_vertices(spark, path: str, rgb=False) -> DataFrame:
    return read_ply(spark, path, ["x", "y", "z"] + (["red", "green", "blue"] if rgb else []))


def split_label(df: DataFrame, raw="raw") -> DataFrame:
    """Semantic in the low 16 bits, instance in the high 16 of an int32, so the shift keeps the sign."""
    v = F.col(raw).cast("int")
    return df.withColumns({"label": v.bitwiseAND(F.lit(0xFFFF)), "instance": F.shiftright(v, 16)})


def read_lidar_bin(spark, scans: str, labels: str | None = None) -> DataFrame:
    """sequence/velodyne/frame.bin of float32 x, y, z, remission and sequence/labels/frame.label; unequal row counts raise."""
    def rows(dtype, names):
        def parse(batches):
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"]):
                    a = np.frombuffer(content, dtype=dtype).reshape(-1, len(names))
                    parts = path.split("/")
                    for lo in range(0, len(a), CHUNK):
                        p = a[lo: lo + CHUNK]
                        out = {"sequence": parts[-3], "frame": parts[-1].rsplit(".", 1)[0], "point_id": np.arange(lo, lo + len(p)), "n": len(a)}
                        yield pd.DataFrame(out | {n: p[:, i] for i, n in enumerate(names)})
        return parse

    read = lambda path: spark.read.format("binaryFile").load(path).select("path", "content")
    key = "sequence string, frame string, point_id long, n long"
    pts = read(scans).mapInPandas(rows("<f4", ["x", "y", "z", "remission"]), f"{key}, x float, y float, z float, remission float")
    if labels is None:
        return pts.drop("n")
    lab = read(labels).mapInPandas(rows("<i4", ["raw"]), f"{key}, raw int").withColumnRenamed("n", "m")
    j = pts.join(lab, ["sequence", "frame", "point_id"], "left")
    equal = F.assert_true(F.col("n") == F.coalesce("m", F.lit(-1)), "scan and label file have different lengths")
    return split_label(j.withColumn("raw", F.when(equal.isNull(), F.col("raw")))).drop("n", "m", "raw")
