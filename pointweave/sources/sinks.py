"""Writers: coloured clouds, predictions, staged tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.prefix import number_rows


def colour_points(df: DataFrame, palette, label="label") -> DataFrame:
    """xyz with the class colour of a short palette; labels outside it are black."""
    table = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in palette])
    colour = F.try_element_at(table, F.when(F.col(label) >= 0, F.col(label) + 1).otherwise(F.lit(len(palette) + 1)).cast("int"))
    return df.withColumns({c: F.coalesce(colour[i], F.lit(0)) for i, c in enumerate("rgb")})


def write_points(df: DataFrame, path: str, palette, by="scan_id", label="label") -> None:
    colour_points(df, palette, label).select(by, "x", "y", "z", "r", "g", "b").write.mode("overwrite").partitionBy(by).parquet(path)


PLY_VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])


def ply_parts(df: DataFrame, by="scan_id", chunk: int = 1_000_000) -> DataFrame:
    """(by, part, content): binary PLY files of at most ``chunk`` points each, in point order."""
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        v = np.empty(len(pdf), PLY_VERTEX)
        for src, dst in zip(("x", "y", "z", "r", "g", "b"), PLY_VERTEX.names):
            v[dst] = pdf[src].to_numpy()
        kinds = {"f": "float", "u": "uchar"}
        props = "".join(f"property {kinds[PLY_VERTEX[n].kind]} {n}\n" for n in PLY_VERTEX.names)
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\n{props}end_header\n"
        return pd.DataFrame({by: [key[0]], "part": [key[1]], "content": [head.encode() + v.tobytes()]})

    parts = number_rows(df, [by], "point_id", "__rn").withColumn("part", F.floor((F.col("__rn") - 1) / chunk)).drop("__rn")
    kind = df.schema[by].dataType.simpleString()
    return parts.groupBy(by, "part").applyInPandas(pack, f"{by} {kind}, part long, content binary")


def window_predictions(preds: DataFrame, raw_ids) -> DataFrame:
    """(file, point_id, raw): train ids back to raw ids, one file name per window from its sequence, start and end."""
    table = F.array(*[F.lit(int(v)) for v in raw_ids])
    name = F.format_string("%04d_%010d_%010d", F.col("sequence"), F.col("start"), F.col("stop"))
    return preds.select(name.alias("file"), "point_id", F.try_element_at(table, F.col("pred").cast("int") + 1).alias("raw"))


def export_predictions(preds: DataFrame, raw_ids, path: str) -> None:
    rows = window_predictions(preds, raw_ids)
    rows.repartition("file").sortWithinPartitions("file", "point_id").write.mode("overwrite").partitionBy("file").parquet(path)


def scan_text(preds: DataFrame, valid_ids, by="scan_id") -> DataFrame:
    table = F.array(*[F.lit(int(v)) for v in valid_ids])
    return preds.select(by, "point_id", F.try_element_at(table, F.col("pred").cast("int") + 1).cast("string").alias("value"))


def export_scan_text(preds: DataFrame, valid_ids, path: str, by="scan_id") -> None:
    """One text folder per scan, a class id per line in point order; files of a scan are ranges of its points."""
    rows = scan_text(preds, valid_ids, by)
    rows.repartitionByRange(by, "point_id").sortWithinPartitions(by, "point_id").select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


class Stages:
    """Stored build stages: a stage that exists is read, a missing one is built, and all after it are rebuilt."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fresh = spark, root.rstrip("/"), True

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def stage(self, name: str, build, partition_by=()) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self.fresh or not self._exists(path):
            self.fresh = False
            build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.parquet(path)
