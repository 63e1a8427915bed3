"""Cutting the lineage of loops, on storage that survives a lost executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A local session without one gets one of its own; on a cluster
    a folder of one machine would be of no use, so there it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or f"file:///tmp/checkpoints/{sc.applicationId}"
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
