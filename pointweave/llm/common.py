"""What the operators share: the shared folder, stored intermediate tables, checked broadcasts, words."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, and the controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: A side of at most this many narrow rows (ids and a few numbers) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Only a local session, whose executor is the driver, gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_narrow(big: DataFrame, narrow: DataFrame, on: str | list[str], how: str, rows: int | None = None) -> DataFrame:
    """`big` joined with a stored table of a few numbers a row. It is broadcast when its counted rows are within
    BROADCAST_ROWS, so that the texts on the other side stay where they are; otherwise both sides shuffle."""
    n = narrow.count() if rows is None else rows
    return big.join(F.broadcast(narrow) if n <= BROADCAST_ROWS else narrow.hint("shuffle_merge"), on, how)


def whole_text(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; every executor has the package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Tokenizer libraries must not start threads of their own inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def kept(memo, name: str, make):
    """What a worker keeps from task to task: `memo` is a broadcast empty dictionary, which lives as long in each worker."""
    if name not in memo.value:
        memo.value[name] = make()
    return memo.value[name]


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Fewer rows per Arrow batch where rows hold whole texts, so that a batch of long ones fits a worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
