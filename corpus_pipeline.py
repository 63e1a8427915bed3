"""The documents of a corpus cleaned and packed: five stages, each reading what its predecessor wrote.

1. quality classifier: documents that it rejects go;
2. exact de-duplication: of equal texts the one with the largest doc_id stays;
3. near-duplicates: of each class the document with the least doc_id stays;
4. secret scan: secrets are replaced by a mark, the documents stay;
5. best-fit packing: one row per piece of a document and its place in a sequence.

The classifier and the near-duplicates have no equivalent in SQL, so there is none for the whole; tests compare the
stages with plain versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import bag_minhash, exact_dedup, packing, secret_scan, weak_quality
from pointweave.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bag_minhash.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
