"""Exact de-duplication by skew-safe combining, DataFrame operations only.

Digests are counted first (combined before the shuffle). While the repeated ones are few by count, they go to every task
and only rows whose digest occurs twice or more move with their text. Beyond that the digests of large groups still go to
every task, or by adaptive execution where even they are too many, so that no large group meets in a join, and the other
rows move once to the counts of theirs. Rows of repeated digests are combined three times, each time comparing the full content beside the digest: within each task (the
partial aggregate), per salted digest group, and over the salts' winners. The number of salts of a digest follows its
count, so no task meets a large group whole.

Defined results: a null text counts as empty; of equal texts the largest doc_id stays, null being the smallest; of rows
with the same text and doc_id exactly one stays; an empty table gives an empty result. Extra columns are carried
untouched by `deduplicate` and ignored by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import join_narrow, stored

#: Rows of one digest that share a salt.
ROWS_PER_SALT = 2000


def _digests(docs: DataFrame) -> DataFrame:
    """One column `row` with all columns (names cannot clash), the id, the text and its digest."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return packed.select("row", F.col("row.doc_id").alias("id"), text.alias("body"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _repeated(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.select("digest", (F.col("n") / ROWS_PER_SALT).cast("int").alias("salts"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("id", "uid"), F.col("salts") + 1).cast("int")


def _winners(repeated: DataFrame) -> DataFrame:
    """The winning row number and id and the size of each class of equal texts."""
    best = F.max(F.struct("id", "uid")).alias("best")
    by_salt = repeated.groupBy("digest", "salts", _salt().alias("salt"), "body").agg(best, F.count(F.lit(1)).alias("n"))
    return by_salt.groupBy("digest", "salts", "body").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))


def _split(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    rows = _digests(docs)
    repeated = stored(_repeated(rows))
    many = repeated.count()
    if many <= common.BROADCAST_ROWS:
        marked = join_narrow(rows, repeated, "digest", "left", many)
    else:
        large = join_narrow(rows, repeated.filter("salts > 0"), "digest", "left")
        rest = large.filter("salts IS NULL").drop("salts").join(repeated.filter("salts = 0").hint("shuffle_merge"), "digest", "left")
        marked = large.filter("salts IS NOT NULL").unionByName(rest)
    single = marked.filter("salts IS NULL").select(*columns)
    copies = marked.filter("salts IS NOT NULL").select(*columns, "body", "salts", F.monotonically_increasing_id().alias("uid"))
    return single, stored(copies)  # numbered once: a task that runs again reads the same numbers


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, keep_id (the one that stays), group_size, kept, text_sha256."""
    single, copies = _split(docs.select("doc_id", "text"), ["id", "digest"])
    winners = _winners(copies).withColumn("salt", F.explode(F.expr("sequence(0, salts)"))).drop("salts")
    met = copies.withColumn("salt", _salt()).join(winners, ["digest", "salt", "body"])
    of_copies = met.select("id", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"))
    of_single = single.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return of_single.union(of_copies).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    single, copies = _split(docs, ["row", "id", "digest"])
    stay = _winners(copies).select(F.col("best.uid").alias("uid"))
    return single.select("row.*").union(copies.join(stay, "uid", "left_semi").select("row.*"))


def query(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
