"""Distributed loops over edge tables: greedy selection and connected components.

Each round is a handful of joins and aggregates; lineage is cut by a
checkpoint after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut


def greedy_keep(edges: DataFrame, winner="winner", loser="loser") -> DataFrame:
    """Ids that greedy selection drops, given directed overlap edges from the better to the worse row.

    In each round every undecided row that no undecided row beats is kept and
    the rows it beats are dropped. Rows without edges are never dropped and
    need not be passed. The result equals taking the rows one by one in order.
    """
    e = cut(edges.select(F.col(winner).alias("w"), F.col(loser).alias("l")).distinct())
    dropped = e.select(F.col("l").alias("id")).limit(0)
    while not e.isEmpty():
        beaten = e.select(F.col("l").alias("w")).distinct()
        kept = e.join(beaten, "w", "left_anti")
        gone = cut(kept.select(F.col("l").alias("id")).distinct())
        dropped = dropped.unionByName(gone)
        lost = gone.withColumnRenamed("id", "w")
        roots = kept.select("w").distinct()
        e = cut(e.join(roots, "w", "left_anti").join(lost, "w", "left_anti")
                .join(gone.withColumnRenamed("id", "l"), "l", "left_anti").select("w", "l"))
    return dropped.distinct()


def components(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(id, root): the smallest id of each connected component, for all ids with an edge.

    Alternates two star contractions: every id sends its larger neighbours to
    the smallest id near it, then its smaller ones.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(small.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.*").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
