"""Class balance and sampling plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.prefix import number_rows, running
from ..functions.rand import key_hash, uniform


def class_weights(df: DataFrame, n: int, method: str = "sqrt", label="label") -> DataFrame:
    """Weight per class from the counts, normalised to sum 1; a missing class counts 1, other labels are left out."""
    counts = df.where((F.col(label) >= 0) & (F.col(label) < n)).groupBy(label).agg(F.count("*").alias("__n"))
    full = df.sparkSession.range(n).select(F.col("id").cast("int").alias(label)).join(counts, label, "left")
    full = full.withColumn("__n", F.coalesce("__n", F.lit(1)))
    # n rows, one per class.
    every = W.partitionBy(F.lit(0))
    full = full.withColumn("w", F.avg("__n").over(every) / F.col("__n"))
    if method == "sqrt":
        full = full.withColumn("w", F.sqrt("w"))
    elif method == "log":
        full = full.withColumn("w", F.log(1.1 + F.col("w") / F.sum("w").over(every)))
    elif method != "plain":
        raise ValueError(f"unknown method {method!r}")
    return full.select(label, (F.col("w") / F.sum("w").over(every)).alias("weight"))


def balance_probabilities(centres: DataFrame, label="label") -> DataFrame:
    """Root of mean(count)/count per class present, normalised."""
    every = W.partitionBy(F.lit(0))
    n = centres.groupBy(label).agg(F.count("*").alias("n"))
    n = n.withColumn("w", F.sqrt(F.avg("n").over(every) / F.col("n")))
    return n.select(label, "n", (F.col("w") / F.sum("w").over(every)).alias("p"))


def _draw_classes(draws: DataFrame, classes: DataFrame, u, label) -> DataFrame:
    """Class of each draw by the cumulative probabilities, held as one short array row."""
    order = W.partitionBy(F.lit(0)).orderBy(label)
    cum = classes.withColumn("__c", F.sum("p").over(order.rowsBetween(W.unboundedPreceding, 0)))
    table = cum.agg(F.array_sort(F.collect_list(F.struct("__c", label, "n"))).alias("t"))
    hit = F.filter("__t", lambda e: e["__c"] > F.col("__u"))
    out = draws.withColumns({"__u": u, "__t": table.scalar()})
    out = out.withColumn("__h", F.coalesce(F.try_element_at(hit, F.lit(1)), F.element_at("__t", -1)))
    return out.select(*draws.columns, F.col(f"__h.{label}").alias(label), F.col("__h.n").alias("__n"))


def draw_balanced(df: DataFrame, n: int, seed, row_id: str, method="balanced", label="label", by=()) -> DataFrame:
    """n draws with replacement: a class by its balance probability, then one of its rows uniformly: (draw, label, by, row).

    ``by`` names the columns that make row_id unique.
    """
    by = list(by)
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    if method == "uniform":
        classes = df.groupBy(label).agg(F.count("*").alias("n"))
        classes = classes.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))
    else:
        classes = balance_probabilities(df, label)
    drawn = _draw_classes(draws, classes, uniform(f"{seed}/class", "draw"), label)
    drawn = drawn.withColumn("rn", F.floor(uniform(f"{seed}/row", "draw") * F.col("__n")) + 1).drop("__n")
    ranked = number_rows(df.select(label, *by, row_id), [label], row_id, "rn", order=[F.col(row_id), *map(F.col, by)])
    return drawn.join(ranked, [label, "rn"]).select("draw", label, *by, row_id)


def draw_label_window(centres: DataFrame, n: int, seed, window="window_id", label="label", row_id="centre_id", ignore=(-1,)) -> DataFrame:
    """n draws: a class uniformly among those seen, a window by its share of it, a random centre of that class there.

    A window by share and then a row of it uniformly is one row of the class
    uniformly in (window, row) order, so one numbering serves.
    """
    good = centres.where(~F.col(label).isin(*ignore))
    classes = good.groupBy(label).agg(F.count("*").alias("n"))
    classes = classes.withColumn("p", F.lit(1.0) / F.count("*").over(W.partitionBy(F.lit(0))))
    draws = centres.sparkSession.range(n).withColumnRenamed("id", "draw")
    drawn = _draw_classes(draws, classes, uniform(f"{seed}/class", "draw"), label)
    drawn = drawn.withColumn("rn", F.floor(uniform(f"{seed}/row", "draw") * F.col("__n")) + 1).drop("__n")
    ranked = running(good.select(label, window, row_id), [label], [F.col(window), F.shiftright(row_id, 16)], [F.col(row_id)], {"rn": F.lit(1).cast("long")})
    return drawn.join(ranked, [label, "rn"]).select("draw", label, window, row_id)


def sampling_plan(draws: DataFrame, m: int, seed, window="window_id", draw="draw") -> DataFrame:
    """Position of each draw so that a window comes in runs of at most m, the runs shuffled."""
    ranked = number_rows(draws, [window], draw, "__rn").withColumn("run", F.floor((F.col("__rn") - 1) / m))
    ranked = ranked.withColumn("__h", key_hash(seed, window, "run"))
    out = running(ranked, [], [F.shiftright("__h", 20), F.col("__h"), F.col(window), F.col("run")], [F.col("__rn")], {"position": F.lit(1).cast("long")})
    return out.withColumn("position", F.col("position") - 1).drop("__rn", "__h")
