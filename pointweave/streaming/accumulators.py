"""The accumulating operators as Structured Streaming queries.

Event time must be a TIMESTAMP. State is keyed by window, voxel or class pair,
never by a whole scan, and lives in the state store.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.maths import half_even
from ..operators.metrics import confusion
from ..operators.neighbours import radius_join
from ..operators.voxel import VOXEL

SCAN = ("scan_id",)
streaming_confusion = confusion


def streaming_votes(stream: DataFrame, n: int, watermark: str = "1 hour", by=SCAN) -> DataFrame:
    """Vote sums per (window, point): a repeat of (sample, point) within the watermark counts once. Update or complete mode."""
    one = stream.withWatermark("sample_ts", watermark).dropDuplicatesWithinWatermark([*by, "sample_id", "point_id"])
    return one.groupBy(*by, "point_id").agg(F.count("*").alias("n_votes"), *[F.sum(F.col("scores")[i]).alias(f"s{i}") for i in range(n)])


def streaming_meters(stream: DataFrame, by=("stage", "name"), value="value", window: str | None = None, watermark="1 hour") -> DataFrame:
    """Mean, sample variance and count per group, or per tumbling window of event time."""
    keys = [F.col(k) for k in by]
    if window:
        stream = stream.withWatermark("ts", watermark)
        keys = [F.window("ts", window).alias("window"), *keys]
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))


def streaming_voxels(stream: DataFrame, size: float, by=SCAN) -> DataFrame:
    """A grid-sampled map kept up to date: sums and counts per voxel."""
    cells = stream.withColumns({f"v{a}": half_even(F.col(a) / size) for a in "xyz"})
    return cells.groupBy(*by, *VOXEL).agg(*[F.avg(a).alias(a) for a in "xyz"], F.max("point_id").alias("point_id"), F.count("*").alias("n"))


def streaming_tsdf(stream: DataFrame, trunc: float) -> DataFrame:
    """Signed distance mean and weight per voxel of arriving observations (volume, i, j, k, depth, z)."""
    diff = F.col("depth") - F.col("z")
    rows = stream.where((F.col("depth") > 0) & (diff >= -trunc))
    return rows.groupBy("volume", "i", "j", "k").agg(F.avg(F.least(F.lit(1.0), diff / trunc)).alias("tsdf"), F.count("*").alias("w"))


def static_views(stream: DataFrame, images: DataFrame, r_max: float, by=SCAN) -> DataFrame:
    """Arriving points joined to the stored image table by cells."""
    cams = images.select(*by, "image_id", *[F.col(f"c{a}").alias(a) for a in "xyz"])
    return radius_join(cams, stream, r_max, by, "image_id", "point_id", strict=True)


#: Buckets that the points of a window are dealt to; a bucket has one state.
BUCKETS = 1024


def vote_by_window(stream: DataFrame, n: int, by=SCAN, watermark="1 hour", ts="sample_ts", ttl_ms: int = 3_600_000) -> DataFrame:
    """Votes kept per (window, point) by a custom stateful operator, with the samples seen so far in its state.

    Emits the new totals of each point that changed. A call into Python and a state for each point would cost far more than
    the votes, so the points of a window are dealt to BUCKETS, which also spreads a large window over the state partitions;
    a state holds the points of its bucket. A point leaves it once the watermark is ttl_ms past its last row.
    """
    keys = [*by, "point_id"]
    type_of = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    kinds = ", ".join(f"{k} {type_of[k]}" for k in keys)
    held = f"ids array<{type_of['point_id']}>, n array<long>, s array<double>, seen array<long>, n_seen array<long>, last array<long>"

    def load(state) -> dict:
        """Per point: count, sums, samples seen and the time of its last row."""
        if not state.exists:
            return {}
        ids, counts, sums, seen, n_seen, last = (list(v) for v in state.get)
        ends = [0, *np.cumsum(n_seen).tolist()]
        return {p: [counts[i], sums[i * n: (i + 1) * n], set(seen[ends[i]: ends[i + 1]]), last[i]] for i, p in enumerate(ids)}

    def keep(state, points: dict) -> None:
        if not points:
            state.remove()
            return
        counts, sums, seen, last = zip(*points.values())
        state.update((list(points), list(counts), [v for s in sums for v in s], [v for s in seen for v in sorted(s)], [len(s) for s in seen], list(last)))
        state.setTimeoutTimestamp(min(last) + ttl_ms)

    def update(key, batches, state):
        points, now = load(state), state.getCurrentWatermarkMs()
        changed = set()
        for pdf in [] if state.hasTimedOut else batches:
            pdf = pdf.sort_values("row_id", kind="stable")
            when = pdf[ts].to_numpy().astype("datetime64[ms]")
            when = np.where(np.isnat(when), now, when.astype(np.int64)).tolist()
            votes: dict = {}
            for point, sample, scores, time in zip(pdf["__id"].tolist(), pdf["sample_id"].tolist(), pdf["scores"].tolist(), when):
                one = points.get(point)
                if one is None:
                    one = points[point] = [0, [0.0] * n, set(), now]
                one[3] = max(one[3], now, time)
                own = votes.setdefault(point, {})
                own.pop(int(sample), None)  # of two rows the last counts, at its place
                own[int(sample)] = scores
            for point, own in votes.items():
                one = points[point]
                for sample, scores in own.items():
                    if sample not in one[2]:
                        one[2].add(sample)
                        one[0] += 1
                        one[1] = [a + float(b) for a, b in zip(one[1], scores)]
            changed |= votes.keys()
        keep(state, {p: one for p, one in points.items() if p in changed or one[3] + ttl_ms >= now})
        if changed:
            null = key[-1] < 0
            out = {**{k: [v] * len(changed) for k, v in zip(by, key)}, "point_id": [None if null else p for p in changed]}
            yield pd.DataFrame({**out, "n_votes": [points[p][0] for p in changed], "scores": [points[p][1] for p in changed]})

    # Points without an id are one point, in a bucket of its own.
    bucket = F.when(F.col("point_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("point_id"), F.lit(BUCKETS)).cast("int"))
    dealt = stream.withWatermark(ts, watermark).withColumns({"__bucket": bucket, "__id": F.coalesce("point_id", F.lit(0).cast(type_of["point_id"]))})
    return dealt.groupBy(*by, "__bucket").applyInPandasWithState(update, f"{kinds}, n_votes long, scores array<double>", held, "update", "EventTimeTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain the available input into Parquet files beside the checkpoint and read them: of a complete output the last batch."""
    path = f"{checkpoint}-{name}"
    shape = stream.select("*", F.lit(0).cast("long").alias("__batch")).schema

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)

    spark = stream.sparkSession
    spark.createDataFrame([], shape).write.mode("append").parquet(path)
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(shape).parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("__batch") == rows.agg(F.max("__batch")).scalar())
    return rows.drop("__batch")
