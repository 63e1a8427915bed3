"""Nearest neighbours by inner product through a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its permutation: the PREFIX nearest pivots in
order. It is posted in the inverted files of its POSTS first pivots. A query opens the files of its own first pivots,
ranks what is posted there by the footrule distance of the permutations, and reranks the best by exact inner products.

How many files a query opens, and up to which footrule distance it reranks, is learnt: the true neighbours of a sample of
SAMPLE queries are found by brute force over all vectors, and both bounds are set so that each loses at most a quarter of
what RECALL allows. In every file at least the k best by footrule are reranked, and queries that find fewer than k rows
open all files. Directions alone do not tell inner products apart where lengths differ, so files are kept by length: a
band holds vectors whose lengths differ by less than a factor of two, and each band has bounds of its own.

Equal vectors are one entry of the index with at most k + 1 ids, which is exact because ties go to the smaller id. Long
files are split into blocks of BLOCK_BYTES, and the queries of much asked blocks into slices, so no task meets a whole file. Entries
and queries of one block and slice are dealt to one place and sorted, entries first; a task holds one block.

Only the pivots (at most PIVOT_BYTES), the sample, and two numbers per file reach the driver.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; rows equal in id and vector count once; shorter vectors read as ending in zeros; rank goes by score, then
by smaller id; a table with fewer than k other rows returns them all; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, stored

K = 20
#: Pivots kept of a permutation, files a vector is posted in, and what the search aims at.
PREFIX, POSTS, RECALL = 16, 2, 0.9
#: Queries whose true neighbours are found to learn the bounds.
SAMPLE = 256
#: Pivots: the square root of the number of distinct vectors, within these bounds.
MOST_PIVOTS, PIVOT_BYTES = 8192, 64 << 20
#: Entries of a block, in bytes of vectors, and queries of a slice.
BLOCK_BYTES, SLICE = 2 << 20, 4096
#: Queries compared with a block at once; queries whose hits a task holds before it passes them on.
AT_ONCE, HELD = 128, 20_000


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """id, v: rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(sound & F.exists("v", lambda x: x != 0))


def coded(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """id, digest, v (the components as little-endian numbers of one width)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            n = v.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((len(v), width))
            whole[np.arange(width) < n[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            data = [x.tobytes() for x in (whole + 0.0).astype(kind)]  # + 0.0: there is one zero only
            yield pa.record_batch([b.column("id"), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary()), pa.array(data, pa.binary())], names=["id", "digest", "v"])

    return rows.mapInArrow(run, "id long, digest binary, v binary")


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.float64)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component on, so that they do not depend on batches."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


class Pivots:
    """Directions of the pivots."""

    def __init__(self, vectors: np.ndarray):
        self.unit = self._unit(vectors)
        self.prefix = min(PREFIX, len(vectors))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True))

    def order(self, x: np.ndarray, many: int) -> np.ndarray:
        """The nearest pivots in order."""
        near = -(self._unit(x) @ self.unit.T)
        if many < near.shape[1]:
            some = np.argpartition(near, many - 1, 1)[:, :many]
            return np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), 1, kind="stable"), 1)
        return np.argsort(near, 1, kind="stable")

    @staticmethod
    def band(x: np.ndarray) -> np.ndarray:
        """Lengths within a factor of two; the borders lie off the powers of two, where unit vectors are."""
        most = np.abs(x).max(1)
        length = np.log2(most) + np.log2((x / most[:, None] * (x / most[:, None])).sum(1)) / 2
        return np.floor(length + 0.5).astype(np.int32)


def far(a: np.ndarray, b: np.ndarray) -> int:
    """The footrule distance of two prefixes; a pivot that one of them lacks counts as its last place + 1."""
    at = {p: i for i, p in enumerate(a.tolist())}
    other = {p: i for i, p in enumerate(b.tolist())}
    n = len(a)
    return sum(abs(at.get(p, n) - other.get(p, n)) for p in at.keys() | other.keys())


class Block:
    """Entries of one block of one file: the places of all pivots in their permutations, and their vectors."""

    def __init__(self, n_pivots: int, prefixes: np.ndarray, vectors: np.ndarray, ids: np.ndarray, digests: list[bytes]):
        n, last = prefixes.shape
        self.last, self.vectors, self.ids, self.digests = last, vectors, ids, digests
        self.place = np.full((n_pivots, n), last, np.uint8)  # pivot by pivot, as an inverted file
        self.place[prefixes, np.arange(n)[:, None]] = np.arange(last, dtype=np.uint8)

    def footrule(self, prefixes: np.ndarray) -> np.ndarray:
        """Distances of queries to the entries. |i - j| over the union of two prefixes of n pivots is
        2 * sum(max(i, j)) + a constant over the query's pivots, with j = n for those that the entry lacks."""
        total = np.zeros((len(prefixes), len(self.ids)), np.int32)
        for i in range(self.last):
            total += np.maximum(self.place[prefixes[:, i]], np.uint8(i))
        return 2 * total - self.last * (self.last - 1)

    def best(self, prefixes: np.ndarray, queries: np.ndarray, k: int, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the entries with the k largest inner products among those up to `limit` and the k first by
        footrule, and the products."""
        rank = self.footrule(prefixes)
        if len(self.ids) > k:
            limits = np.maximum(np.partition(rank, k - 1, 1)[:, k - 1], limit)
        else:
            limits = np.full(len(rank), rank.max(initial=0))
        about = queries @ self.vectors.T
        slack = 1e-12 * (np.abs(queries) @ np.abs(self.vectors).T).max(1, initial=0)
        about[rank > limits[:, None]] = -np.inf
        if about.shape[1] > k:
            least = np.partition(about, about.shape[1] - k, 1)[:, about.shape[1] - k]
        else:
            least = np.full(len(about), -np.inf)
        q, x = np.nonzero((about >= (least - slack)[:, None]) & (about > -np.inf))
        score = inner(queries[q], self.vectors[x])
        order = np.lexsort((self.ids[x], -score, q))
        q, x, score = q[order], x[order], score[order]
        cut = np.searchsorted(q, np.arange(len(queries) + 1))
        return [(x[a:min(b, a + k)], score[a:min(b, a + k)]) for a, b in zip(cut, cut[1:], strict=False)]


class Index:
    """The distinct vectors of a table, their pivots and files. `k` bounds what later searches may ask for."""

    def __init__(self, rows: DataFrame, k: int = K, vector: str = "embedding"):
        self.spark, self.k = rows.sparkSession, k
        arrow_rows(self.spark, 4000)
        element = rows.schema[vector].dataType.elementType.simpleString()
        self.kind = "<f4" if element in ("float", "tinyint", "smallint") else "<f8"
        self.vector = vector
        sound = usable(rows, vector)
        self.width = sound.agg(F.max(F.size("v"))).first()[0] or 0
        self.rows = stored(coded(sound, self.width, self.kind))
        firsts = self.rows.select("digest", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).filter(F.col("n") <= k + 1)
        self.ids = stored(firsts.groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # at most k + 1 of one digest
        self.distinct = stored(self.rows.groupBy("digest").agg(F.min("id").alias("id"), F.first("v").alias("v")))
        self.n = self.distinct.count()
        if self.n:
            most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * self.width)))
            wanted = min(most, self.n, max(2 * PREFIX - 1, math.isqrt(self.n)))
            self.pivots = Pivots(self._vectors(self.distinct.orderBy("digest").limit(wanted).collect()))  # digests are a random order
            self.sent = self.spark.sparkContext.broadcast(self.pivots)
            self._post()

    def _vectors(self, rows) -> np.ndarray:
        return np.frombuffer(b"".join(r.v for r in rows), self.kind).reshape(len(rows), self.width).astype(np.float64)

    def _post(self) -> None:
        sent, width, kind = self.sent, self.width, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("v"), width, kind)
                order = pivots.order(x, pivots.prefix)
                yield pa.record_batch([b.column("digest"), b.column("id"), pa.array(pivots.band(x)), pa.array(list(order[:, :POSTS].astype(np.int32)), pa.list_(pa.int32())), pa.array([p.tobytes() for p in order.astype("<u2")], pa.binary()), b.column("v")],
                                      names=["digest", "id", "band", "posts", "prefix", "v"])

        self.entries = stored(self.distinct.mapInArrow(run, "digest binary, id long, band int, posts array<int>, prefix binary, v binary"))
        posted = self.entries.select("band", F.explode("posts").alias("pivot")).groupBy("band", "pivot").agg(F.count(F.lit(1)).alias("n"))
        size = max(64, BLOCK_BYTES // (8 * self.width))
        self.blocks = {(r.band, r.pivot): -(-r.n // size) for r in posted.collect()}  # one number per file

    def learn(self, queries: DataFrame, recall: float) -> tuple[dict[int, int], dict[int, int]]:
        """By band: how many files to open, and up to which footrule distance to rerank."""
        asked = queries.select("digest", "v").dropDuplicates(["digest"]).orderBy("digest").limit(SAMPLE).collect()
        x, names, k = self._vectors(asked), np.array([bytes(r.digest) for r in asked], object), self.k
        sent, width, kind = self.spark.sparkContext.broadcast((x, names)), self.width, self.kind

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, names = sent.value
            score, what = np.full((len(x), 0), 0.0), np.full((len(x), 0), None, object)
            for b in batches:
                found = x @ matrix(b.column("v"), width, kind).T
                digests = np.array([*b.column("digest").to_pylist(), None], object)[:-1]
                found[names[:, None] == digests[None]] = -np.inf  # a query's own vector tells nothing
                about = np.array([*zip(digests, b.column("band").to_pylist(), b.column("prefix").to_pylist(), strict=True), None], object)[:-1]
                score, what = np.concatenate([score, found], 1), np.concatenate([what, np.broadcast_to(about, found.shape)], 1)
                keep = np.argsort(-score, 1, kind="stable")[:, :k]
                score, what = np.take_along_axis(score, keep, 1), np.take_along_axis(what, keep, 1)
            q, at = np.nonzero(score > -np.inf)
            got = what[q, at]
            yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(score[q, at]), *(pa.array([g[c] for g in got], t) for c, t in enumerate((pa.binary(), pa.int32(), pa.binary())))], names=["q", "score", "digest", "band", "prefix"])

        near = self.entries.select("digest", "band", "prefix", "v").mapInArrow(brute, "q int, score double, digest binary, band int, prefix binary")
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "digest"))).filter(F.col("n") <= k).collect()  # SAMPLE * k rows at most
        order = self.pivots.order(x, len(self.pivots.unit)) if len(x) else None
        needed: dict[int, list[tuple[int, int]]] = {}
        for r in near:
            prefix = np.frombuffer(r.prefix, "<u2")
            opened = min(int(np.flatnonzero(order[r.q] == p)[0]) for p in prefix[:POSTS]) + 1
            needed.setdefault(r.band, []).append((opened, far(order[r.q][:len(prefix)], prefix)))
        share = 1 - (1 - recall) / 4
        files, limits = {band: 1 for band, _ in self.blocks}, {band: -1 for band, _ in self.blocks}
        for band, found in needed.items():
            for bounds, values in zip((files, limits), zip(*found, strict=True), strict=True):
                bounds[band] = sorted(values)[min(len(values), math.ceil(share * len(values) + 1)) - 1]
        return files, limits

    def _search(self, queries: DataFrame, files: dict[int, int], limits: dict[int, int]) -> DataFrame:
        """digest (of the query), hits: the k + 1 best entries of every place that was searched, as rows."""
        sent, blocks, width, kind, k = self.sent, self.blocks, self.width, self.kind, self.k + 1
        prefix, n_pivots = self.pivots.prefix, len(self.pivots.unit)
        most = min(n_pivots, max(prefix, *files.values()))

        def opened(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            order = sent.value.order(x, most)
            return order, [order[:, :n] for n in files.values()]

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(files), n_pivots), np.int64)
            for b in batches:
                if b.num_rows:
                    for i, part in enumerate(opened(matrix(b.column("v"), width, kind))[1]):
                        total[i] += np.bincount(part.reshape(-1), minlength=n_pivots)
            i, p = np.nonzero(total)
            yield pa.record_batch([pa.array(np.array(list(files), np.int32)[i]), pa.array(p.astype(np.int32)), pa.array(total[i, p])], names=["band", "pivot", "n"])

        asked = queries.select("v").mapInArrow(asking, "band int, pivot int, n long").groupBy("band", "pivot").agg(F.sum("n").alias("n")).collect()  # one number per file
        slices = {(r.band, r.pivot): -(-r.n // SLICE) for r in asked if (r.band, r.pivot) in blocks}

        def dealt(is_query: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if not b.num_rows:
                        continue
                    digests, vectors = b.column("digest").to_pylist(), b.column("v").to_pylist()
                    spread = [int.from_bytes(d[:6], "little") for d in digests]
                    if is_query:
                        order, parts = opened(matrix(b.column("v"), width, kind))
                        prefixes, ids = [p.tobytes() for p in order[:, :prefix].astype("<u2")], [0] * len(digests)
                        places = [(band, p, row) for band, part in zip(files, parts, strict=True) for row, own in enumerate(part.tolist()) for p in own]
                    else:
                        prefixes, ids, bands = (b.column(c).to_pylist() for c in ("prefix", "id", "band"))
                        places = [(bands[row], p, row) for row, own in enumerate(b.column("posts").to_pylist()) for p in own]
                    rows = []
                    for band, p, row in places:
                        if (band, p) in slices:
                            n, m = blocks[band, p], slices[band, p]
                            to = [(j, spread[row] % m) for j in range(n)] if is_query else [(spread[row] % n, j) for j in range(m)]
                            rows += [(band, p, x, y, is_query, digests[row], ids[row], prefixes[row], vectors[row]) for x, y in to]
                        if len(rows) >= 4000:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)
            return run

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["band", "pivot", "block", "slice", "asks", "digest", "id", "prefix", "v"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, list] = {}  # hits by query
            place, entries, block = None, [], None

            def flushed() -> pa.RecordBatch:
                rows = [(d, e, i, s) for d, hits in held.items() for s, i, e in best_of(hits)]
                held.clear()
                return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["digest", "entry", "id", "score"])

            def best_of(hits: list) -> list:
                return sorted({(-s, i, e) for s, i, e in hits})[:k]

            for b in batches:
                keys = np.stack([b.column(c).to_numpy() for c in ("band", "pivot", "block", "slice")], 1)
                asks = b.column("asks").to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1) | (asks[1:] != asks[:-1])]))
                for x, y in zip(edges.tolist(), [*edges.tolist()[1:], len(asks)], strict=True):
                    part, key = b.slice(x, y - x), tuple(keys[x].tolist())
                    if key != place:
                        place, entries, block = key, [], None
                    prefixes = np.frombuffer(b"".join(part.column("prefix").to_pylist()), "<u2").reshape(y - x, prefix)
                    vectors = matrix(part.column("v"), width, kind)
                    if not asks[x]:
                        entries.append((prefixes, vectors, part.column("id").to_numpy(), part.column("digest").to_pylist()))
                        continue
                    if not entries and block is None:
                        continue
                    if block is None:
                        block = Block(n_pivots, *(np.concatenate([e[c] for e in entries]) for c in range(3)), sum((e[3] for e in entries), []))
                        entries = []
                    names = part.column("digest").to_pylist()
                    for at in range(0, y - x, AT_ONCE):
                        got = block.best(prefixes[at:at + AT_ONCE], vectors[at:at + AT_ONCE], k, limits[key[0]])
                        for name, (which, score) in zip(names[at:at + AT_ONCE], got, strict=True):
                            hits = held.setdefault(name, [])
                            hits += zip(score.tolist(), block.ids[which].tolist(), (block.digests[w] for w in which.tolist()), strict=True)
                            if len(hits) > 20 * k:
                                held[name] = [(-s, i, e) for s, i, e in best_of(hits)]
                    if len(held) > HELD:
                        yield flushed()
            if held:
                yield flushed()

        kept = "band int, pivot int, block int, slice int, asks boolean, digest binary, id long, prefix binary, v binary"
        both = self.entries.mapInArrow(dealt(False), kept).unionByName(queries.select("digest", "v").mapInArrow(dealt(True), kept))
        key = ["band", "pivot", "block", "slice"]
        hits = both.repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(meet, "digest binary, entry binary, id long, score double")
        hits = hits.dropDuplicates(["digest", "entry"]).withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("score", "id", "entry")))
        return hits.filter(F.col("n") <= k).select("digest", "entry", (-F.col("score")).alias("score"))

    def _answers(self, hits: DataFrame) -> DataFrame:
        """digest, near: the k + 1 nearest rows (score, id) of every query vector."""
        rows = hits.join(self.ids.select(F.col("digest").alias("entry"), "ids"), "entry").select("digest", "score", F.explode("ids").alias("id"))
        near = rows.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("near"))  # at most (k + 1) ** 2
        return near.select("digest", F.slice("near", 1, self.k + 1).alias("near"))

    def nearest(self, queries: DataFrame, recall: float = RECALL) -> DataFrame:
        """query_id, rank, vec_id, score: for rows vec_id and vector the k nearest others found."""
        empty = self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = stored(coded(usable(queries, self.vector), self.width, self.kind)) if self.n else None
        if asked is None or asked.isEmpty():
            return empty
        asked = asked.select("id", "digest", "v")
        vectors = stored(asked.groupBy("digest").agg(F.first("v").alias("v")))
        files, limits = self.learn(vectors, recall)
        found = stored(self._answers(self._search(vectors, files, limits)))
        wanted = min(self.k + 1, self.rows.select("id", "digest").distinct().limit(self.k + 1).count())
        short = stored(vectors.join(found.filter(F.size("near") >= wanted).select("digest"), "digest", "left_anti"))
        if not short.isEmpty():
            everything = {band: len(self.pivots.unit) for band in files}
            found = found.filter(F.size("near") >= wanted).unionByName(self._answers(self._search(short, everything, limits)))
        others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, self.k)
        each = asked.select("id", "digest").distinct().join(found, "digest").select("id", F.posexplode(others).alias("n", "hit"))
        return each.select(F.col("id").alias("query_id"), (F.col("n") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Index(rows, K).nearest(rows.filter("vec_id % 20 = 0"))


SQL = None
