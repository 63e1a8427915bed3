"""Exact k-nearest search in blocks of space.

A group of many points is cut into blocks of some thousand neighbours. The borders
are medians along the longest side of a sample of points and queries, so an outlier
costs one block and a tight cluster is cut as finely as the rest; the sample, at most
TOP rows, decides where the borders lie and nothing else. A group of few points is
one block.

Every query first meets its own block. Its k-th nearest there, or the corners of the
nearest blocks that together hold k points, bounds the search, and the query goes
on only to the blocks whose points reach into that bound. So points travel twice,
whatever k is, and queries once more for each border they lie at. In a task a block
is halved down to leaves of LEAF points, and all queries at hand look into the leaves
within their bounds at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut

#: Points of a leaf, and queries that look into the leaves at once.
LEAF, WIDE = 32, 512
#: Points of a block, at least and (while the sample is not full) at most; sampled points and queries of a block.
SMALL, BLOCK, MARKS, QUERY_MARKS = 1024, 8192, 64, 256
#: Sampled rows that borders are drawn from.
TOP = 300_000
#: Pairs of a query and a leaf that are measured at once, and rows of a batch that is handed on.
PAIRS, ROWS = 20_000, 10_000
#: Room for rounding when corners are compared.
HAIR = 1 + 1e-12


class Borders:
    """Binary cuts of groups into blocks, drawn from a sample."""

    def __init__(self, group: np.ndarray, x: np.ndarray, is_point: np.ndarray):
        axis, at, low, high, blocks = [], [], [], [], 0
        self.roots: dict[int, int] = {}

        def node() -> int:
            for column, value in ((axis, -1), (at, 0.0), (low, -1), (high, -1)):
                column.append(value)
            return len(axis) - 1

        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            root = self.roots[int(group[rows[0]])] = node()
            todo = [(root, rows)]
            while todo:
                here, rows = todo.pop()
                some = rows[is_point[rows]]
                if len(some) <= MARKS:
                    some = rows[~is_point[rows]]
                    if len(some) <= QUERY_MARKS:
                        some = some[:0]
                side = int(np.ptp(x[some], 0).argmax()) if len(some) else 0
                values = np.sort(x[some, side])
                border = values[len(values) // 2] if len(some) else 0.0
                if len(some) and border == values[0]:  # both sides get something, or all of it is one place
                    above = values[values > border]
                    border, some = (above[0], some) if len(above) else (border, some[:0])
                if not len(some):
                    low[here], blocks = blocks, blocks + 1
                    continue
                first = x[rows, side] < border
                axis[here], at[here], low[here], high[here] = side, border, node(), node()
                todo += [(low[here], rows[first]), (high[here], rows[~first])]
        self.axis, self.at, self.low, self.high = (np.array(c) for c in (axis, at, low, high))

    def block(self, group: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Number of the block of each place; 0 where a group is not cut."""
        names, inverse = np.unique(group, return_inverse=True)
        here = np.array([self.roots.get(int(g), -1) for g in names], np.int64)[inverse]
        out, rows = np.zeros(len(group), np.int32), np.flatnonzero(here >= 0)
        here = here[rows]
        while len(rows):
            axis = self.axis[here]
            end = axis < 0
            out[rows[end]] = self.low[here[end]]
            rows, here, axis = rows[~end], here[~end], axis[~end]
            here = np.where(x[rows, axis] < self.at[here], self.low[here], self.high[here])
        return out


def _gap(lo, hi, x):
    """Squared distances from each row of x to the nearest corners or sides of each box."""
    total = 0.0
    for i in range(x.shape[1]):
        p = x[:, i, None]
        d = np.maximum(np.maximum(lo[None, :, i] - p, p - hi[None, :, i]), 0)
        total = total + d * d
    return total


class Leaves:
    """The points of a block, halved down to leaves, and the search in them. Ties go to the point given first."""

    def __init__(self, x: np.ndarray, k: int):
        self.k, self.d = k, x.shape[1]
        todo, runs = [np.arange(len(x))] if len(x) else [], []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                runs.append(rows)
                continue
            axis, half = int(np.ptp(x[rows], 0).argmax()), len(rows) // 2
            rows = rows[np.argpartition(x[rows, axis], half)]
            todo += [rows[:half], rows[half:]]
        width = max((len(r) for r in runs), default=0)
        self.rows = np.full((len(runs), width), -1, np.int64)
        for i, r in enumerate(runs):
            self.rows[i, :len(r)] = r
        self.empty = self.rows < 0
        self.at = [x[:, i][self.rows] if len(x) else np.zeros((0, 0)) for i in range(self.d)]
        self.lo, self.hi = (np.array([f(x[r], 0) for r in runs]).reshape(len(runs), self.d) for f in (np.min, np.max))

    def _measured(self, x, leaf):
        """Squared distances of places to the points of as many leaves, summed axis by axis."""
        total = None
        for i in range(self.d):
            p = x[:, i].reshape([-1] + [1] * leaf.ndim)
            diff = p - self.at[i][leaf]
            total = diff * diff if total is None else total + diff * diff
        total[self.empty[leaf]] = np.inf
        return total

    def nearest(self, x: np.ndarray, bound: np.ndarray):
        """(row, squared distance, point) of the k nearest of each row within its bound, and the narrowed bounds."""
        n, none = len(self.rows), np.zeros(0, np.int64)
        if not n:
            return none, np.zeros(0), none, bound
        gap = _gap(self.lo, self.hi, x)
        first = min(n, -(-self.k // self.rows.shape[1]) + 3)
        leaf = np.argpartition(gap, first - 1, 1)[:, :first] if first < n else np.broadcast_to(np.arange(n), (len(x), n))
        total = self._measured(x, leaf).reshape(len(x), -1)
        if total.shape[1] >= self.k:
            bound = np.minimum(bound, np.partition(total, self.k - 1, 1)[:, self.k - 1])
        row, col = np.nonzero((total <= bound[:, None]) & (total < np.inf))
        point = self.rows[leaf].reshape(len(x), -1)
        found = [(row, total[row, col], point[row, col])]
        inside = gap <= (bound * HAIR)[:, None]
        np.put_along_axis(inside, leaf, False, 1)
        rows, leaves = np.nonzero(inside)
        for lo in range(0, len(rows), PAIRS):
            r, l = rows[lo: lo + PAIRS], leaves[lo: lo + PAIRS]
            total = self._measured(x[r], l)
            at, col = np.nonzero((total <= bound[r][:, None]) & (total < np.inf))
            found.append((r[at], total[at, col], self.rows[l[at], col]))
        row, dist, point = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((point, dist, row))
        row, dist, point = row[order], dist[order], point[order]
        count = np.bincount(row, minlength=len(x))
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        last = row[place == self.k - 1]
        bound = bound.copy()
        bound[last] = np.minimum(bound[last], dist[place == self.k - 1])
        keep = place < self.k
        return row[keep], dist[keep], point[keep], bound


def _others(boxes, group: int, own: int, k: int, x: np.ndarray, bound: np.ndarray):
    """(row, block) of the further blocks that each row has to look into, and the bounds, narrowed by corners where there were none."""
    block, count, lo, hi = boxes[group]
    other = block != own
    if np.isinf(bound).any():
        rows = np.flatnonzero(np.isinf(bound))
        bound = bound.copy()
        for at in range(0, len(rows), 64):
            part = rows[at: at + 64]
            far = sum(np.maximum(hi[None, :, i] - x[part, i, None], x[part, i, None] - lo[None, :, i]) ** 2 for i in range(x.shape[1]))
            order = np.argsort(far, 1)
            held = np.cumsum(count[order], 1) >= k
            corner = np.take_along_axis(far, order, 1)[np.arange(len(part)), held.argmax(1)]
            bound[part] = np.where(held.any(1), corner * HAIR, np.inf)
    low, high = x.min(0), x.max(0)
    apart = (np.maximum(np.maximum(lo - high, low - hi), 0) ** 2).sum(1)
    near = np.flatnonzero(other & (apart <= bound.max() * HAIR))
    rows, cols = np.nonzero(_gap(lo[near], hi[near], x) <= (bound * HAIR)[:, None])
    return rows, block[near[cols]], bound


def _search(by: list[str], d: int, k: int, boxes=None):
    """Arrow pass over the points and then the queries of each block: what each query found, its bound and, for ``boxes``
    (a broadcast), the blocks it has to look into next."""
    xs = [f"x{i}" for i in range(d)]
    key = [*by, "block"]

    def places(b):
        return np.stack([b.column(x).to_numpy() for x in xs], 1) if b.num_rows else np.zeros((0, d))

    def answered(b, leaves, ids, own):
        x, bound = places(b), b.column("bound").to_numpy()
        row, dist, point, bound = leaves.nearest(x, bound)
        count = np.bincount(row, minlength=b.num_rows)
        pairs = pa.StructArray.from_arrays([pa.array(dist), ids.take(pa.array(point))], names=["d2", "id"])
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        found = pa.ListArray.from_arrays(ends(count), pairs)
        rest = [found, pa.array(bound)]
        if boxes is not None:
            rows, blocks = np.zeros(0, np.int64), np.zeros(0, np.int32)
            if own[0] >= 0:
                rows, blocks, bound = _others(boxes.value, *own, k, x, bound)
                rest[1] = pa.array(bound)
            rest.append(pa.ListArray.from_arrays(ends(np.bincount(rows, minlength=b.num_rows)), pa.array(blocks.astype(np.int32))))
        names = [*by, "site", *xs, "found", "bound", *(["visits"] if boxes is not None else [])]
        return pa.record_batch([*(b.column(c) for c in [*by, "site", *xs]), *rest], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, leaves, ids, out, size = None, [], None, None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in [*key, "is_query"]:
                column = b.column(c)
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                name = tuple(b.column(c)[a].as_py() for c in key)
                if name != now:
                    now, points, leaves = name, [], None
                if not b.column("is_query")[a].as_py():
                    points.append(b.slice(a, z - a).select(["id", *xs]))
                    continue
                if leaves is None:
                    held = pa.Table.from_batches(points, points[0].schema if points else b.schema.empty_table().select(["id", *xs]).schema).combine_chunks()
                    held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")], null_placement="at_start"))
                    ids = held.column("id").combine_chunks() if held.num_rows else pa.array([], held.schema.field("id").type)
                    leaves = Leaves(np.stack([held.column(x).to_numpy() for x in xs], 1), k)
                    points = []
                own = b.column("cut_group")[a].as_py(), now[-1]
                for lo in range(a, z, WIDE):
                    out.append(answered(b.slice(lo, min(WIDE, z - lo)), leaves, ids, own))
                    size += out[-1].num_rows
                if size >= ROWS:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _dealt(rows: DataFrame, large: DataFrame, borders, by: list[str], d: int) -> DataFrame:
    """Rows with the number of their group, if it is cut, and of their block."""
    xs = [f"x{i}" for i in range(d)]
    rows = rows.join(F.broadcast(large), by, "left").withColumn("cut_group", F.coalesce("cut_group", F.lit(-1).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in xs], 1)
            block = borders.value.block(b.column("cut_group").to_numpy(), x)
            yield pa.record_batch([*b.columns, pa.array(block)], names=[*b.schema.names, "block"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, block int")


def nearest(places: DataFrame, points: DataFrame, k: int, r: float | None, by: list[str], d: int) -> DataFrame:
    """The k nearest points (by, id, x0, ...) of each stored place (by, id, x0, ...), at most r away, ties by id:
    (by, site, rank, id, d2). Points are stored too; of those at one place only the k least ids may be given."""
    spark, xs, wanted = points.sparkSession, [f"x{i}" for i in range(d)], list(by)
    if not by:
        by = ["__all"]
        places, points = (t.withColumn("__all", F.lit(0)) for t in (places, points))
    places, points = (t.where(" AND ".join(f"`{b}` IS NOT NULL" for b in by)) for t in (places, points))
    sc, partitions = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))

    n = points.count()
    size = max(min(BLOCK, max(SMALL, n // 256)), 4 * k, n * MARKS // max(TOP, 1))
    large = points.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > size).select(*by, F.monotonically_increasing_id().alias("cut_group"))
    large = cut(large)  # at most a row for each ``size`` points
    share = min(1.0, MARKS / size) if TOP else 0.0

    def marks(t, share, is_point):
        one = F.pmod(F.xxhash64("id", *xs), F.lit(1_000_000)) < int(share * 1_000_000)
        return t.where(one).join(F.broadcast(large), by).select("cut_group", *xs, F.lit(is_point).alias("is_point"))

    asked = places.count()
    sample = marks(points, share, True).unionByName(marks(places, min(share, TOP / max(asked, 1)), False)).toArrow()  # at most some TOP rows each
    x = np.stack([sample.column(c).to_numpy() for c in xs], 1)
    borders = sc.broadcast(Borders(sample.column("cut_group").to_numpy(), x, sample.column("is_point").to_numpy().astype(bool)))

    points = cut(_dealt(points, large, borders, by, d))
    sides = [f(x).alias(f"{name}{i}") for i, x in enumerate(xs) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    whole = points.where("cut_group >= 0").groupBy("cut_group", "block").agg(F.count("*").alias("n"), *sides).toArrow().combine_chunks()
    corners = [np.stack([whole.column(f"{c}{i}").to_numpy() for i in range(d)], 1) for c in ("lo", "hi")]
    group, boxes = whole.column("cut_group").to_numpy(), {}
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        boxes[int(g)] = (whole.column("block").to_numpy()[rows], whole.column("n").to_numpy()[rows], *(c[rows] for c in corners))
    boxes = sc.broadcast(boxes)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    site = places.schema["id"].dataType.simpleString()
    columns = [*by, "cut_group", "block", "is_query", "id", "site", *xs, "bound"]
    given = points.withColumns({"is_query": F.lit(False), "site": F.lit(None).cast(site), "bound": F.lit(None).cast("double")}).select(*columns)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"site {site}", *(f"{x} double" for x in xs), f"found array<struct<d2:double,id:{kinds['id']}>>, bound double"])

    def met(queries, schema, boxes=None):
        queries = queries.withColumns({"is_query": F.lit(True), "id": F.lit(None).cast(kinds["id"])}).select(*columns)
        both = given.unionByName(queries).repartition(partitions, *by, "block")
        return both.sortWithinPartitions(*by, "block", "is_query").mapInArrow(_search(by, d, k, boxes), schema)

    limit = F.lit(float("inf") if r is None else float(r) * float(r))
    queries = _dealt(places.withColumnRenamed("id", "site"), large, borders, by, d).withColumn("bound", limit)
    first = cut(met(queries, f"{schema}, visits array<int>", boxes))
    # Those at a border go on; what they found on both sides is ranked together.
    onward = first.where("size(visits) > 0")
    query = [*by, "site", *xs]
    visits = onward.select(*query, "bound", F.lit(0).cast("long").alias("cut_group"), F.explode("visits").alias("block"))
    more = met(visits, schema).groupBy(*by, *xs).agg(F.flatten(F.collect_list("found")).alias("more"))
    both = F.concat("found", F.coalesce("more", F.array().cast(first.schema["found"].dataType)))
    more = onward.select(*query, "found").join(more, [*by, *xs], "left").select(*query, F.slice(F.sort_array(both), 1, k).alias("found"))
    out = first.where("size(visits) = 0").select(*query, "found").unionByName(more)
    out = out.select(*wanted, "site", F.posexplode("found").alias("rank", "near"))
    return out.select(*wanted, "site", (F.col("rank") + 1).alias("rank"), F.col("near.id").alias("id"), F.col("near.d2").alias("d2"))
