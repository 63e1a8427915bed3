"""Product codes of vectors, found through memoised grid cells.

Components become integers floor(256 * x); a vector is cut into PARTS equal parts, and each part position has a codebook
of up to ENTRIES entries, first the parts of the vectors with the smallest ids, then moved ROUNDS times to the floor of
the mean of the parts nearest to them.

Nearest entries are found by grid cells. A part's coarse cell is its components divided by a cell width. For a cell, the
least and the greatest distance of every entry to its box are computed once; an entry whose least distance exceeds some
entry's greatest is dominated across the box. The others are the cell's candidates, remembered under the hash of
the cell, and only they are compared exactly with the parts that lie in it. The candidates hold every nearest entry of
every point of the box, ties included, so codes are exact and do not depend on the cells' width.

A round moves sums and counts per entry: at most PARTS * ENTRIES rows per task and to the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; vectors shorter than the
longest one, or than a multiple of PARTS, read as ending in zeros; components beyond +-CLAMP / 256 count as that bound, as
squared distances would not fit 64 bits; rows without an id are coded but start no entry; of rows with equal ids the
lesser vector comes first; repeated rows are coded each; a table of fewer rows has fewer entries; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, join_narrow, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CLAMP = 1 << 26
#: Cells of a part that a task remembers, and how many cells' bounds, or numbers of exact distances, are worked out at once.
HELD, CELLS, CHUNK = 100_000, 512, 1 << 21


class Codebook:
    """The entries of one part position, and the cells whose candidates are known."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = entries.std(0).mean() if entries.size else 0.0
        self.shift = max(0, int(round(np.log2(max(1.0, spread)))))
        self.known: dict[bytes, np.ndarray] = {}

    def _learn(self, cells: np.ndarray) -> None:
        low = cells << self.shift
        high = low + (1 << self.shift) - 1
        e = self.entries
        for k in range(0, len(cells), CELLS):
            lo, hi = low[k:k + CELLS, None], high[k:k + CELLS, None]
            near = np.maximum(np.maximum(lo - e, e - hi), 0)
            far = np.maximum(np.abs(e - lo), np.abs(e - hi))
            keep = (near * near).sum(2) <= (far * far).sum(2).min(1)[:, None]
            for cell, row in zip(cells[k:k + CELLS], keep, strict=True):
                self.known[cell.tobytes()] = np.flatnonzero(row)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, ties to the lower index."""
        index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        if not parts.size:
            return index, error
        cells, where = np.unique(parts >> self.shift, axis=0, return_inverse=True)
        where = where.reshape(-1)
        names = [c.tobytes() for c in cells]
        if len(self.known) + len(names) > HELD:
            self.known.clear()
        new = [i for i, n in enumerate(names) if n not in self.known]
        if new:
            self._learn(cells[new])
        lists = [self.known[n] for n in names]
        size = np.array(list(map(len, lists)))
        flat, begin = np.concatenate(lists), np.cumsum(size) - size
        width = np.maximum(1, 1 << np.ceil(np.log2(size)).astype(np.int64))  # cells of about as many candidates go together
        of_point = width[where]
        for w in np.unique(of_point):
            points = np.flatnonzero(of_point == w)
            for k in range(0, len(points), max(1, CHUNK // int(w * parts.shape[1]))):
                at = points[k:k + max(1, CHUNK // int(w * parts.shape[1]))]
                c = where[at]
                chosen = flat[begin[c][:, None] + np.minimum(np.arange(w), size[c][:, None] - 1)]  # the last one repeated
                d = parts[at][:, None] - self.entries[chosen]
                d = (d * d).sum(2)
                best = d.argmin(1)  # the first of the least: candidates ascend
                row = np.arange(len(at))
                index[at], error[at] = chosen[row, best], d[row, best]
        return index, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Stored integer vectors, all of the same width."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(np.int64)


def integers(embeddings: DataFrame, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """vec_id, label, ints (binary) of the rows that stay, stored, and the number of components."""
    arrow_rows(embeddings.sparkSession, 4000)
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col(f"`{label}`").alias("label"), v.alias("v")).filter(F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            n = v.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((len(v), width))
            whole[np.arange(width) < n[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(256 * whole), -CLAMP, CLAMP).astype("<i4")
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array([x.tobytes() for x in whole], pa.binary())], names=["vec_id", "label", "ints"])

    kind = rows.schema["label"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"vec_id long, label {kind}, ints binary")), width


def learn(ints: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """The final codebooks: part, entry, position."""
    part = width // PARTS
    first = [np.frombuffer(r.ints, "<i4") for r in ints.filter("vec_id IS NOT NULL").orderBy("vec_id", "ints").limit(ENTRIES).collect()]
    books = np.array(first, np.int64).reshape(len(first), PARTS, part).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        sent = ints.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now = sent.value
            known = [Codebook(x) for x in now]
            total, many = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for b in batches:
                m = _matrix(b.column("ints"), width).reshape(b.num_rows, PARTS, part)
                for p, book in enumerate(known):
                    index, _ = book.nearest(np.ascontiguousarray(m[:, p]))
                    np.add.at(total[p], index, m[:, p])
                    many[p] += np.bincount(index, minlength=len(many[p]))
            p, e = np.nonzero(many)
            yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(many[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        found = ints.select("ints").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        columns = [F.sum(F.get("total", F.lit(k))).alias(f"s{k}") for k in range(part)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():  # at most PARTS * ENTRIES rows
            books[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(part)]
    return books


def encode(ints: DataFrame, width: int, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""
    part = width // PARTS
    sent = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Codebook(x) for x in sent.value]
        for b in batches:
            m = _matrix(b.column("ints"), width).reshape(b.num_rows, PARTS, part)
            found = [book.nearest(np.ascontiguousarray(m[:, p])) for p, book in enumerate(known)]
            codes = np.stack([x for x, _ in found], 1).astype(np.uint8)
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array([x.tobytes().hex() for x in codes]), pa.array(sum(x for _, x in found))], names=["vec_id", "label", "code", "error"])

    kind = ints.schema["label"].dataType.simpleString()
    return ints.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(embeddings: DataFrame, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """The coded rows (vec_id, label, code, error, label_error) and the codebooks."""
    ints, width = integers(embeddings, vector, label)
    books = learn(ints, width)
    coded = stored(encode(ints, width, books))
    # sums by label, nulls together; keys that are never null, because joins pass over nulls
    of_label = stored(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")))
    met = join_narrow(_named(coded), _named(of_label).drop("label"), ["__nil", "__label"], "inner")
    return met.drop("__nil", "__label"), books


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"__nil": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))})


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def query(spark, sf_dir):
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The contract spelled out: every part against every entry, two rounds, and the final assignment."""
    def nearest(k: int) -> str:
        return (f"near{k} AS (SELECT id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT p.id, p.part, c.entry, "
                f"list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT AS d FROM parts p JOIN book{k} c USING (part)) GROUP BY id, part)")

    def moved(k: int) -> str:
        return (f"sums{k} AS (SELECT n.part, n.entry, i, CAST(floor(sum(p.v[i]) / count(*)) AS BIGINT) AS x FROM near{k} n JOIN parts p USING (id, part), range(1, len(p.v) + 1) r(i) GROUP BY n.part, n.entry, i), "
                f"book{k + 1} AS (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM sums{k} GROUP BY part, entry) s USING (part, entry))")

    return f"""
WITH ints AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows_ AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS id, * FROM ints),
parts AS (SELECT id, CAST(part AS BIGINT) AS part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM rows_, range({PARTS}) t(part)),
book0 AS (SELECT part, id - 1 AS entry, v FROM parts WHERE id <= {ENTRIES}),
{nearest(0)}, {moved(0)}, {nearest(1)}, {moved(1)}, {nearest(2)},
codes AS (SELECT id, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows_ JOIN codes USING (id), books"""


SQL = _sql()
