"""Best-fit packing of tokenised documents into sequences of a fixed capacity, large items first.

Only lengths matter for the plan, and there are at most as many as the capacity: their counts over the whole corpus are
gathered (a bounded table) and packed by runs of equal bins. Pieces above a third of the capacity fit at most twice in a
bin; from the longest on, each is matched with the longest partner that fits. Shorter pieces then go, from the longest
on, into the smallest gap that holds them, and open new bins only when no gap is left.

The pieces themselves are numbered within their length, a length with many pieces over many salts, and each finds its
place in the plan by its number. No piece meets another one: what moves is a few numbers per piece.

Defined results: a null text counts as empty and gives a piece with the end id alone; repeated rows are packed each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, kept, one_thread, stored, tokenizer_path, whole_text

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
ROWS_PER_SALT = 20_000
#: Chunks after which a worker forgets the ids of those that the last as many did not have again; it holds at most
#: twice as many and those of one call, some 200 bytes each.
HELD = 300_000

_SPACE = re.compile("[ \t\n\r]+")
#: Chunks of these characters only are lower-cased letter by letter and split into runs of letters, digits and other marks.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]+")
_PART = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


class Ids:
    """Ids of a text as little-endian bytes. The tokenizer drops white space and never merges across it, so a text's ids
    are those of its chunks between spaces, tabs and line breaks; the ids of chunks are remembered."""

    def __init__(self, name: str):
        one_thread()
        from tokenizers import Tokenizer

        self.lib, self.known, self.older = Tokenizer.from_file(tokenizer_path(name)), {"": b""}, {}
        words = self.lib.get_vocab(with_added_tokens=False)
        self.end = np.zeros(max(words.values()) + 3, bool)
        self.end[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def of(self, texts: list[str]) -> list[bytes]:
        split = [_SPACE.split(t) for t in texts]
        if len(self.known) > HELD:
            self.known, self.older = {"": b""}, self.known
        new = set().union(*split) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        new = list(new - again)
        plain = [c for c in new if _PLAIN.fullmatch(c)]
        for i in range(0, len(plain), 2000):
            self._learn(plain[i:i + 2000])
        odd = [c for c in new if c not in self.known]
        for chunk, got in zip(odd, self.lib.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.known[chunk] = np.array(got.ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, x)) for x in split]

    def _learn(self, chunks: list[str]) -> None:
        """Plain chunks in one call: the parts into which the tokenizer splits them are counted here, and each part ends
        with an id that carries the mark of a word's end."""
        ids = np.array(self.lib.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.end[ids]) + 1
        parts = np.cumsum([len(_PART.findall(c)) for c in chunks])
        if len(ends) != parts[-1]:
            raise ValueError("the tokenizer splits plain text in another way")
        data, at = ids.tobytes(), 0
        for chunk, to in zip(chunks, (4 * ends[parts - 1]).tolist(), strict=True):
            self.known[chunk], at = data[at:to], to


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than the capacity are cut, others stay whole."""
    memo = docs.sparkSession.sparkContext.broadcast({})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept(memo, tokenizer, lambda: Ids(tokenizer))
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("body").to_pylist()
            for k in range(0, len(texts), 200):
                out = [(d, s // capacity, s, min(capacity, len(x) // 4 - s), zlib.crc32(x[4 * s:4 * (s + capacity)]))
                       for d, t in zip(names[k:k + 200], ids.of(texts[k:k + 200]), strict=True) for x in [t + END_ID.to_bytes(4, "little")] for s in range(0, len(x) // 4, capacity)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    arrow_rows(docs.sparkSession, 2000)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("body")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of a length go. Rows (length, first, sequence, each, offset): the pieces of that length numbered
    from `first` on fill the sequences from `sequence` on, `each` of them per sequence, the first at `offset`."""
    left, taken, rows, bins = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: runs of equal bins (first, number)

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((length, taken[length], sequence, each, offset))
        taken[length] += n
        left[length] -= n

    def fill(length: int, gap: int, first: int, number: int) -> None:
        """As many of the pieces as go into these equal bins, each bin filled before the next."""
        each = gap // length
        n = min(left[length], each * number)
        full, rest = divmod(n, each)
        place(length, n, first, each, capacity - gap)
        for at, many, now in ((first, full, gap - each * length), (first + full, int(rest > 0), gap - rest * length), (first + full + (rest > 0), number - full - (rest > 0), gap)):
            if many:
                gaps[now].append((at, many))

    large = capacity // 3 + 1
    for length in range(capacity, large - 1, -1):
        other = min(length, capacity - length)
        while left.get(length):
            while other >= large and (not left.get(other) or other == length and left[length] < 2):
                other -= 1
            if other < large:
                n = left[length]
                place(length, n, bins, 1, 0)
                gaps[capacity - length].append((bins, n))
            elif other == length:
                n = left[length] // 2
                place(length, 2 * n, bins, 2, 0)
                gaps[capacity - 2 * length].append((bins, n))
            else:
                n = min(left[length], left[other])
                place(length, n, bins, 1, 0)
                place(other, n, bins, 1, length)
                gaps[capacity - length - other].append((bins, n))
            bins += n
    for length in range(large - 1, 0, -1):
        for gap in range(length, capacity + 1):
            runs = gaps.get(gap, ())
            while runs and left.get(length):
                fill(length, gap, *runs.pop())
            if not left.get(length):
                break
        if left.get(length):
            number = -(-left[length] // (capacity // length))
            fill(length, capacity, bins, number)
            bins += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(plan(counts, capacity))
    hot = {n: c // ROWS_PER_SALT + 1 for n, c in counts.items() if c > ROWS_PER_SALT}
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), _salts(hot)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).cast("long").alias("number"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        keys = (at[:, 0] << 48) + at[:, 1]
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            row = at[np.searchsorted(keys, (length << 48) + number, "right") - 1]
            sequence, slot = np.divmod(number - row[:, 1], row[:, 3])
            yield pa.record_batch([*b.columns[:5], pa.array(row[:, 2] + sequence), pa.array(row[:, 4] + slot * length)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _salts(hot: dict[int, int]):
    """How many salts a length has: at most `capacity` lengths are named."""
    out = F.lit(1)
    if hot:
        out = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in hot.items() for x in p)), F.col("length").cast("int")), out)
    return out.cast("long")


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
