"""Alignment of two tokenizers' tokens over every text, with corpus-wide counts of the id pairs that meet.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces) the text, before which it puts a space of
its own. Both spell the same bytes, so every token is an interval of byte offsets. Interval coalescing: the tokens of
both sides of a batch of texts are lexsorted by start, `maximum.accumulate` gives the furthest end so far, and a group
breaks where a start reaches it. Overlaps expand within the groups: a token of A meets the run of B's tokens from the
first that ends behind its start to the last that starts before its end.

The ids of both sides are stored once. A first pass over them counts, for every id pair, the documents that hold it
linked (combined in each task before the shuffle). Pairs with at least 1 / COMMON of all these counts are at most COMMON
by arithmetic; they and each A id's highest count go to every task. The links of all other pairs meet their counts in a
shuffled join, in which by the same bound no key is hot, and come back as two sums per document.

Defined results: a null or empty text, and one whose bytes a tokenizer changes, has no tokens: all numbers are 0 and
groups_sha256 is ''. Repeated rows are documents of their own, in the result as in the counts; a null doc_id stays null;
texts of any length are read whole; ties for an A id's highest count all count as best; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, one_thread, stored, tokenizer_path, whole_text

#: Tokenizer A as the library `tokenizers` reads it and the same vocabulary as ranks; tokenizer B.
A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Proven bound of the broadcast part of the pair counts.
COMMON = 1_000_000
#: Texts are aligned together until they have so many tokens.
AT_ONCE = 400_000
#: Pairs whose counts a task holds before it passes them on.
HELD = 4_000_000
SIDE = 1 << 16


class Spelled:
    """Both tokenizers, and the bytes of their tokens. Ids are below 2^16, as both vocabularies are."""

    def __init__(self):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        one_thread()
        with open(tokenizer_path(A_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 2)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B_FILE))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a = None

    def _a_ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # its pattern matcher gives up on very long runs with an error of its own kind
            if not type(e).__name__.startswith(("Panic", "ValueError", "Runtime")):
                raise
        if self.a is None:
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_file(tokenizer_path(A_FILE))
            self.a.encode_special_tokens = True
        return self.a.encode(text, add_special_tokens=False).ids

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B; none where the bytes are not those of a space and the text."""
        none = np.array([], "<u2")
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                yield none, none
                continue
            a, want = self._a_ids(" " + text), (" " + text).encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b)):
                yield np.array(a, "<u2"), np.array(b, "<u2")
            else:
                yield none, none


class Aligned:
    """Groups and links of a batch of texts whose tokens follow each other: a, b are ids, docs_a and docs_b the text of
    each token, and size_a, size_b their bytes. Both sides cover the same bytes of every text."""

    def __init__(self, a, b, docs_a, docs_b, size_a, size_b):
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        start_a, start_b = end_a - size_a, end_b - size_b
        side = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order]) if len(order) else end
        opens = np.concatenate([[True], start[order][1:] >= reach[:-1]]) if len(order) else np.array([], bool)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(opens) - 1
        self.group_a, self.group_b = group[:len(a)], group[len(a):]
        # what each token of A overlaps: B's tokens lie side by side, so it is a run of them inside the group
        first = np.searchsorted(end_b, start_a, "right")
        many = np.searchsorted(start_b, end_a, "left") - first
        left = np.repeat(np.arange(len(a)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        self.doc, self.pair = docs_a[left], a[left].astype(np.int64) * SIDE + b[right].astype(np.int64)
        self.a, self.b, self.docs_a, self.docs_b = a, b, docs_a, docs_b

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pair, links): every pair once per document."""
        if not len(self.pair):
            return self.doc, self.pair, self.doc
        order = np.lexsort((self.pair, self.doc))
        doc, pair = self.doc[order], self.pair[order]
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]))
        return doc[at], pair[at], np.diff(np.append(at, len(doc)))

    def written(self, names: list[list[str]], docs: int) -> list[str]:
        """a1,a2|b1;a3|b2,b3 for every text: names[k] holds the ids with the k-th of the marks none , | ; in front."""
        side = np.repeat(np.array([0, 1], np.int8), [len(self.a), len(self.b)])
        group, ids, doc = (np.concatenate(x) for x in ((self.group_a, self.group_b), (self.a, self.b), (self.docs_a, self.docs_b)))
        order = np.lexsort((side, group))
        side, group, ids, doc = side[order], group[order], ids[order], doc[order]
        mark = np.zeros(len(ids), np.int64)
        mark[1:] = np.where(doc[1:] != doc[:-1], 0, np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1)))
        flat = (mark * SIDE + ids).tolist()
        cut = np.searchsorted(doc, np.arange(docs + 1)).tolist()
        return ["".join(map(names.__getitem__, flat[x:y])) for x, y in zip(cut, cut[1:], strict=False)]


def marked_names() -> list[str]:
    ids = [str(i) for i in range(SIDE)]
    return [mark + i for mark in ("", ",", "|", ";") for i in ids]


def _batches(batches: Iterator[pa.RecordBatch], spelled: Spelled) -> Iterator[tuple[pa.RecordBatch, list, list, Aligned]]:
    """Rows of stored ids with their alignment, some AT_ONCE tokens together."""
    for b in batches:
        a, other = ([np.frombuffer(x, "<u2") for x in b.column(c).to_pylist()] for c in ("a", "b"))
        total = np.cumsum([len(x) + len(y) for x, y in zip(a, other, strict=True)])
        cuts = [0]
        while cuts[-1] < len(a):
            before = total[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, before + AT_ONCE, "right"))))
        for x, y in zip(cuts, cuts[1:], strict=False):
            x_a, x_b = a[x:y], other[x:y]
            ids_a, ids_b = np.concatenate(x_a), np.concatenate(x_b)
            docs_a, docs_b = (np.repeat(np.arange(y - x), list(map(len, z))) for z in (x_a, x_b))
            yield b.slice(x, y - x), x_a, x_b, Aligned(ids_a, ids_b, docs_a, docs_b, spelled.a_size[ids_a], spelled.b_size[ids_b])


def token_ids(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, a and b (ids as little-endian 16-bit numbers), stored."""
    memo = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = kept(memo, "spelled", Spelled)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                a, b = zip(*spelled.of(part.column("body").to_pylist()), strict=True)
                yield pa.record_batch([part.column("doc_id"), *(pa.array([x.tobytes() for x in side], pa.binary()) for side in (a, b))], names=["doc_id", "a", "b"])

    ids = docs.select(F.col("doc_id").cast("long"), whole_text().alias("body")).mapInArrow(run, "doc_id long, a binary, b binary")
    return stored(ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "a", "b"))


def pair_counts(ids: DataFrame) -> DataFrame:
    """a_id, b_id, n_docs: in how many documents the pair is linked."""
    memo = ids.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, pairs, counts, held = kept(memo, "spelled", Spelled), [], [], 0

        def combined():
            pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
            return pair, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        def batch(pair, n):
            return pa.record_batch([pa.array(pair), pa.array(n)], names=["pair", "n"])

        for *_, aligned in _batches(batches, spelled):
            pair, n = np.unique(aligned.distinct()[1], return_counts=True)
            pairs.append(pair)
            counts.append(n)
            held += len(pair)
            if held > HELD:
                pair, n = combined()
                pairs, counts, held = [pair], [n], len(pair)
                if held > HELD // 2:
                    yield batch(pair, n)
                    pairs, counts, held = [], [], 0
        if held:
            yield batch(*combined())

    found = ids.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    return found.select(F.expr(f"pair div {SIDE}").cast("int").alias("a_id"), F.expr(f"pair % {SIDE}").cast("int").alias("b_id"), "n_docs")


def align(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (a1,a2|b1;...). With `digest` the groups' place takes
    groups_sha256, their SHA-256, worked out where they are written, so that none is stored or moved."""
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    ids = token_ids(docs)
    counts = stored(pair_counts(ids))
    total = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    least = max(1, -(-total // COMMON))
    often = counts.filter(F.col("n_docs") >= least).select((F.col("a_id") * F.lit(SIDE).cast("long") + F.col("b_id")).alias("pair"), "n_docs").orderBy("pair").toArrow()
    top = np.zeros(SIDE, np.int64)  # one number per id of A
    for r in counts.groupBy("a_id").agg(F.max("n_docs").alias("most")).collect():
        top[r.a_id] = r.most
    shared = spark.sparkContext.broadcast((often.column("pair").to_numpy(), often.column("n_docs").to_numpy(), top))
    memo = spark.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, names = kept(memo, "spelled", Spelled), kept(memo, "names", marked_names)
        pairs, n_docs, most = shared.value
        for b, x_a, x_b, aligned in _batches(batches, spelled):
            n = b.num_rows
            doc, pair, links = aligned.distinct()
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = np.where(known, n_docs[at], 0) if len(pairs) else np.zeros(len(pair), np.int64)
            best = known & (count == most[pair // SIDE])
            sums = [np.zeros(n, np.int64) for _ in range(3)]
            for to, what in zip(sums, (links, links * best, links * count), strict=True):
                np.add.at(to, doc, what)
            rest = np.flatnonzero(~known)
            offsets = np.searchsorted(doc[rest], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(pair[rest]), pa.array(links[rest])], names=["pair", "links"]))
            groups = np.zeros(n, np.int64)
            if len(aligned.group_a):
                new = np.concatenate([[True], aligned.group_a[1:] != aligned.group_a[:-1]])
                np.add.at(groups, aligned.docs_a[new], 1)
            sizes = [pa.array(list(map(len, z)), pa.int64()) for z in (x_a, x_b)]
            written = aligned.written(names, n)
            if digest:
                written = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in written]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), *sizes, pa.array(groups), *map(pa.array, sums), pa.array(written, pa.string()), rare],
                                  names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last, "rare"])

    last = "groups_sha256" if digest else "groups"
    numbers = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string"
    found = ids.mapInArrow(run, numbers + ", rare array<struct<pair:long,links:long>>")
    return _with_rare(found, counts.filter(F.col("n_docs") < least), top, spark) if least > 1 else found.drop("row", "rare")


def _with_rare(found: DataFrame, counts: DataFrame, top: np.ndarray, spark) -> DataFrame:
    """The sums completed by the links of pairs that were not sent to every task."""
    found = stored(found)
    most = spark.createDataFrame([(i, int(n)) for i, n in enumerate(top) if n], "a_id int, most long")  # one row per id of A
    counts = counts.join(F.broadcast(most), "a_id").select((F.col("a_id") * F.lit(SIDE).cast("long") + F.col("b_id")).alias("pair"), "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("is_best"))
    asked = found.select("row", F.inline("rare"))
    more = asked.join(counts.hint("shuffle_merge"), "pair").groupBy("row").agg(F.sum(F.col("links") * F.col("is_best")).alias("more_best"), F.sum(F.col("links") * F.col("n_docs")).alias("more"))
    whole = found.drop("rare").join(more.hint("shuffle_merge"), "row", "left")
    zero = F.lit(0).cast("long")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", zero), "count_sum": F.col("count_sum") + F.coalesce("more", zero)}).drop("row", "more", "more_best")


def query(spark, sf_dir):
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


SQL = None
