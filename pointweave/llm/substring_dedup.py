"""Removal of repeated 50-word passages by suffix trees of groups of suffixes, split by prefixes of variable length.

Equal texts are one text first, known by its least doc_id: a copy with a larger doc_id goes whole if it has a window.

Suffixes are indexed at sampled places. Of each 50-word window the run of PREFIX words with the least hash is its anchor;
equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so there are some twenty
times fewer anchors than words; a text that has an anchor often has one row for it. The suffix at an anchor stands for the suffixes of all windows that chose it, which begin at
most 40 words to its left; its first PREFIX words are its prefix. Prefixes of one document only are dropped.

A prefix whose suffixes hold more than GROUP_WORDS words is lengthened: the windows are split by how far left of the anchor
they begin, into blocks of 12, then 4, then 1 places, and each block goes by the words that all its windows share, so the
prefixes grow from 10 to 39, 47 and 50 words (46 to 50 in the last block, which is short). This ends when every group fits.
At 50 words a prefix is a window; it is a node itself, of which only the least doc_id is asked, combined before the shuffle.

In a group all suffixes are sorted, and lengths of the common prefixes of neighbours give the internal nodes that are at
least 50 deep. Such a node is a repeat, as long as it is deep; of its leaves those of the least doc_id stay, the words below
the others are cut. Tasks read many small groups one after the other and hold one pack of them at a time.

Defined results: a null text has no words; of repeated rows with one doc_id none precedes the other; a row without doc_id
neither removes nor loses words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, join_narrow, stored, whole_text
from .textops import WordCodes, run_hashes, words_of

WINDOW = 50
PREFIX = 10
#: Places that a block of windows spans, from the first prefix to whole windows.
WIDTHS = (WINDOW - PREFIX + 1, 12, 4, 1)
#: Words of the suffixes of a group; a prefix that has more is lengthened.
GROUP_WORDS = 400_000
#: Words at which a pack of groups is closed; it holds at most as many and one group.
PACK_WORDS = 400_000
#: The suffixes of one text under one prefix: the anchor's place, the first window and the number of windows of each.
AT = "array<struct<place:int,first:int,n:int>>"
AT_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("first", pa.int32()), ("n", pa.int32())]))
#: Texts beyond 2^24 words are anchored in parts, as places take 24 bits beside the hash.
PART = 1 << 24


def anchors_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of each anchor of one document."""
    found = []
    for at in range(0, max(1, len(codes) - WINDOW + 1), PART - WINDOW):
        part = codes[at:at + PART]
        if len(part) < WINDOW:
            continue
        h = run_hashes(part, PREFIX)
        low = (h & ~np.uint64(PART - 1)) | np.arange(len(h), dtype=np.uint64)
        span, step = WINDOW - PREFIX + 1, 1
        while step * 2 <= span:  # the least of `step` neighbours, then of twice as many
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:len(low) - (span - step)], low[span - step:]) if span > step else low
        place = (low & np.uint64(PART - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[first]].view(np.int64), place[first] + at, first + at, np.diff(np.append(first, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.array([], np.int64),) * 4


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and anchor, however often the text has it."""
    coded = WordCodes()
    for b in batches:
        ids, ts, found = [], [], []
        for i, t, text in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("body").to_pylist(), strict=True):
            h, *at = anchors_of(coded.of(words_of(text)))
            if len(h):
                order = np.argsort(h, kind="stable")
                h = h[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                ids.append(np.full(len(new), i))
                ts.append(np.full(len(new), t))
                found.append((h[new], np.diff(np.append(new, len(h))), *(x[order] for x in at)))
        if found:
            h, many, place, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
            edges = np.concatenate([[0], np.cumsum(many)])
            at = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (place, first, n)], fields=list(AT_ARROW.value_type))
            columns = [np.concatenate(ids), np.concatenate(ts), h, np.add.reduceat(n, edges[:-1]) + (WINDOW - 1) * many]
            yield pa.record_batch([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), at)], names=["id", "t", "h", "words", "at"])


def deep_nodes(codes: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The internal nodes at least `depth` deep of the suffix tree: the suffixes at `starts` in order, the node of each
    (those with a node of their own have no partner), and how deep each node is, up to twice the depth's power of two.

    Suffixes are ranked by their first 1, 2, 4, ... words; the same ranks give the common words of neighbours."""
    ranks, reach = [np.unique(codes, return_inverse=True)[1]], 1
    while reach * 2 <= depth:
        now = ranks[-1]
        pair = now * np.int64(len(codes) + 1)
        pair[:-reach] += now[reach:] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1])
        reach *= 2
    top = ranks[-1]
    order = starts[np.argsort(top[starts] * np.int64(len(codes) + 1) + top[starts + reach], kind="stable")]
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(x), np.int64)
    for step, rank in [(reach, top), *((2**k, r) for k, r in reversed(list(enumerate(ranks))))]:
        same = np.where(rank[x] == rank[y], step, 0)
        common, x, y = common + same, x + same, y + same
    node = np.concatenate([[0], np.cumsum(common < depth)])
    deep = np.full(node[-1] + 1, np.iinfo(np.int64).max)
    inside = common >= depth
    np.minimum.at(deep, node[1:][inside], common[inside])
    return order, node, deep


def _repeats(ids: np.ndarray, ts: np.ndarray, firsts: np.ndarray, slices: list[str]) -> pa.RecordBatch | None:
    """Stretches of words that a smaller document also has, from one pack of slices."""
    names: dict[str, int] = {}
    size = np.fromiter((s.count(" ") + 1 for s in slices), np.int64, len(slices))
    begin = np.cumsum(size + 1) - size - 1
    ends = begin + size  # each slice ends in a mark of its own, so that no suffix runs on into the next
    codes = np.full(ends[-1] + 1, -1, np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.fromiter((names.setdefault(w, len(names)) for s in slices for w in s.split(" ")), np.int64)
    codes[ends] = len(names) + np.arange(len(ends))
    n = size - WINDOW + 1
    starts = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, node, deep = deep_nodes(codes, starts, WINDOW)
    owner = np.searchsorted(begin, order, "right") - 1
    least = np.full(len(deep), np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids[owner])
    hit = ids[owner] > least[node]
    if not hit.any():
        return None
    order, owner, length = order[hit], owner[hit], deep[node[hit]]
    back = np.argsort(order)
    o, place, length = owner[back], order[back], length[back]
    s = firsts[o] + place - begin[o]
    cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)]))
    return pa.record_batch([pa.array(ids[o[cut]]), pa.array(ts[o[cut]]), pa.array(s[cut].astype(np.int32)), pa.array(np.maximum.reduceat(s + length, cut).astype(np.int32))], names=["id", "t", "a", "b"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices sorted by prefix: whole groups are packed until a pack is large enough."""
    held, words, last = [], 0, None

    def build():
        ids, ts, firsts, slices = (sum((list(x[k]) for x in held), []) for k in range(4))
        return _repeats(np.array(ids, np.int64), np.array(ts, np.int64), np.array(firsts, np.int64), slices)

    for b in batches:
        h = b.column("h").to_numpy()
        cols = [b.column(c).to_pylist() for c in ("id", "t", "first", "slice")]
        edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for x, y in zip(edges, edges[1:], strict=False):
            if words >= PACK_WORDS and h[x] != last:
                if (out := build()) is not None:
                    yield out
                held, words = [], 0
            held.append([c[x:y] for c in cols])
            words += sum(s.count(" ") + 1 for s in cols[3][x:y])
            last = h[x]
    if held and (out := build()) is not None:
        yield out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the suffixes of groups that fit."""
    def cut(words: list[str], found: list[dict]) -> Iterator[tuple]:
        for group in found:
            for x in group["at"]:
                yield group["h"], x["first"], " ".join(words[x["first"]:x["first"] + x["n"] + WINDOW - 1])

    for b in batches:
        yield from _rows(b, False, cut, {"h": pa.int64(), "first": pa.int32(), "slice": pa.string()})


def _lengthened(width: int):
    """Suffixes of groups that do not fit, by longer prefixes: windows that begin j words left of the anchor, j in one
    block of `width` places, share the words from the block's farthest beginning to the end of its nearest window's."""
    def split(words: list[str], found: list[dict]) -> Iterator[tuple]:
        longer: dict = {}
        for x in (x for group in found for x in group["at"]):
            a, far = x["place"], x["place"] - x["first"]
            near = far - x["n"] + 1
            for block in range(near // width, far // width + 1):
                j0, j1 = block * width, min(block * width + width - 1, WINDOW - PREFIX)
                low, high = max(j0, near), min(j1, far)
                digest = hashlib.blake2b(" ".join(words[a - j0:a - j1 + WINDOW]).encode(), digest_size=16).digest()
                longer.setdefault(digest, []).append({"place": a, "first": a - high, "n": high - low + 1})
        for digest, at in longer.items():
            h = digest if width == 1 else int.from_bytes(digest[:8], "little", signed=True)
            yield h, sum(x["n"] + WINDOW - 1 for x in at), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(b, True, split, {"h": pa.binary() if width == 1 else pa.int64(), "words": pa.int64(), "at": AT_ARROW})
    return run


def _rows(b: pa.RecordBatch, long: bool, make, kinds: dict) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.int64(), "t": pa.int64(), **kinds}
    rows: list[tuple] = []

    def batch():
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for i, t, text, found in zip(*(b.column(c).to_pylist() for c in ("id", "t", "body", "found")), strict=True):
        found = [x for x in found if x["long"] == long]
        for r in make(words_of(text), found) if found else ():
            rows.append((i, t, *r))
            if len(rows) >= 5000:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


def _met(suffixes: DataFrame) -> DataFrame:
    """The prefixes of at least two documents: their least id, and whether their suffixes are too many for a group."""
    groups = suffixes.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("words").alias("words"))
    return groups.filter("lo < hi").select("h", "lo", (F.col("words") > GROUP_WORDS).alias("long"))


def repeated_stretches(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From id, t, body, one row per (id, t): the keys (id, t) of texts that share a prefix, and the stretches
    (id, t, cuts: array of a, b) of words to remove."""
    suffixes = stored(texts.mapInArrow(_anchors, f"id long, t long, h long, words long, at {AT}"))
    keys, slices, cuts = None, [], []
    for width in WIDTHS[1:]:
        found = suffixes.join(_met(suffixes).hint("shuffle_merge"), "h").groupBy("id", "t")
        found = stored(found.agg(F.collect_list(F.struct("h", "at", "long")).alias("found")))  # of one document
        keys = found.select("id", "t") if keys is None else keys
        texts = join_narrow(texts, stored(found.select("id", "t")), ["id", "t"], "left_semi")
        texts = stored(texts.select("id", "t", "body").join(found.hint("shuffle_merge"), ["id", "t"]))
        slices.append(texts.mapInArrow(_slices, "id long, t long, h long, first int, slice string"))
        texts = texts.filter(F.exists("found", lambda x: x["long"]))
        if texts.isEmpty():
            break
        kind = "binary" if width == 1 else "long"
        suffixes = stored(texts.mapInArrow(_lengthened(width), f"id long, t long, h {kind}, words long, at {AT}"))
    else:
        later = suffixes.join(_met(suffixes).hint("shuffle_merge"), "h").filter("lo < id")
        cuts = [later.select("id", "t", F.transform("at", lambda x: F.struct(x["first"].alias("a"), (x["first"] + WINDOW).alias("b"))).alias("cuts"))]
    for s in slices:
        trees = s.repartition("h").sortWithinPartitions("h").mapInArrow(_trees, "id long, t long, a int, b int")
        cuts.append(trees.select("id", "t", F.array(F.struct("a", "b")).alias("cuts")))
    every = reduce(DataFrame.unionByName, cuts)
    return keys, every.groupBy("id", "t").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, texts = [], [], []
        for text, cuts in zip(b.column("body").to_pylist(), b.column("cuts").to_pylist(), strict=True):
            words = words_of(text)
            n.append(len(words))
            if cuts and len(words) >= WINDOW:
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, [c["a"] for c in cuts], 1)
                np.add.at(gone, [min(c["b"], len(words)) for c in cuts], -1)
                words = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
            removed.append(n[-1] - len(words))
            texts.append(" ".join(words))
        yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text."""
    arrow_rows(docs.sparkSession, 2000)
    body, digest = whole_text(), F.sha2(whole_text(), 256)
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")  # tells texts of one id apart
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("t"), body.alias("body"))
    known = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("t"), F.unhex(F.substring(digest, 1, 32)).alias("d")).filter("id IS NOT NULL")
    known = stored(known.groupBy("d", "id", "t").agg(F.count(F.lit(1)).alias("n")))
    first = stored(known.groupBy("d").agg(F.min(F.struct("id", "t")).alias("x")).select("x.*"))
    copies = stored(known.select("id", "t").join(first.hint("shuffle_merge"), ["id", "t"], "left_anti"))
    again = stored(known.filter("n > 1").select("id", "t"))
    texts = join_narrow(rows.filter("id IS NOT NULL"), copies, ["id", "t"], "left_anti")
    if not again.isEmpty():  # rows that repeat with their id are one text, combined before the shuffle
        once = join_narrow(texts, again, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
        texts = join_narrow(texts, again, ["id", "t"], "left_anti").unionByName(once)
    shared, cuts = repeated_stretches(texts)
    marks = stored(shared.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True))))
    marked = join_narrow(rows, marks, ["id", "t"], "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b")))
    plain = marked.filter("copy IS NULL OR copy").select("id", "body", F.when(F.col("copy"), whole).alias("cuts"))
    touched = marked.filter("NOT copy").join(cuts.hint("shuffle_merge"), ["id", "t"], "left").select("id", "body", "cuts")
    return plain.unionByName(touched).mapInArrow(_keep, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", "doc_id")


def query(spark, sf_dir):
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = None
