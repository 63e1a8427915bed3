"""Near-duplicates by weighted MinHash over bags of five-word shingles (BagMinHash).

A text is the bag of its runs of SHINGLE words; the similarity of two bags is the sum of the smaller counts over the sum
of the larger ones. Signatures: the weight axis of every shingle is cut into cells [0,1), [1,2), [2,4), ...; each cell has
a Poisson process of its own whose points come in ascending time and carry a register and a level, and a bag sees the
points at levels below its count. The earliest point that a register sees is its component. Processes stop at a horizon
after which hardly any register is still open, and go on for the bags that have one, so the work per text is about its
distinct shingles plus m log m points, and no component depends on how texts are batched.

Texts with equal words are one node from the start. Nodes that agree in a band are candidates. All pairs of a bucket are
never listed. First come light rounds: every bucket names a leader and every node is compared with one leader of another
class; verified links merge classes, so that large groups of copies fold into one. When these find little more, nodes that
cannot have a link any more leave: of the nodes in open buckets, the shingles that no other one has are counted, and a
node whose other shingles are too few for similarity 0.8 with the smallest member of its bucket is out, as is a pair of
which one has too few for the other's size. That is exact, costs a row per shingle, and takes what a large group of copies
leaves behind: texts with many changes of their own. Buckets whose members are still of several classes then pick leaders,
few and then more, who are compared with all members of other classes and leave. A bucket is done when its members are of
one class. Comparing within a class cannot change the classes, so no link between classes of candidates is lost.
Verification is exact: the intersection of the bags' counted shingles.

Defined results: a null text counts as empty; texts of fewer than SHINGLE words are one shingle, texts without words are
equal to each other; rows with equal doc_id and text are one document and stay or go together; the class id is the least
doc_id; a row without doc_id is never the one that stays unless its whole class has none; an empty table gives an empty
result; extra columns are ignored by `classes` and carried by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, join_narrow, stored, whole_text
from .textops import WordCodes, mixed, run_hashes, words_of

SHINGLE = 5
#: Similarity 4/5: pairs of similarity 0.8 share one of the bands with a probability of 0.99999.
NUMERATOR, DENOMINATOR = 4, 5
ROWS, BANDS = 7, 48
REGISTERS = ROWS * BANDS
#: Distinct shingles whose processes run at once.
AT_ONCE = 150_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bag(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts."""
    if not len(codes):
        return np.array([], np.uint64), np.array([], np.int64)
    return np.unique(run_hashes(codes, min(SHINGLE, len(codes))) + np.uint64(min(SHINGLE, len(codes))), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of REGISTERS numbers per bag; bags must not be empty."""
    size = np.array([len(x[0]) for x in bags])
    item, weight = np.concatenate([x[0] for x in bags]), np.concatenate([x[1] for x in bags]).astype(np.int64)
    doc = np.repeat(np.arange(len(bags)), size)
    cells = np.ceil(np.log2(weight)).astype(np.int64) + 1  # cells that reach below the weight
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    item, weight, doc = (np.repeat(x, cells) for x in (item, weight, doc))
    low = np.where(cell == 0, 0, 1 << np.maximum(cell - 1, 0))
    width = np.maximum(low, 1)
    state = mixed(item + cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    total = np.bincount(doc, weight, len(bags))
    horizon = (np.log(REGISTERS) + 4) / total
    best = np.full(len(bags) * REGISTERS, np.inf)
    out = np.zeros(len(bags) * REGISTERS, np.uint64)

    def gap(s, w):
        u = ((mixed(s) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        return -np.log(u) / (REGISTERS * w)

    time = gap(state, width)
    waiting = np.arange(len(item))
    while len(waiting):
        now = waiting[time[waiting] <= horizon[doc[waiting]]]
        while len(now):
            mark = mixed(state[now] ^ np.uint64(0xA0761D6478BD642F))
            level = low[now] + ((mark >> np.uint64(32)) * width[now].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            seen = now[level < weight[now]]
            mark = mark[level < weight[now]]
            slot = doc[seen] * REGISTERS + (mark & np.uint64(0xFFFFFFFF)).astype(np.int64) % REGISTERS
            np.minimum.at(best, slot, time[seen])
            won = time[seen] == best[slot]
            out[slot[won]] = mixed(mark[won] + state[seen[won]])
            state[now] += _STEP
            time[now] += gap(state[now], width[now])
            now = now[time[now] <= horizon[doc[now]]]
        open_ = np.isinf(best.reshape(len(bags), REGISTERS)).any(1)
        horizon[open_] *= 1.5
        waiting = waiting[open_[doc[waiting]]]
    return out.reshape(len(bags), REGISTERS)


def bands_of(signature: np.ndarray) -> np.ndarray:
    part = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), part.shape[:2]).copy()
    for k in range(ROWS):
        out = mixed(out + part[:, :, k])
    return out.view(np.int64)


def _key(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coded = WordCodes()
    for b in batches:
        ids, ts, rows, held = b.column("id").to_pylist(), b.column("t").to_pylist(), [], 0
        texts = b.column("body").to_pylist()
        at = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            rows.append((_key(words), bag(coded.of(words))))
            held += len(words)
            if held >= AT_ONCE or i + 1 == len(texts):
                full = [k for k, (_, x) in enumerate(rows) if len(x[0])]
                bands = [[]] * len(rows)
                if full:
                    for k, x in zip(full, bands_of(signatures([rows[k][1] for k in full])), strict=True):
                        bands[k] = x
                yield pa.record_batch([pa.array(ids[at:i + 1], pa.int64()), pa.array(ts[at:i + 1], pa.int64()), pa.array([k for k, _ in rows], pa.binary()), pa.array([int(x[1].sum()) for _, x in rows], pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                                      names=["id", "t", "key", "n", "bands"])
                rows, held, at = [], 0, i + 1


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted shingles as a set: the second occurrence of a shingle is an element of its own, and so on. `marks` are 16 bits
    of each element, numbered likewise: two sets have at least as many marks in common as elements."""
    coded = WordCodes()
    for b in batches:
        keys, bags, marks = [], [], []
        for text in b.column("body").to_pylist():
            words = words_of(text)
            item, n = bag(coded.of(words))
            keys.append(_key(words))
            bags.append(_numbered(item, n))
            short, inverse = np.unique(bags[-1].astype(np.uint16), return_inverse=True)
            n = np.bincount(inverse)
            marks.append((np.repeat(short, n).astype(np.int64) + (_nth(n) << 16)).astype(np.int32))
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(bags, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int32()))], names=["node", "bag", "marks"])


def _nth(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _numbered(item: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mixed(np.repeat(item, n) + _nth(n).astype(np.uint64) * _STEP).view(np.int64)


def _named(id_: Column) -> dict[str, Column]:
    """An id as two columns that are never null, because joins pass over null ids."""
    return {"nil": id_.isNull(), "id": F.coalesce(id_, F.lit(0).cast("long"))}


NAME = ["nil", "id", "t"]


def _verified(pairs: DataFrame, bags: DataFrame, few: bool = False) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold. If `few` of them are expected to, those whose marks already
    have too little in common go first, so that fewer bags move."""
    for column in ["marks", "bag"] if few else ["bag"]:
        left = bags.select(F.col("node").alias("a"), F.col(column).alias("x"))
        right = bags.select(F.col("node").alias("b"), F.col(column).alias("y"))
        met = pairs.join(left, "a").join(right, "b")
        both = F.size(F.array_intersect("x", "y"))
        pairs = met.filter(DENOMINATOR * both >= NUMERATOR * (F.size("x") + F.size("y") - both)).select("a", "b")
    return pairs


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links (a, b) reach from each of their ends. Every node points at the least node
    near it, and pointers are halved, until nothing changes."""
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    at = stored(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        # the least root among the neighbours, sent to the node and to its present root, then the root's root
        seen = ends.join(at.withColumnRenamed("node", "b").withColumnRenamed("root", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        met = at.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("near"))
        pull = met.groupBy("root").agg(F.min("near").alias("pulled"))
        hop = met.join(pull, "root").select("node", "root", F.least("near", "pulled").alias("to"))
        far = hop.join(at.select(F.col("node").alias("to"), F.col("root").alias("next")), "to", "left")
        new = stored(far.select("node", F.col("root").alias("old"), F.least("to", F.coalesce("next", "to")).alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select("node", "root")
        at = new.select("node", "root")


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task every shingle once: in how many bags it is, and one of their nodes."""
    seen = {"item": [], "n": [], "node": []}
    for b in batches:
        bags = b.column("bag")
        items, first, n = np.unique(bags.flatten().to_numpy(), return_index=True, return_counts=True)
        owner = np.repeat(np.arange(b.num_rows), bags.value_lengths().to_numpy())
        for name, x in (("item", items), ("n", n), ("node", b.column("node").take(pa.array(owner[first])))):
            seen[name].append(x)
    if seen["item"]:
        items, inverse = np.unique(np.concatenate(seen["item"]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(seen["n"])).astype(np.int64)
        first = np.zeros(len(items), np.int64)
        first[inverse] = np.arange(len(inverse))
        yield pa.record_batch([pa.array(items), pa.array(n), pa.chunked_array(seen["node"]).combine_chunks().take(pa.array(first))], names=["item", "n", "node"])


def _possible(now: DataFrame, bags: DataFrame) -> DataFrame:
    """Of the rows (bucket, node, n, root, ...) of open buckets those that can still have a link, with `common`, how many
    of the node's shingles another node of an open bucket has too. Two bags of n and m shingles need 4/9 * (n + m) in
    common for a similarity of 4/5."""
    both = NUMERATOR + DENOMINATOR
    alone = bags.join(now.select("node").distinct(), "node", "left_semi").select("node", "bag").mapInArrow(_own, "item long, n long, node binary")
    alone = alone.groupBy("item").agg(F.sum("n").alias("n"), F.max("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    met = now.drop("common").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0).cast("long"))).drop("alone")
    least = met.groupBy("bucket").agg(F.min("n").alias("smallest"))
    smallest = F.greatest("smallest", F.ceil(F.col("n") * NUMERATOR / DENOMINATOR))
    return met.join(least, "bucket").filter(both * F.col("common") >= NUMERATOR * (F.col("n") + smallest)).drop("smallest")


def near_classes(signed: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(node, root) for the nodes that have a link; None if there is none."""
    nodes = signed.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    listed = nodes.select(F.col("key").alias("node"), "n", F.explode("bands").alias("bucket"))
    shared = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = stored(listed.join(shared, "bucket"))
    if members.isEmpty():
        return None
    # The text from which copies were made lies in the large buckets of all bands: it leads, as it is nearest to all of them.
    central = members.groupBy("node").agg(F.sum("many").alias("weight"))
    members = stored(members.drop("many").join(central, "node"))
    wanted = members.select(F.col("node").alias("key")).distinct()
    named = signed.withColumns(_named(F.col("id"))).select(*NAME, "key")  # a row with an id stands for its node where there is one
    keyed = stored(named.join(wanted, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*NAME)).alias("one")).select("one.*"))
    bags = stored(join_narrow(rows.withColumns(_named(F.col("id"))), keyed, NAME, "left_semi").dropDuplicates(NAME).mapInArrow(_bags, "node binary, bag array<long>, marks array<int>"))
    tried, roots, light, turn, leaders = None, None, True, 0, 1
    close = DENOMINATOR * F.least("n", "led.n") >= NUMERATOR * F.greatest("n", "led.n")
    possible = (NUMERATOR + DENOMINATOR) * F.least("common", "led.common") >= NUMERATOR * (F.col("n") + F.col("led.n"))
    while True:
        now = members if roots is None else members.join(roots, "node", "left")
        now = now.withColumn("root", F.coalesce(F.col("root"), F.col("node")) if roots is not None else F.col("node"))
        sides = [F.min("root").alias("lo"), F.max("root").alias("hi")]
        other = (F.col("root") != F.col("led.root")) & (F.col("node") != F.col("led.node")) & close
        if light:
            order = F.struct(F.xxhash64("node", F.lit(turn))) if turn else F.struct("weight", "node")
            open_ = now.groupBy("bucket").agg(*sides, F.max_by(F.struct("node", "root", "n", "weight"), order).alias("led")).filter("lo < hi").select("bucket", "led")
            pairs = now.join(open_, "bucket").filter(other).groupBy("node").agg(F.max_by("led.node", F.struct(F.xxhash64("bucket", F.lit(turn))) if turn else F.struct("led.weight", "led.node")).alias("leader"))
        else:
            now = _open(now, sides)
            while (here := now.count()) > 0:
                now = _open(_possible(now, bags), sides)
                if now.count() > 0.9 * here:
                    break
            if not here:
                return roots
            first = now.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("first"), F.count(F.lit(1)).alias("many"))
            lists = now.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # at most BANDS of them
            now = stored(now.join(first, "bucket").join(lists, "node"))
            if now.isEmpty():
                return roots
            once = F.col("bucket") == F.array_min(F.array_intersect("buckets", "led.buckets"))  # a pair meets in one bucket
            lead = (F.col("node") == F.col("first")) | (F.pmod(F.xxhash64("node", F.lit(leaders)), F.greatest(F.lit(1).cast("long"), F.floor(F.col("many") / leaders))) == 0 if leaders > 1 else F.lit(False))
            pairs = now.join(now.filter(lead).select("bucket", F.struct("node", "root", "n", "common", "buckets").alias("led")), "bucket").filter(other & possible & once).select("node", F.col("led.node").alias("leader"))
        pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        found = stored(_verified(pairs, bags, not light))
        n_found = found.count()
        if n_found:
            roots = found_classes(found, roots)
        if light:
            light = n_found > pairs.count() // 20
            turn += 1
        else:
            members = now.filter(~lead).select("node", "n", "weight", "bucket")  # leaders have met the whole bucket
            leaders *= 8


def _open(members: DataFrame, sides: list[Column]) -> DataFrame:
    """The rows of buckets whose members are of several classes, stored."""
    return stored(members.join(members.groupBy("bucket").agg(*sides).filter("lo < hi").select("bucket"), "bucket"))


def found_classes(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) with new links: only the classes that they join are worked through."""
    if roots is None:
        return components(links)
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    ends = stored(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b").distinct())
    if ends.isEmpty():
        return roots
    joined = components(ends)
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(moved.union(joined.join(roots, "node", "left_anti")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its near-duplicates and itself), class_size, kept; and t, which text of the id."""
    arrow_rows(docs.sparkSession, 2000)
    body = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(body).alias("t"), body.alias("body"))
    signed = stored(rows.mapInArrow(_sign, "id long, t long, key binary, n int, bands array<long>"))
    roots = near_classes(signed, rows)
    own = signed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    root = F.col("key")
    if roots is not None:
        own, root = own.join(roots.withColumnRenamed("node", "key"), "key", "left"), F.coalesce("root", "key")
    own = own.withColumn("root", root)
    whole = own.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("many").alias("class_size"))
    of_key = own.select("key", "root").join(whole, "root").select("key", "class_id", "class_size")
    out = signed.select(F.col("id").alias("doc_id"), "t", "key").join(of_key, "key")
    return out.select("doc_id", "t", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = stored(classes(docs.select("doc_id", "text")).filter("NOT kept").select(*[c.alias(f"__{n}") for n, c in _named(F.col("doc_id")).items()], F.col("t").alias("__t")).distinct())
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    named = named.select("row", *[c.alias(f"__{n}") for n, c in _named(F.col("row.doc_id").cast("long")).items()], F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("__t"))
    return join_narrow(named, gone, [f"__{n}" for n in NAME], "left_anti").select("row.*")


def query(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("t")


SQL = None
