"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to the documents' frequencies.

A pre-token is a run of the space mark with what follows up to the next one, or a line break: no piece of the vocabulary
reaches across these borders (checked when the vocabulary is loaded), so the pieces of a text are those of its pre-tokens.

First the distinct pre-tokens are found (combined in each task before the shuffle) and counted by the library once each.
Of this dictionary, pre-tokens that make up at least 1 / COMMON of all occurrences are at most COMMON by arithmetic; they
go to every task. All others meet the documents' frequencies in a shuffled join, where by that same bound no key is hot.

A row is known by its doc_id and a hash of its text (64 bits where there is no doc_id, else 32). Rows with both in common
whose texts differ by a second, independent hash are found and counted by themselves, each pre-token once per text.

Defined results: a null text counts as empty and has no tokens; repeated rows each get their count, also where texts share
a doc_id; a null doc_id stays null; an empty table gives an empty result; extra columns are ignored; a very long text is
read whole by one task, and its pre-tokens are spread over all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_rows, stored, tokenizer_path, whole_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Proven bound of the broadcast part of the dictionary.
COMMON = 1_000_000
#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 400_000

MARK = "▁"
_PRETOKEN = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def _counter(model: str):
    """The function from pre-tokens to their numbers of pieces."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
    for i in range(lib.get_piece_size()):
        piece = lib.id_to_piece(i)
        if re.search(f"[^{MARK}]{MARK}|\n", piece):
            raise ValueError(f"piece {piece!r} reaches across pre-tokens")

    def count(tokens: list[str]) -> list[int]:
        # A line break in front stands for the text's beginning: the library adds its mark there, and both are a piece each.
        return [len(x) - 2 for x in lib.encode(["\n" + t.replace(MARK, " ") for t in tokens], num_threads=1)]

    return count


_FOUND = pa.schema([("pretoken", pa.string()), ("freq", pa.int64())])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("body").to_pylist():
            seen.update(pretokens(text))
            if len(seen) > HELD:
                yield pa.record_batch([list(seen), list(seen.values())], schema=_FOUND)
                seen = Counter()
    if seen:
        yield pa.record_batch([list(seen), list(seen.values())], schema=_FOUND)


def dictionary(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """pretoken, freq (over all documents), pieces: one row per distinct pre-token."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(count(b.column(0).to_pylist()), pa.int64())], names=["pretoken", "freq", "pieces"])

    found = docs.mapInArrow(_distinct, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    return stored(found.mapInArrow(pieces, "pretoken string, freq long, pieces long"))


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    arrow_rows(spark, 2000)
    body = whole_text()
    no_id = F.col("doc_id").isNull()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.when(no_id, F.xxhash64(body)).otherwise(F.hash(body)).alias("h"), F.xxhash64(F.lit(1), body).alias("other"), body.alias("body"))
    words = dictionary(rows.select("body"), model)
    total = words.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]
    least = max(2, -(-total // COMMON))
    common = spark.sparkContext.broadcast({r.pretoken: r.pieces for r in words.filter(F.col("freq") >= least).select("pretoken", "pieces").toLocalIterator()})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = common.value
        for b in batches:
            texts = b.column("body").to_pylist()
            n = [sum(pieces.get(t, 0) for t in pretokens(x)) for x in texts]
            yield pa.record_batch([b.column("id"), b.column("h"), b.column("other"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())], names=["id", "h", "other", "n_bytes", "known"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = common.value
        for b in batches:
            ids, hs, names, freqs = [], [], [], []
            for i, h, x in zip(b.column("id").to_pylist(), b.column("h").to_pylist(), b.column("body").to_pylist(), strict=True):
                found = Counter(t for t in pretokens(x) if t not in pieces)
                ids += [i] * len(found)
                hs += [h] * len(found)
                names += found
                freqs += found.values()
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(names, pa.string()), pa.array(freqs, pa.int32())], names=["id", "h", "pretoken", "freq"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model)
        for b in batches:
            texts = b.column("body").to_pylist()
            freqs = [Counter(pretokens(x)) for x in texts]
            n = [sum(k * m for k, m in zip(count(list(f)), f.values(), strict=True)) for f in freqs]
            yield pa.record_batch([b.column("id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    left = stored(rows.mapInArrow(known, "id long, h long, other long, n_bytes long, known long").groupBy("id", "h").agg(F.first("n_bytes").alias("n_bytes"), F.first("known").alias("known"), F.count(F.lit(1)).cast("int").alias("copies"), (F.min("other") != F.max("other")).alias("mixed")))
    mixed = left.filter("mixed").select(F.col("id").alias("m_id"), F.col("h").alias("m_h"))
    others = words.filter(F.col("freq") < least).select("pretoken", "pieces").hint("shuffle_merge")
    sums = rows.mapInArrow(rare, "id long, h long, pretoken string, freq int").join(others, "pretoken").groupBy(F.col("id").alias("s_id"), F.col("h").alias("s_h")).agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    n = F.col("known") + F.coalesce(F.floor(F.col("more") / F.col("copies")), F.lit(0))
    met = left.filter("NOT mixed").join(sums, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left")
    out = met.select(F.col("id").alias("doc_id"), "n_bytes", n.cast("long").alias("n_tokens"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
    if n_mixed := mixed.count():
        narrow = F.broadcast(mixed) if n_mixed <= BROADCAST_ROWS else mixed.hint("shuffle_merge")
        odd = rows.join(narrow, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left_semi")
        out = out.unionByName(odd.select("id", "body").mapInArrow(alone, "doc_id long, n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
