"""Tokenizer operators against the libraries, and packing against its rules."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointweave.llm import byte_bpe, packing, token_counts

from .conftest import odd_rows

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
WORDS = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = byte_bpe.ByteBPE(public_tokenizers.path(byte_bpe.RANKS))
COUNT = token_counts._counter(token_counts.MODEL)
IDS = packing.Ids(packing.TOKENIZER)
TEXT = st.text(st.one_of(st.sampled_from(" \n\tab'sé1.日😀　▁Σ"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text(text):
    ids = np.frombuffer(BPE.encode([text])[0], "<u4").tolist()
    assert ids == TIK.encode_ordinary(text) and BPE.decode(ids) == text.encode()
    assert sum(COUNT(token_counts.pretokens(text))) == len(PIECES.encode(text))
    assert np.frombuffer(IDS.of([text])[0], "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_round_trip_of_odd_rows(odd, empty):
    want = Counter()
    for i, text in odd_rows():
        ids = TIK.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = byte_bpe.round_trip(odd).collect()
    assert all(r.same for r in got) and Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.round_trip(empty).collect() == []
    back = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, (t or "").encode()) for i, t in odd_rows())


def test_counts_of_odd_rows(odd, empty, monkeypatch):
    want = Counter((i, len((t or "").encode()), len(PIECES.encode(t or "")), len(PIECES.encode(t or "")) > 4096) for i, t in odd_rows())
    assert Counter(map(tuple, token_counts.count_tokens(odd).collect())) == want
    monkeypatch.setattr(token_counts, "COMMON", 50)  # nearly all pre-tokens by the shuffled join
    assert Counter(map(tuple, token_counts.count_tokens(odd).collect())) == want
    assert token_counts.count_tokens(empty).collect() == []


def test_texts_that_share_an_id_and_a_hash_are_counted_apart(spark, monkeypatch):
    seen, pair = {}, None
    for k in range(400_000):  # two texts with one 32-bit hash
        text = f"text {k} " + "of words " * (k % 7)
        h = zlib.crc32(text.encode())
        if h in seen and len(seen[h]) != len(text):
            pair = seen[h], text
            break
        seen[h] = text
    rows = [(i, t) for i in (7, None, -(2**63)) for t in (*pair, pair[0], "some other text", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, len((t or "").encode()), len(PIECES.encode(t or "")), False) for i, t in rows)
    assert Counter(map(tuple, token_counts.count_tokens(df).collect())) == want
    monkeypatch.setattr(token_counts.F, "hash", lambda x: token_counts.F.crc32(x.cast("binary")))
    assert Counter(map(tuple, token_counts.count_tokens(df).collect())) == want
    monkeypatch.setattr(token_counts, "COMMON", 5)
    assert Counter(map(tuple, token_counts.count_tokens(df).collect())) == want


def test_counts_of_a_table(spark, sf, texts):
    assert {r.doc_id: r.n_tokens for r in token_counts.query(spark, sf).collect()} == {i: len(PIECES.encode(t)) for i, t in texts.items()}


def pieces_of(i, text):
    ids = np.array([*WORDS.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(i, s // 2048, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for s in range(0, len(ids), 2048)]


def packed_well(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))] and sum(n for _, n in items) <= 2048
    return len(bins)


@pytest.mark.parametrize("salt", [20_000, 3])
def test_packing_odd_rows_and_a_table(spark, odd, empty, sf, texts, monkeypatch, salt):
    monkeypatch.setattr(packing, "ROWS_PER_SALT", salt)
    for df, rows in ((odd, odd_rows()), (spark.read.parquet(f"{sf}/documents.parquet"), list(texts.items()))):
        got = packing.pack(df).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(p for i, t in rows for p in pieces_of(i, t))
        assert packed_well(got) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.pack(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=30))
def test_plan_places_every_piece_once(counts):
    plan, fill = packing.plan(counts, 60).tolist(), Counter()
    seen = set()
    by_length = {}
    for length, first, *rest in plan:
        by_length.setdefault(length, []).append((first, *rest))
    for length, n in counts.items():
        for k in range(n):
            first, sequence, each, offset = max(x for x in by_length[length] if x[0] <= k)
            at = (sequence + (k - first) // each, offset + (k - first) % each * length)
            cells = {(at[0], at[1] + c) for c in range(length)}
            assert not cells & seen and at[1] + length <= 60
            seen |= cells
            fill[at[0]] += length
    total = sum(k * v for k, v in counts.items())
    assert len(fill) <= 11 / 9 * max(-(-total // 60), sum(v for k, v in counts.items() if k > 30)) + 2


def test_plan_meets_the_bound_on_many_short_documents():
    rng = random.Random(3)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(50_000))
    rows = packing.plan(counts)
    total = sum(k * v for k, v in counts.items())
    assert max(r[2] for r in rows) + 1 <= -(-total // 2048) + 5


def test_packing_remembers_few_chunks_and_those_in_use(monkeypatch):
    ids, asked = packing.Ids(packing.TOKENIZER), Counter()

    def learn(chunks):
        asked.update(chunks)
        ids.known.update(dict.fromkeys(chunks, b"1234"))

    monkeypatch.setattr(ids, "_learn", learn)
    for k in range(1200):
        assert ids.of([" ".join(["the", *map(str, range(1000 * k, 1000 * k + 1000))])]) == [b"1234" * 1001]
    assert asked["the"] == 1 and len(ids.known) + len(ids.older) < 2 * packing.HELD + 3000 < 700_000
