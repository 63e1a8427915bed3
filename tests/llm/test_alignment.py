"""Aligned tokens against the libraries and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointweave.llm import token_alignment

from .conftest import odd_rows

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SPELLED = token_alignment.Spelled()
TEXT = st.text(st.one_of(st.sampled_from(" \n\tab'sé1.日😀　▁Σ"), st.characters(exclude_categories=["Cs"])), max_size=40)


def byte_letters():
    """The letters that stand for bytes in A's vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = byte_letters()


def tokens(text):
    """(id, bytes) of both sides; none where they do not spell the text."""
    if not text:
        return [], []
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def aligned(text):
    a, b = map(spans, tokens(text))
    links = Counter()
    k = 0
    for i, lo, hi in a:
        while k < len(b) and b[k][2] <= lo:
            k += 1
        j = k
        while j < len(b) and b[j][1] < hi:
            links[i, b[j][0]] += 1
            j += 1
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    groups, x, y = [], 0, 0
    for end in ends:
        own = [], []
        while x < len(a) and a[x][2] <= end:
            own[0].append(a[x][0])
            x += 1
        while y < len(b) and b[y][2] <= end:
            own[1].append(b[y][0])
            y += 1
        groups.append("|".join(",".join(map(str, s)) for s in own))
    return len(a), len(b), groups, links


def wanted(rows):
    found = [(i, *aligned(t)) for i, t in rows]
    count = Counter(pair for *_, links in found for pair in links)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    return Counter((i, a, b, len(g), sum(links.values()), sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
                   for i, a, b, g, links in found)


def got(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups) for r in df.collect())


@pytest.mark.parametrize("common", [token_alignment.COMMON, 40, 1])
def test_odd_rows(odd, monkeypatch, common):
    monkeypatch.setattr(token_alignment, "COMMON", common)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 1000)
    assert got(token_alignment.align(odd)) == wanted(odd_rows())


def test_a_table(spark, sf, texts):
    rows = token_alignment.query(spark, sf).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == wanted(list(texts.items()))


def test_pair_counts_are_of_documents(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "HELD", 3)
    rows = [(1, "to be to be to be"), (2, "to be"), (2, "to be"), (3, None)]
    ids = token_alignment.token_ids(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.a_id, r.b_id): r.n_docs for r in token_alignment.pair_counts(ids).collect()}
    assert found == dict(Counter(p for _, t in rows for p in aligned(t)[3]))


def test_empty_table(empty):
    assert token_alignment.align(empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_of_any_text(text):
    a, b = next(SPELLED.of([text]))
    want = tokens(text)
    assert a.tolist() == [i for i, _ in want[0]] and b.tolist() == [i for i, _ in want[1]]


def test_long_runs():
    for text in (" " * 300_000 + "x", "x" * 200_000, "\n" * 100_000, "😀" * 20_000):
        a, b = next(SPELLED.of([text]))
        want = tokens(text)
        assert a.tolist() == [i for i, _ in want[0]] and b.tolist() == [i for i, _ in want[1]]
