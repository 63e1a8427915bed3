"""The permutation index and the grid codes against brute force."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.llm import grid_codes, permutation_index
from pointweave.llm.permutation_index import Block, Index, Pivots, far

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, score string, v string, id string, digest string, band int, code string"


def vectors(n=120, width=20, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.3, (n, width)).astype("float32").astype(float).tolist()


def odd_vectors():
    """Null, empty, zero, short, huge and broken vectors, copies, repeated rows, rows without an id."""
    v = vectors()
    rows = [(i, x, i % 3 if i % 4 else None) for i, x in enumerate(v)]
    rows += [(200 + i, v[7], 1) for i in range(60)] + [(5, v[5], 2), (5, v[5], 2), (5, v[9], 2), (None, v[4], 0), (300, None, 0), (301, [], 1), (302, [0.0] * 20, 1), (303, v[3][:7], 1), (304, [-0.0] + v[3][1:], None),
             (305, [NAN] + v[1][1:], 1), (306, [INF] + v[1][1:], 1), (307, [None] + v[1][1:], 1), (320, [30.0 * x for x in v[2]], 2), (340, [1e-6 * x for x in v[2]], 2), (360, [1e30] * 20, None), (-20, v[11], 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4, 1, "clash") for r in rows], SCHEMA)


def padded(v, width):
    return list(v) + [0.0] * (width - len(v))


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def neighbours_of(rows, k):
    """By query id: all (score, id) in order, from products summed from the first component on."""
    base = {(i, tuple(padded(np.float32(v).astype(float) + 0.0, 20))) for i, v, _ in rows if i is not None and sound(v) and any(v)}
    out = {}
    for q, x in base:
        if q % 20 == 0:
            scores = []
            for i, y in base:
                if i != q:
                    s = 0.0
                    for a, b in zip(x, y, strict=True):
                        s += a * b
                    scores.append((-s, i))
            out[q] = [(-s, i) for s, i in sorted(scores)[:k]]
    return out


def test_a_small_table_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK_BYTES", 1)  # 64 entries a block
    monkeypatch.setattr(permutation_index, "SLICE", 3)
    rows = odd_vectors()
    got = Index(frame(spark, rows), 20).nearest(frame(spark, [r for r in rows if r[0] is not None and r[0] % 20 == 0]), recall=1.0).collect()
    want = neighbours_of(rows, 20)
    assert {r.query_id for r in got} == set(want)
    found = 0
    for q, near in want.items():
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [(-s, i) for _, s, i in mine] == sorted((-s, i) for _, s, i in mine)
        scores = {i: set() for _, i in near}
        found += len({i for _, _, i in mine} & set(scores))
    assert found >= 0.97 * sum(map(len, want.values()))


@pytest.mark.parametrize("n", [1, 2, 15, 30])
def test_few_rows_return_all_others(spark, n):
    rows = [(20 * i, v, 0) for i, v in enumerate(vectors(n))]
    got = Index(frame(spark, rows), 20).nearest(frame(spark, rows)).collect()
    want = neighbours_of(rows, 20)
    if n > 21:  # some may be missed among many; none may be missing in number
        assert len(got) == 20 * n
    else:
        assert {(r.query_id, r.rank): (r.score, r.vec_id) for r in got} == {(q, k + 1): x for q, near in want.items() for k, x in enumerate(near)}


def test_nothing_to_search(spark):
    none = frame(spark, [])
    assert Index(none).nearest(none).collect() == []
    some = frame(spark, odd_vectors())
    assert Index(none).nearest(some).collect() == [] and Index(some).nearest(none).collect() == []


def test_recall_over_a_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.array(table.embedding.tolist(), float)
    got = permutation_index.query(spark, sf).toPandas()
    hit = 0
    for q in np.flatnonzero(table.vec_id % 20 == 0):
        score = x @ x[q]
        score[q] = -9
        near = got[got.query_id == table.vec_id[q]].sort_values("rank")
        assert len(near) == 20 and near.score.is_monotonic_decreasing
        hit += len(set(table.vec_id[np.argsort(-score)[:20]]) & set(near.vec_id))
        for i, s in zip(near.vec_id, near.score, strict=True):
            want = 0.0
            for a, b in zip(x[q], x[np.flatnonzero(table.vec_id == i)[0]], strict=True):
                want += a * b
            assert s == want
    assert hit >= 0.9 * 20 * (table.vec_id % 20 == 0).sum()


def test_footrule_of_prefixes():
    rng = np.random.default_rng(1)
    a, b = (np.array([rng.permutation(40)[:16] for _ in range(30)]) for _ in range(2))
    block = Block(40, b, rng.normal(size=(30, 4)), np.arange(30), [bytes([i]) for i in range(30)])
    assert block.footrule(a).tolist() == [[far(x, y) for y in b] for x in a]


def test_bands_and_orders_do_not_change_with_length():
    x = np.array(vectors(50))
    pivots = Pivots(x[:31])
    assert (pivots.order(x, 16) == pivots.order(1e200 * x, 16)).all() and (pivots.order(x, 31)[:, :16] == pivots.order(x, 16)).all()
    assert (Pivots.band(x * 8) == Pivots.band(x) + 3).all() and len(set(Pivots.band(x / np.linalg.norm(x, axis=1)[:, None] * (1 + 1e-7 * np.arange(50)[:, None] - 2e-6)).tolist())) == 1


def codes_of(rows, parts=16, entries=64, rounds=2):
    kept = [(i, list(v), label) for i, v, label in rows if sound(v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    part = width // parts
    ints = [(i, [max(-2**26, min(2**26, math.floor(256 * float(np.float32(x))))) for x in padded(v, width)], label) for i, v, label in kept]
    first = [v for _, v in sorted((i, v) for i, v, _ in ints if i is not None)]
    first = sorted(((i, np.array(v, "<i4").tobytes(), v) for i, v, _ in ints if i is not None))[:entries]
    books = [[v[p * part:(p + 1) * part] for _, _, v in first] for p in range(parts)]

    def assign(v, p):
        own = v[p * part:(p + 1) * part]
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = {}
            for _, v, _ in ints:
                members.setdefault(assign(v, p)[1], []).append(v[p * part:(p + 1) * part])
            new.append([[sum(c) // len(c) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])])
        books = new
    out, of_label = [], {}
    for i, v, label in ints:
        found = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        of_label[label] = of_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, of_label[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize("which", ["odd", "few"])
def test_codes_of_odd_rows(spark, which):
    rows = odd_vectors() if which == "odd" else odd_vectors()[:9]
    coded, books = grid_codes.compress(frame(spark, rows))
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, grid_codes.digest(books)) for r in coded.collect()), key=str) == codes_of(rows)


def test_codes_of_no_rows(spark):
    coded, books = grid_codes.compress(frame(spark, []))
    assert coded.collect() == [] and books.shape == (16, 0, 0)
    coded, _ = grid_codes.compress(frame(spark, [(1, [], 0), (2, None, 0)]))
    assert [(r.vec_id, r.code, r.error) for r in coded.collect()] == [(1, "00" * 16, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 40, 4000]), st.integers(1, 64), st.integers(1, 6))
def test_cells_hold_every_nearest_entry(seed, scale, n, width):
    rng = np.random.default_rng(seed)
    entries, parts = rng.integers(-scale, scale + 1, (n, width)), rng.integers(-2 * scale, 2 * scale + 1, (200, width))
    d = ((parts[:, None] - entries) ** 2).sum(2)
    index, error = grid_codes.Codebook(entries).nearest(parts)
    assert (index == d.argmin(1)).all() and (error == d.min(1)).all()
