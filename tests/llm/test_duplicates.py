"""Near-duplicates and repeated passages against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pointweave.llm import bag_minhash, substring_dedup

from .conftest import odd_rows, prose


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def classes_of(rows):
    """Least id by connected components over all pairs; ids None are left out of the least."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for _, t in rows]
    sizes = [sum(b.values()) for b in bags]
    for a, b in combinations(range(len(rows)), 2):
        if 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b]):
            both = sum((bags[a] & bags[b]).values())
            if 5 * both >= 4 * (sizes[a] + sizes[b] - both):
                parent[root(a)] = root(b)
    members = {}
    for x in range(len(rows)):
        members.setdefault(root(x), []).append(rows[x][0])
    return Counter((rows[x][0], min((i for i in members[root(x)] if i is not None), default=None), len(members[root(x)])) for x in range(len(rows)))


def test_signatures_estimate_the_similarity_of_bags():
    rng = np.random.default_rng(5)
    error = []
    for _ in range(30):
        items = rng.integers(0, 2**62, 300).astype(np.uint64)
        a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
        b = np.where(rng.random(300) < 0.7, a, b)
        s = bag_minhash.signatures([(items[a > 0], a[a > 0]), (items[b > 0], b[b > 0])])
        error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    bags = [(rng.integers(0, 2**62, n).astype(np.uint64), rng.integers(1, 50, n)) for n in (1, 3, 1, 400, 20)]
    assert (bag_minhash.signatures(bags) == np.concatenate([bag_minhash.signatures([b]) for b in bags])).all()


def near_rows():
    base = prose(50, 200).split(" ")
    rows = [(100 + i, " ".join(base[:i * 4] + [f"x{i}"] + base[i * 4 + 1:])) for i in range(20)]  # one word differs
    rows += [(200 + i, " ".join(base[:100 + 4 * i])) for i in range(20)]  # a chain: neighbours are near, ends are not
    return rows + [(300 + i, prose(300 + i, 60)) for i in range(15)]


@pytest.mark.parametrize("which", ["odd", "near"])
def test_classes(spark, odd, which):
    rows = odd_rows() if which == "odd" else near_rows()
    df = odd if which == "odd" else spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in bag_minhash.classes(df).collect()) == classes_of(rows)
    kept = bag_minhash.deduplicate(df)
    assert kept.columns == df.columns
    least = {c for _, c, _ in classes_of(rows)}
    assert {r.doc_id for r in kept.collect()} == least


def test_rows_without_an_id_join_classes_of_rows_with_one(spark):
    base, other = prose(60, 200).split(" "), prose(61, 90)
    near = [" ".join(base[:k] + [f"y{k}"] + base[k + 1:]) for k in (3, 90, 190)]
    rows = [(None, " ".join(base)), (7, " ".join(base)), (9, near[0]), (None, near[1]), (None, near[2]), (11, near[2]), (None, other), (None, other), (12, prose(62, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in bag_minhash.classes(df).collect()) == classes_of(rows)
    assert Counter((r.doc_id, r.text) for r in bag_minhash.deduplicate(df).collect()) == Counter([(7, " ".join(base)), (None, other), (None, other), (12, prose(62, 80))])


def test_classes_of_a_table(spark, sf, texts):
    got = {r.doc_id: r.class_id for r in bag_minhash.query(spark, sf).collect()}
    assert got == {i: c for i, c, _ in classes_of(list(texts.items()))}


def test_empty_tables(empty):
    assert bag_minhash.classes(empty).collect() == [] and bag_minhash.deduplicate(empty).collect() == []
    assert substring_dedup.remove_repeats(empty).collect() == []


def kept_of(rows):
    least = {}
    split = [(i, words_of(t)) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k:k + 50])
                least[key] = min(i, least.get(key, i))
    out = Counter()
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and least[tuple(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def digests(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("words", [400_000, 3000, 1])
def test_repeats_of_odd_rows(odd, monkeypatch, words):
    monkeypatch.setattr(substring_dedup, "GROUP_WORDS", words)
    assert digests(substring_dedup.remove_repeats(odd)) == kept_of(odd_rows())


def test_repeats_of_a_table(spark, sf, texts):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.query(spark, sf).collect())
    assert got == kept_of(list(texts.items()))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 400).astype(np.uint64), rng.integers(0, 5, 300).astype(np.uint64)
    b[100:170] = a[20:90]
    places = []
    for codes in (a, b):
        h, _, first, n = substring_dedup.anchors_of(codes)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and (first + n)[-1] == len(codes) - 49
        places.append({s: x for x, f, m in zip(h.tolist(), first.tolist(), n.tolist(), strict=True) for s in range(f, f + m)})
    assert all(places[0][20 + k] == places[1][100 + k] for k in range(21))


def test_deep_nodes_are_those_of_the_suffix_tree():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 3, 600)
    codes[300:390], codes[450:520] = codes[20:110], codes[40:110]
    codes = np.append(codes, 99)
    order, node, deep = substring_dedup.deep_nodes(codes, np.arange(551), 50)
    groups = {}
    for s in range(551):
        groups.setdefault(tuple(codes[s:s + 50]), set()).add(s)
    found = {}
    for s, x in zip(order.tolist(), node.tolist(), strict=True):
        found.setdefault(x, set()).add(s)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
    for x, places in found.items():
        if len(places) > 1:
            want = next(k for k in range(50, 96) if k == 95 or len({codes[s + k] for s in places if s + k < 601} | {-1 for s in places if s + k >= 601}) > 1)
            assert min(want, 95) == deep[x]


@pytest.mark.parametrize("words", [400_000, 2000, 1])
def test_prefixes_are_lengthened(spark, monkeypatch, words):
    monkeypatch.setattr(substring_dedup, "GROUP_WORDS", words)
    rng = np.random.default_rng(6)

    def some(n):
        return [f"w{x}" for x in rng.integers(0, 4000, n)]

    passage, long = some(64), some(300)
    rows = []
    for k in range(60):
        middle = [passage, long, long[40:200], some(30) * 4][k % 4]
        rows.append((int(k * 7 % 61), " ".join(some(int(rng.integers(0, 90))) + middle + some(int(rng.integers(0, 90))))))
    rows += [(x + 100, t) for x, t in rows[:9]] + [(x, t) for x, t in rows[5:8]] + [(rows[3][0], rows[20][1]), (None, rows[1][1])]
    assert digests(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == kept_of(rows)
