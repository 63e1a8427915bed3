"""The weak-label classifier by held-out accuracy, the pipeline by its stages, and the subpackage's isolation."""

import os
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from pointweave.llm import weak_quality

from .conftest import odd_rows, prose
from .test_duplicates import classes_of
from .test_native import base_spans
from .test_tokens import pieces_of

MORE = os.environ.get("TEST_QUALITY_SF", "/root/testdata/sf0.01")


def test_accuracy_on_labels_that_were_not_used(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    got = {r.doc_id: r.kept for r in weak_quality.query(spark, MORE).collect()}
    right = [got[i] == bool(q) for i, q in labels.items()]
    assert np.mean(right) > 0.98
    assert np.mean([got[i] for i, q in labels.items() if q]) > 0.98


def test_estimation_finds_the_labellers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    k = len(weak_quality.LABELLERS)
    truth = np.where(rng.random((len(good), k)) < np.linspace(0.7, 0.95, k), good[:, None], ~good[:, None])
    digit = np.where(rng.random(truth.shape) < 0.2, 0, np.where(truth, 2, 1))
    pattern, counts = np.unique((digit * 3 ** np.arange(k - 1, -1, -1)).sum(1), return_counts=True)
    post, chance = weak_quality.estimate(pattern, counts)
    accuracy = chance[0, :, 2] / chance[0, :, 1:].sum(1)
    assert np.abs(accuracy - np.linspace(0.7, 0.95, k)).max() < 0.05 and abs(post @ counts / counts.sum() - 0.8) < 0.05


def test_odd_rows(odd, empty):
    got = weak_quality.judge(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd_rows())
    assert all(r.score == 0 and not r.kept for r in got if r.doc_id in (2, 3, 9))
    kept = weak_quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert weak_quality.judge(empty).collect() == [] and weak_quality.keep_good(empty).collect() == []


def test_rows_that_repeat_at_the_bound_of_the_sample_give_one_model(spark):
    texts = [prose(i, 60) for i in range(30)] + [f"{i} spam spam | buy | now | here" for i in range(30)]
    rows = [(i % 5, t) for i, t in enumerate(texts) for _ in range(40)]
    models = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        models.append(weak_quality.fit(df, train_rows=1010))
    assert (models[0].weights == models[1].weights).all() and models[0].weights.any()
    hidden = weak_quality.fit(spark.createDataFrame([(None, prose(1, 60))] * 300 + [(1, "a b c d e f")], "doc_id long, text string"), train_rows=20)
    assert len(hidden.weights) == len(models[0].weights)


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = {r.doc_id: r.kept for r in weak_quality.judge(docs).collect()}
    rows = {r.doc_id: r for r in docs.collect() if model[r.doc_id]}
    last = {}
    for i, r in rows.items():
        last[r.text] = max(i, last.get(r.text, i))
    rows = {i: rows[i].text for i in last.values()}
    rows = {c: rows[c] for _, c, _ in classes_of(list(rows.items()))}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == rows.keys()

    def redacted(text):
        at, parts = 0, []
        for a, _, b in base_spans(text):
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(parts) + text[at:]

    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(p for i, t in rows.items() for p in pieces_of(i, redacted(t)))


def test_stages_stand_odd_rows_and_empty_tables(spark, odd, empty, sf):
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, sf), stage(spark, empty, sf)
        assert none.collect() == [], name
        assert stage is corpus_pipeline.STAGES[-1][1] or got.columns == odd.columns, name


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder in ("pointweave", "catalog", "tools", "tests"):
        for at, _, names in os.walk(os.path.join(top, folder)):
            if not re.search(r"[/\\]llm(?:$|[/\\])", at):
                for n in names:
                    if n.endswith(".py"):
                        with open(os.path.join(at, n)) as f:
                            assert not re.search(r"pointweave\.llm|from \.+llm|corpus_pipeline", f.read()), n
