"""The classifier on texts whose class is plain, its optimiser against the optimum, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from lodestone.llm import quality


def corpus(n=400):
    rng = random.Random(1)
    words = "the of and thing water stone light over under with".split()
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(w if good else [x + "$$$" for x in w]), "en", 0.5))
        if i % 5:
            labels.append((i, int(good)))
    return rows, labels


def test_scores(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (1000, None, None, None), (None, "", "en", 1.0), (5, "$$$ $$$ x$$$", "en", 1.0), (1001, "the of " * 9000, "en", 1.0)], "doc_id long, text string, lang string, score double").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (9, None), (7777, 0), (1, 0)], "doc_id long, quality int")
    got = quality.score_documents(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in judged]) > 0.97
    blank = {r.score for r in got if not r.text}
    assert len(blank) == 1
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_no_labels(spark):
    rows, _ = corpus(20)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_descent_reaches_the_optimum(seed):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(60) < 0.5, 1, -1)
    docs = [np.unique(np.concatenate([rng.integers(0, 30, 6), rng.integers(30, 40, 3) + 10 * (s > 0)])).astype(np.uint32) for s in y]
    ratio = quality.log_count_ratio(docs, y)
    w, bias = quality.descend(docs, y, ratio, 1.0, 400, seed)
    x = np.zeros((60, 1 << quality.BITS))
    for i, d in enumerate(docs):
        x[i, d] = ratio[d] / len(d) ** 0.5
    weight = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    primal = lambda v, b: 0.5 * (v @ v + b * b) + (weight * np.maximum(0, 1 - y * (x @ v + b))).sum()
    own = np.divide(w, ratio, out=np.zeros_like(w), where=ratio != 0)
    best = primal(own, bias)
    for _ in range(200):
        step = rng.normal(size=own.shape) * (np.abs(x).sum(0) > 0) * 0.01
        assert primal(own + step, bias + rng.normal() * 0.01) > best - 1e-3
