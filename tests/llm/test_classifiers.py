"""Classifiers learn from every labelled row that is not held out."""

import zlib

import numpy as np

from knownwhen.llm import quality
from knownwhen.llm.labelled import learnable


def long_texts(spark, n=24):
    rows = [(i, ("Plain words stand here, one after the other. " if i % 2 else "x9 | 77 || zz# ~~ 0x ") * 600) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_long_labelled_texts_are_learnt_from(spark):
    docs, labels = long_texts(spark)
    assert docs.selectExpr("min(length(text))").first()[0] > 10_000
    want = sorted(i for i in range(24) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert sorted(r["doc_id"] for r in learnable(docs, labels, "quality").collect()) == want
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert all(got[i] > 0.5 if i % 2 else got[i] < 0.5 for i in range(24))


def test_the_ranking_counts_every_labelled_row(spark):
    """Seven thousand rows of one class: what only a few of them show moves the model, and in whatever parts they come the model is the same."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((8000, 4)), (np.arange(8000) % 8 != 0).astype(int)
    x[:, 0] += y
    y[0], x[0] = 1, [0, 50, 0, 0]
    whole = quality.train(x, y)
    parts = quality.learn(lambda f: sum(f(x[i : i + 999], y[i : i + 999]) for i in reversed(range(0, 8000, 999))), 4)
    assert np.array_equal(whole.weights, parts.weights) and whole.threshold == parts.threshold
    without = quality.train(x[1:], y[1:])
    assert whole.weights[1] > without.weights[1]
    # All pairs of rows: the gradient of the loss that is minimised is nought.
    z = whole.standard(x)
    s = z @ whole.weights
    lost = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None]))
    grad = quality.DECAY * whole.weights - (lost.sum(1) @ z[y == 1] - lost.sum(0) @ z[y == 0]) / lost.size
    assert np.abs(grad).max() < 2e-3
