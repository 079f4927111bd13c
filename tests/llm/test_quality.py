import random

import numpy as np
import pytest
from helpers import awkward, crc, documents, words

from tidemark.llm import quality, queries

DATA = "/root/testdata/sf0.01"


def test_query_ranks_held_out_rows(spark):
    got = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, DATA).collect()}
    assert len(got) == 1000 and all(r["held_out"] == (crc(i) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    known = [(r["quality"], got[r["doc_id"]]["score"]) for r in queries.table(spark, DATA, "labels").collect() if crc(r["doc_id"]) % 3 == 1]
    good, bad = ([s for q, s in known if q == x] for x in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.5 for g in good]) > 0.95


def test_awkward_rows_and_labels(spark):
    rng = random.Random(4)
    good = [(100 + i, " ".join(words(rng, 60)) + ".") for i in range(40)]
    bad = [(200 + i, "BUY!! " * 30) for i in range(40)]
    docs = documents(spark, [*awkward(), *good, *bad])
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (1, None, 0), (100, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model).collect()}
    assert all(got[i] == 1 for i, _ in good) and all(got[i] == 0 for i, _ in bad)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {i for i, _ in good} <= {r["doc_id"] for r in kept.collect()}
    assert quality.score(docs, model).count() == docs.count()
    again = quality.fit(docs.repartition(5), labels)
    assert np.allclose(again.weights, model.weights)


def test_one_label_or_none(spark):
    docs = documents(spark, [(1, "a b"), (2, "c")])
    for rows, side in (([(1, 1)], 1), ([(1, 0)], 0), ([], 1)):
        model = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert [r["predicted"] for r in quality.score(docs, model).collect()] == [side, side]
    assert quality.score(docs.limit(0), model).count() == 0


def test_strength_learns_the_order():
    x = quality.features(b"The cat sat. It was well.")
    assert len(x) == len(quality.NAMES) and all(np.isfinite(quality.features(b"")))


def test_fit_and_scores_match_plain_ranking(spark):
    """Gradient descent on the mean logistic loss of preference pairs, and scores by the formula, row by row."""
    rng = random.Random(9)
    texts = [(i, " ".join(words(rng, rng.randrange(5, 80))) + ("!! BUY" * rng.randrange(4) if i % 2 else ". ")) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i % 7 == 0)) for i, _ in texts], "doc_id long, quality int")
    model = quality.fit(documents(spark, texts), labels, pairs=300)
    x = np.array([quality.features(t.encode()) for _, t in texts])
    y = np.array([int(i % 2 == 0 or i % 7 == 0) for i, _ in texts])
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6)
    draw = np.random.default_rng(7)
    pairs = list(zip(draw.choice(np.flatnonzero(y == 1), 300), draw.choice(np.flatnonzero(y != 1), 300), strict=True))
    d, w = np.array([z[a] - z[b] for a, b in pairs]), np.zeros(z.shape[1])
    for _ in range(60_000):
        grad = 1e-3 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(axis=0)
        w -= 0.02 * grad
    loss = lambda v: np.log1p(np.exp(-(d @ v))).mean() + 5e-4 * v @ v
    assert loss(model.weights) <= loss(w) + 1e-6 and loss(w) < loss(model.weights) + 1e-3
    strengths = z @ model.weights
    errors = min(((strengths >= t) != (y == 1)).sum() for t in np.quantile(strengths, np.linspace(0, 1, 121)))
    assert ((strengths >= model.threshold) != (y == 1)).sum() == errors
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(documents(spark, texts), model).collect()}
    for i, t in texts:
        own = np.clip((np.array(quality.features(t.encode())) - model.mean) / model.scale, -6, 6)
        s = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(own, model.weights, strict=True)) - model.threshold)))
        assert got[i][0] == pytest.approx(s) and got[i][1] == (got[i][0] >= 0.5)
