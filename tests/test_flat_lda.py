"""Flat LDA with β as a table against the same steps on dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triptopics.operators.topics import flat
from triptopics.operators.topics.kernel import e_step


def rows(seed, users=40, tokens=30):
    rng = np.random.default_rng(seed)
    return [(int(u), f"t{rng.integers(tokens)}", int(rng.integers(1, 5))) for u in range(users) for _ in range(12)]


def dense(data, topics, start, steps, alpha=0.1):
    words = sorted({t for _, t, _ in data})
    counts = {}
    for u, t, c in data:
        counts[u, t] = counts.get((u, t), 0) + c
    keys = sorted(counts)
    doc = np.unique([u for u, _ in keys], return_inverse=True)[1]
    word, cnt = np.array([words.index(t) for _, t in keys]), np.array([counts[k] for k in keys], float)
    beta, bounds = np.array([start[w] for w in words]).T, []
    beta = np.log(beta / beta.sum(axis=1, keepdims=True))
    zero = np.zeros(len(word), np.int64)
    for _ in range(steps):
        r = e_step(doc, word, zero, zero, cnt, beta, np.zeros((1, 1)), np.zeros((1, 1)), alpha, 21, 1e-4)
        n = np.zeros((topics, len(words)))
        np.add.at(n.T, word, r.phi_o * cnt[:, None])
        beta = np.log(n / n.sum(axis=1, keepdims=True))
        bounds.append(r.elbo.sum())
    return words, beta, bounds


@pytest.mark.parametrize("block_rows", [100_000, 60])
def test_fit_equals_dense_form(spark, monkeypatch, block_rows):
    monkeypatch.setattr(flat, "BLOCK_ROWS", block_rows)
    data = rows(1)
    frame = spark.createDataFrame(data + [(None, "t1", 2), (3, None, 2)], "user_id long, token string, cnt long")
    start = {r.token: r.n for r in frame.where("token is not null").select("token").distinct().select("token", flat.hash_start(3)(F.col("token")).alias("n")).collect()}
    model = flat.fit_flat_lda(frame.repartition(3), 3, max_iter=3, em_tol=0.0)
    words, beta, bounds = dense(data, 3, start, 3)
    got = {(r.topic, r.token): r.logp for r in model.long().collect()}
    assert len(got) == 3 * len(words)
    assert all(abs(np.exp(got[k, w]) - np.exp(beta[k, i])) < 1e-9 for i, w in enumerate(words) for k in range(3))
    assert np.allclose([b for _, b in model.history], bounds) and not model.converged


def test_fit_says_when_it_settles(spark):
    model = flat.fit_flat_lda(spark.createDataFrame(rows(2), "user_id long, token string, cnt long"), 2, max_iter=30, em_tol=0.05)
    assert model.converged and 1 < len(model.history) < 30


def test_no_words(spark):
    model = flat.fit_flat_lda(spark.createDataFrame([], "user_id long, token string, cnt long"), 2)
    assert model.long().count() == 0 and model.history == []
