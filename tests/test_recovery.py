"""Topic recovery: documents drawn from a known model, fitted on Spark."""

import numpy as np
import pandas as pd

from triptopics.operators.topics.fit import TensorLDAConfig, fit_batch, infer_docs, init_model
from triptopics.operators.topics.model import Corpus


def _draw(rng, beta_o, beta_d, beta_t, n_docs, n_words, conc):
    J, K, L = beta_o.shape[0], beta_d.shape[0], beta_t.shape[0]
    rows = []
    for u in range(n_docs):
        theta = rng.dirichlet(np.full(J * K * L, conc))
        cells = rng.choice(J * K * L, size=n_words, p=theta)
        for c in cells:
            j, k, l = c // (K * L), (c // L) % K, c % L
            rows.append((u, rng.choice(beta_o.shape[1], p=beta_o[j]), rng.choice(beta_d.shape[1], p=beta_d[k]),
                         rng.choice(beta_t.shape[1], p=beta_t[l])))
    df = pd.DataFrame(rows, columns=["user_id", "o", "d", "t"])
    return df.groupby(["user_id", "o", "d", "t"]).size().rename("cnt").reset_index()


def _sep(n_topics, n_words, rng):
    """Well separated topics: each puts most mass on its own block of words."""
    b = np.full((n_topics, n_words), 0.02 / n_words)
    block = n_words // n_topics
    for z in range(n_topics):
        b[z, z * block:(z + 1) * block] += rng.dirichlet(np.ones(block)) * 0.98
    return b / b.sum(axis=1, keepdims=True)


def test_recovers_known_topics_and_beats_random_model(spark):
    rng = np.random.default_rng(11)
    bo, bd, bt = _sep(2, 12, rng), _sep(2, 12, rng), _sep(2, 8, rng)
    train = _draw(rng, bo, bd, bt, 120, 40, 0.1)
    test = _draw(rng, bo, bd, bt, 40, 40, 0.1)
    cfg = TensorLDAConfig(J=2, K=2, L=2, alpha=0.1, iter_em=15, iter_inference=20, lam=1.0, seed=3)
    corpus = Corpus(spark.createDataFrame(train).repartition(4), np.arange(12), np.arange(8))
    model = fit_batch(corpus, cfg)
    for learned, true in ((model.log_bo, bo), (model.log_bd, bd), (model.log_bt, bt)):
        p = np.exp(learned)
        sim = (p @ true.T) / np.outer(np.linalg.norm(p, axis=1), np.linalg.norm(true, axis=1))
        assert sim.max(axis=1).min() > 0.9                 # every learned topic matches a true one
        assert len(set(sim.argmax(axis=1))) == true.shape[0]
    test_df = spark.createDataFrame(test)
    fitted = infer_docs(test_df, model, cfg).toPandas()["elbo"].sum()
    random = infer_docs(test_df, init_model(corpus, cfg), cfg).toPandas()["elbo"].sum()
    assert fitted > random
