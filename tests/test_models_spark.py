"""Fits on the smallest scale: probabilities normalised, inference consistent."""

import numpy as np
from pyspark.sql import functions as F

from tables import SF_SMALL
from triptopics.operators.topics.fit import TensorLDAConfig, fit_batch, fit_grid, fit_online, infer_docs
from triptopics.operators.topics.model import corpus_from_trips
from triptopics.sources.fixtures import trips

CFG = TensorLDAConfig(J=3, K=3, L=2, iter_em=3, iter_inference=5)


def test_batch_fit_and_inference(spark):
    corpus = corpus_from_trips(trips(spark, SF_SMALL))
    model = fit_batch(corpus, CFG)
    for b in model.beta:
        assert np.allclose(np.exp(b).sum(axis=1), 1.0)
    th = infer_docs(corpus.docs, model, CFG).toPandas()
    assert np.allclose(np.stack(th["theta"]).sum(axis=1), 1.0)
    n_words = corpus.docs.agg(F.sum("cnt")).first()[0]
    assert abs(th["wordcount"].sum() - n_words) < 1e-9
    assert np.allclose(np.stack(th["cz_o"]).sum(axis=1), th["wordcount"])


def test_online_fit_advances(spark):
    corpus = corpus_from_trips(trips(spark, SF_SMALL))
    model = fit_online(corpus, CFG, batch_size=4, epochs=1)
    assert model.steps >= 3
    assert np.allclose(np.exp(model.log_bt).sum(axis=1), 1.0)


def test_legacy_mode_runs_on_spark(spark):
    corpus = corpus_from_trips(trips(spark, SF_SMALL), with_last=True)
    assert corpus.docs.filter("last").select("user_id").distinct().count() == \
        corpus.docs.select("user_id").distinct().count()
    cfg = TensorLDAConfig(J=3, K=3, L=2, iter_em=2, iter_inference=3, mode="legacy")
    model = fit_batch(corpus, cfg)
    assert np.allclose(np.exp(model.log_bo).sum(axis=1), 1.0)


def test_online_variants(spark):
    corpus = corpus_from_trips(trips(spark, SF_SMALL))
    for variant in ("no_od_blend", "rho_step"):
        model = fit_online(corpus, CFG, batch_size=8, epochs=1, variant=variant)
        for b in model.beta:
            assert np.allclose(np.exp(b).sum(axis=1), 1.0)
        assert model.steps >= 2


def test_grid_equals_separate_fits_in_shared_passes(spark, monkeypatch):
    """One pass over the documents serves all λ; a model that has settled leaves the stack."""
    from triptopics.operators.topics import fit
    from triptopics.operators.topics.mstep import StationGraph

    corpus = corpus_from_trips(trips(spark, SF_SMALL))
    rng = np.random.default_rng(0)
    f = rng.random((corpus.n_stations, 3))
    graph = StationGraph(corpus.n_stations, [(1.0, f)], [])
    cfgs = [TensorLDAConfig(J=3, K=2, L=2, iter_em=n, iter_inference=4, lam=lam) for lam, n in ((0.2, 2), (0.1, 4), (1.0, 3))]
    passes, estep = [], fit.estep_stats

    def spy(docs, betas, *rest):
        passes.append(len(betas))
        return estep(docs, betas, *rest)

    monkeypatch.setattr(fit, "estep_stats", spy)
    grid = fit_grid(corpus, cfgs, graph, graph)
    assert passes[0] == 3 and passes == sorted(passes, reverse=True) and len(passes) == max(m.steps for m in grid)
    for cfg, model in zip(cfgs, grid, strict=True):
        alone = fit_batch(corpus, cfg, graph, graph)
        assert alone.steps == model.steps
        assert all(np.allclose(a, b) for a, b in zip(alone.beta, model.beta, strict=True))
        names = {h["name"] for h in model.history}
        assert names == {"elbo", "graph_steps_o", "graph_steps_d", "graph_settled"}
