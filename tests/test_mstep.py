import numpy as np

from triptopics.operators.topics.mstep import (StationGraph, beta_from_counts, blend, graph_gradient,
                                               graph_m_step, learning_rate, mixed_graph)


def _graphs(V=6, seed=0):
    rng = np.random.default_rng(seed)
    poi = rng.random((V, 3))
    poi[2] = 0.0                                            # a station without POI
    n = np.linalg.norm(poi, axis=1, keepdims=True)
    f = np.where(n > 0, poi / np.where(n > 0, n, 1), 0)
    region = np.zeros((V, 2))
    region[np.arange(V), np.arange(V) % 2] = 1.0
    return StationGraph(V, [(1.0, f)]), StationGraph(V, [(1.0, region)]), f, region


def test_beta_from_counts_log_zero():
    b = beta_from_counts(np.array([[1.0, 0.0, 3.0]]))
    assert np.allclose(b[0, [0, 2]], np.log([0.25, 0.75])) and b[0, 1] == -100.0


def test_factored_gradient_matches_dense():
    poi, net, f, region = _graphs()
    g = mixed_graph(net, poi, 0.3)
    dense = 0.3 * (region @ region.T) + 0.7 * (f @ f.T)
    np.fill_diagonal(dense, 0.0)                            # diagonal never matters
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(6), 2)
    p0 = rng.dirichlet(np.ones(6), 2)
    ref = np.array([[0.2 * p0[z, i] / p[z, i] - 0.8 * sum(dense[i, j] * (p[z, i] - p[z, j]) for j in range(6))
                     for i in range(6)] for z in range(2)])
    assert np.allclose(graph_gradient(p, p0, 0.2, g), ref)


def test_lambda_one_keeps_p0_and_rows_normalised():
    poi, net, _, _ = _graphs()
    rng = np.random.default_rng(4)
    lp0 = np.log(rng.dirichlet(np.ones(6), 3))
    out, _ = graph_m_step(lp0, 1.0, poi)
    assert np.allclose(out, lp0)
    out, it = graph_m_step(lp0, 0.1, mixed_graph(net, poi, 0.5), g_step=0.01)
    assert it >= 1 and np.allclose(np.exp(out).sum(axis=1), 1.0)


def test_blend_and_rate():
    a = np.log(np.array([[0.5, 0.5]]))
    b = np.log(np.array([[0.9, 0.1]]))
    assert np.allclose(np.exp(blend(a, b, 0.25)), [[0.6, 0.4]])
    assert abs(learning_rate(16, 0.5, 0) - 17 ** -0.5) < 1e-15


def test_m_step_over_an_edge_table_equals_the_dense_form(spark):
    from triptopics.operators.topics.laplacian import laplacian_m_step
    from triptopics.operators.topics.mstep import StationGraph, graph_m_step

    rng = np.random.default_rng(4)
    n, topics = 9, 3
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.5), 1)
    w = w + w.T
    i, j = np.nonzero(w)
    p0 = rng.dirichlet(np.ones(n), topics)
    rows = spark.createDataFrame([(int(s), [float(v) for v in p0[:, s]]) for s in range(n)], "station int, p array<double>")
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(i, j, strict=True)] + [(50, 1, 2.0), (1, 50, 2.0), (2, 3, 0.0)],
                                  "w1 int, w2 int, weight double")
    for tol, most in ((1e-3, 200), (-1.0, 3)):
        want, steps = graph_m_step(np.log(p0), 0.3, StationGraph(n, edges=[(1.0, i, j, w[i, j])]), 0.05, tol, most)
        fit = laplacian_m_step(rows, edges, topics, 0.3, 0.05, tol, most)
        got = np.array([r.p for r in fit.p.orderBy("station").collect()]).T
        assert fit.steps == steps and fit.converged == (tol > 0) and np.allclose(got, np.exp(want))
