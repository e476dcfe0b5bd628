import numpy as np
import pandas as pd
import pytest

from triptopics.operators import tucker as tk
from triptopics.operators.infer import destination_scores


def test_destination_scores_brute_force():
    rng = np.random.default_rng(0)
    J, K, L, V, T = 2, 3, 2, 5, 4
    lo, ld, lt = (np.log(rng.dirichlet(np.ones(V), J)), np.log(rng.dirichlet(np.ones(V), K)),
                  np.log(rng.dirichlet(np.ones(T), L)))
    th = rng.dirichlet(np.ones(J * K * L), 3)
    o, t = np.array([0, 3, 4]), np.array([1, 0, 3])
    got = destination_scores(th, o, t, lo, ld, lt)
    for n in range(3):
        tn = th[n].reshape(J, K, L)
        ref = np.array([sum(np.exp(lo[j, o[n]] + ld[k, d] + lt[l, t[n]]) * tn[j, k, l]
                            for j in range(J) for k in range(K) for l in range(L)) for d in range(V)])
        assert np.allclose(got[n], ref / ref.sum())


def low_rank(shape, ranks, seed, keep=1.0):
    rng = np.random.default_rng(seed)
    x = rng.random(ranks)
    for n, (size, rank) in enumerate(zip(shape, ranks, strict=True)):
        x = np.moveaxis(np.tensordot(rng.random((size, rank)), x, axes=([1], [n])), 0, n)
    return np.where(x >= np.quantile(x, 1 - keep), x, 0.0)


def coo_of(spark, x, names):
    at = np.nonzero(x)
    return spark.createDataFrame(pd.DataFrame({**{c: i for c, i in zip(names, at, strict=True)}, "value": x[at]})).repartition(3)


def full(core, factors):
    return tk._core_times(core, factors)


def plain_iteration(x, core, factors, order):
    """Dense updates of the modes in ``order``, one after the other, then the core."""
    factors, n = list(factors), x.ndim
    for m in order:
        rest = [f if k != m else np.eye(core.shape[m]) for k, f in enumerate(factors)]
        b = np.moveaxis(full(core, rest), m, 0).reshape(core.shape[m], -1)
        xm = np.moveaxis(x, m, 0).reshape(x.shape[m], -1)
        factors[m] = factors[m] * (xm @ b.T) / np.maximum(factors[m] @ (b @ b.T), 1e-12)
    num = full(x, [f.T for f in factors])
    den = full(core, [f.T @ f for f in factors])
    return core * num / np.maximum(den, 1e-12), factors


@pytest.mark.parametrize("small", [(2, 3), (3,), (0, 2)])
def test_one_iteration_equals_dense_updates(spark, small):
    shape, ranks = (6, 5, 4, 3), (2, 3, 2, 2)
    x = low_rank(shape, ranks, 1, 0.4)
    rng = np.random.default_rng(2)
    start = (rng.random(ranks) + 0.1, [rng.random((s, r)) + 0.1 for s, r in zip(shape, ranks, strict=True)])
    names = ["i0", "i1", "i2", "i3"]
    m = tk.non_negative_tucker(coo_of(spark, x, names), names, shape, ranks, 1, small=small, start=start)
    core, factors = plain_iteration(x, *start, [k for k in range(4) if k not in small] + list(small))
    assert np.allclose(m.core, core) and all(np.allclose(a, b) for a, b in zip(m.factors, factors, strict=True))
    assert abs(m.history[0][1] - np.linalg.norm(x - full(core, factors)) / np.linalg.norm(x)) < 1e-9


def test_error_never_rises_and_the_fit_settles(spark):
    shape, ranks = (8, 7, 5), (2, 2, 2)
    x = low_rank(shape, ranks, 3)
    names = ["i0", "i1", "i2"]
    coo = coo_of(spark, x, names)
    m = tk.non_negative_tucker(coo, names, shape, ranks, 60, tol=1e-3)
    errs = [e for _, e in m.history]
    assert all(b <= a + 1e-9 for a, b in zip(errs[:-1], errs[1:], strict=True)) and errs[-1] < 0.1
    assert m.converged and len(errs) < 60 and abs(errs[-1] - np.linalg.norm(x - full(m.core, m.factors)) / np.linalg.norm(x)) < 1e-6
    again = tk.non_negative_tucker(coo.repartition(1), names, shape, ranks, len(errs), tol=1e-3)
    assert np.allclose([e for _, e in again.history], errs)                  # the start is deterministic
    res = tk.residuals(coo, names, m).toPandas().sort_values(names)
    assert np.allclose(res["x_hat"].to_numpy(), full(m.core, m.factors)[x > 0])
    assert not tk.non_negative_tucker(coo, names, shape, ranks, 2, tol=0.0).converged


def test_user_mode_equals_dense_error(spark):
    shape, ranks = (30, 6, 5, 3), (3, 2, 2, 2)
    x = low_rank(shape, ranks, 5, 0.5)
    coo = coo_of(spark, x, ["u", "i1", "i2", "i3"]).selectExpr("u + 1000 AS user_id", "i1", "i2", "i3", "value")
    users, m = tk.non_negative_tucker_users(coo, ["i1", "i2", "i3"], shape, ranks, 5, tol=0.0)
    up = users.toPandas()
    u = np.zeros((shape[0], ranks[0]))
    u[up["user_id"].to_numpy() - 1000] = np.stack(up["u"].to_numpy())
    dense = np.linalg.norm(x - full(m.core, [u, *m.factors[1:]])) / np.linalg.norm(x)
    errs = [e for _, e in m.history]
    assert abs(errs[-1] - dense) < 1e-9 and dense < 0.5 and len(up) == len(set(up["user_id"]))
    assert all(b <= a + 1e-9 for a, b in zip(errs[:-1], errs[1:], strict=True))


def test_no_cells(spark):
    coo = spark.createDataFrame([], "i0 int, i1 int, i2 int, value double")
    m = tk.non_negative_tucker(coo, ["i0", "i1", "i2"], (3, 3, 2), (2, 2, 2), 3)
    assert m.history[0][1] == 0.0


@pytest.mark.parametrize("keep", [0.05, 1.0])
def test_a_task_multiplies_fibres_as_blocks(keep, monkeypatch):
    """A task gives one row an entry of the Gram matrix, however many pairs of cells its fibres hold."""
    monkeypatch.setattr(tk, "GRAM_BLOCK", 40)
    x = np.random.default_rng(4).integers(1, 9, (9, 300)) * (np.random.default_rng(5).random((9, 300)) < keep)
    fibre, i = np.nonzero(x.T)
    cells = pd.DataFrame({"fibre": fibre, "i": i, "x": x.T[fibre, i].astype(float)})
    out = list(tk._fibre_products(9)(iter([cells[:500], cells[500:]])))
    got = np.zeros(81)
    got[out[0]["k"]] = out[0]["x"]
    assert len(out) == 1 and np.array_equal(got.reshape(9, 9), x @ x.T)


def test_the_start_is_made_once(spark, monkeypatch):
    shape, ranks = (8, 7, 5), (2, 2, 2)
    x = np.round(10 * low_rank(shape, ranks, 3, 0.6))
    calls = []
    gram = tk._gram
    monkeypatch.setattr(tk, "_gram", lambda data, mode, *rest: calls.append(mode) or gram(data, mode, *rest))
    m = tk.non_negative_tucker(coo_of(spark, x, ["i0", "i1", "i2"]), ["i0", "i1", "i2"], shape, ranks, 1)
    assert calls == ["i0", "i1", "i2"] and m.history
    joined = tk.gram_start(coo_of(spark, x, ["i0", "i1", "i2"]).withColumnRenamed("value", "x"), ["i0", "i1", "i2"], shape, ranks)
    monkeypatch.setattr(tk, "GRAM_LOCAL", 0)
    assert all(np.array_equal(a, b) for a, b in zip(joined, tk.gram_start(
        coo_of(spark, x, ["i0", "i1", "i2"]).withColumnRenamed("value", "x"), ["i0", "i1", "i2"], shape, ranks), strict=True))


@pytest.mark.parametrize("lead", [1, 3])
def test_tables_of_few_cells_equal_sums_by_cell(lead):
    rng = np.random.default_rng(6)
    sizes, ranks, n = (5, 4), (3, 2), 400
    idx, cell, value = [rng.integers(0, s, n) for s in sizes], rng.integers(0, 6, n), rng.random((n, lead))
    large, table = [rng.random((s, r)) for s, r in zip(sizes, ranks, strict=True)], rng.random((6, lead, *ranks))
    order = np.argsort(cell, kind="stable")
    for z in (slice(None), order):      # many cells in turn, and few
        got = [tk.big_rows(table, large, m, [i[z] for i in idx], cell[z], value[z]) for m in (0, 1)]
        assert np.allclose(got[0], np.einsum("zl,zlab,zb->za", value, table[cell], large[1][idx[1]])[z])
        assert np.allclose(got[1], np.einsum("zl,zlab,za->zb", value, table[cell], large[0][idx[0]])[z])
    assert tk._in_few_cells(cell[order], 5) and not tk._in_few_cells(cell, 5)
