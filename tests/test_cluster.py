"""Golden values computed independently and brute-force checks."""

import numpy as np
import pandas as pd

from triptopics.operators import cluster as cl

DEMO = [[0, 0, 1], [1, 1, 1], [2, 1, 1], [0, 2, 0], [2, 1, 0]]


def _cu(ds, labels, m):
    ds = np.asarray(ds)
    n = len(ds)
    if len(set(labels)) < m:
        return 0.0
    un = sum((np.sum(ds[:, a] == v) / n) ** 2 for a in range(ds.shape[1]) for v in set(ds[:, a]))
    right = 0.0
    for k in range(m):
        mem = ds[np.asarray(labels) == k]
        cond = sum((np.sum(mem[:, a] == v) / len(mem)) ** 2 for a in range(ds.shape[1]) for v in set(ds[:, a]))
        right += len(mem) / n * (cond - un)
    return right / m


def _sequential(ds, m):
    """The greedy one-item-at-a-time pass (brute force; tiny inputs only)."""
    labels = list(range(m))
    for i in range(m, len(ds)):
        cus = [_cu(ds[: i + 1], labels + [k], m) for k in range(m)]
        labels.append(int(np.argmax(cus)))
    return labels


def test_golden_sequential_and_cu():
    labels = _sequential(DEMO, 2)
    assert labels == [0, 1, 1, 0, 1]
    assert abs(_cu(DEMO, labels, 2) - 0.3733) < 1e-4


def test_spark_category_utility_matches(spark):
    pdf = pd.DataFrame(DEMO, columns=["a", "b", "c"]).assign(cluster=[0, 1, 1, 0, 1])
    got = cl.category_utility(spark.createDataFrame(pdf), "cluster", ["a", "b", "c"], 2).first()[0]
    assert abs(got - _cu(DEMO, [0, 1, 1, 0, 1], 2)) < 1e-12


def test_categorical_clusters_demo(spark):
    pdf = pd.DataFrame(DEMO, columns=["a", "b", "c"]).assign(id=range(5))
    out = cl.categorical_clusters(spark.createDataFrame(pdf), "id", ["a", "b", "c"], 2).toPandas()
    labels = out.sort_values("id")["cluster"].tolist()
    assert labels[:2] == [0, 1]
    assert _cu(DEMO, labels, 2) >= _cu(DEMO, [0, 1, 1, 0, 1], 2) - 1e-9


def test_js_golden(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5])], "p array<double>, q array<double>")
    got = df.select(cl.js_distance("p", "q")).first()[0]
    assert abs(got - 0.464501404) < 1e-9
    same = df.select(cl.js_distance("p", "p"), cl.js_distance("q", "p")).first()
    assert abs(same[0]) < 1e-12 and abs(same[1] - got) < 1e-12


def test_own_cluster_is_taken_out_before_moves_are_compared():
    rng = np.random.default_rng(3)
    ds = rng.integers(0, 3, (60, 3))
    labels = np.r_[np.arange(4), rng.integers(0, 4, 56)]
    kv = np.zeros((4, 3, 3))
    for a in range(3):
        np.add.at(kv[:, a, :], (labels, ds[:, a]), 1)
    U = sum((np.sum(ds[:, a] == v) / 60) ** 2 for a in range(3) for v in range(3))
    got = cl.assign_by_utility(ds, kv, np.bincount(labels, minlength=4), U, labels)
    for i in range(60):
        cus = [_cu(ds, [*labels[:i], k, *labels[i + 1:]], 4) for k in range(4)]
        assert cus[got[i]] >= max(cus) - 1e-12
        assert got[i] == labels[i] or cus[got[i]] > cus[labels[i]]


def test_rounds_settle_where_no_single_move_helps(spark):
    rng = np.random.default_rng(5)
    ds = np.concatenate([rng.integers(0, 2, (30, 3)), 2 + rng.integers(0, 2, (30, 3)), rng.integers(0, 4, (20, 3))])
    ds = ds[rng.permutation(80)]
    pdf = pd.DataFrame(ds, columns=["a", "b", "c"]).assign(id=range(80))
    out = cl.categorical_clusters(spark.createDataFrame(pdf), "id", ["a", "b", "c"], 3).toPandas().sort_values("id")
    labels = out["cluster"].tolist()
    assert out["converged"].all() and labels[:3] == [0, 1, 2]
    now = _cu(ds, labels, 3)
    for i in range(3, 80):
        assert all(_cu(ds, [*labels[:i], k, *labels[i + 1:]], 3) <= now + 1e-12 for k in range(3))
