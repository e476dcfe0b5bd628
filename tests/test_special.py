import math

import numpy as np
from pyspark.sql import functions as F

from triptopics.functions.special import digamma, digamma_col, gammaln, gammaln_col


def test_digamma_identities():
    x = np.array([0.01, 0.3, 1.0, 2.5, 7.9, 8.0, 40.0, 1e5])
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12
    assert np.max(np.abs(digamma(x + 1) - digamma(x) - 1 / x)) < 1e-10


def test_gammaln_matches_math():
    x = np.array([0.01, 0.5, 1.0, 2.5, 7.9, 8.0, 30.0, 1e4])
    ref = np.array([math.lgamma(v) for v in x])
    assert np.max(np.abs(gammaln(x) - ref)) < 1e-9


def test_columns_equal_numpy(spark):
    x = [1e-3, 0.01, 0.3, 1.0, 2.5, 7.9, 8.0, 40.0, 1e5, 1e9]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", digamma_col(F.col("x")).alias("d"), gammaln_col(F.col("x")).alias("g")).collect()
    for r in got:
        assert abs(r.d - digamma(np.array([r.x]))[0]) < 1e-10 * max(1, abs(r.d))
        assert abs(r.g - math.lgamma(r.x)) < 1e-9 * max(1.0, abs(r.g))


def test_native_bound_equals_the_kernel(spark):
    """Several sweeps from a random model, not only the one that SQL can state."""
    from triptopics.operators.topics.elbo import elbo
    from triptopics.operators.topics.estep import estep_docs, estep_phi

    rng = np.random.default_rng(0)
    rows = [(int(u), int(rng.integers(6)), int(rng.integers(6)), int(rng.integers(5)), int(rng.integers(1, 4))) for u in range(12) for _ in range(8)]
    docs = spark.createDataFrame(rows, "user_id long, o int, d int, t int, cnt int").groupBy("user_id", "o", "d", "t").agg(F.sum("cnt").alias("cnt"))
    docs = docs.repartition(2, "user_id").sortWithinPartitions("user_id").cache()
    beta = [np.log(rng.dirichlet(np.ones(v), k)) for k, v in ((3, 6), (2, 6), (2, 5))]
    theta = estep_docs(docs, beta, 0.7, 6, 1e-9)
    got = {r.user_id: r.elbo for r in elbo(theta, estep_phi(docs, beta, 0.7, 6, 1e-9), beta, 0.7).collect()}
    want = {r.user_id: r.elbo for r in theta.collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-8 * abs(want[u]) for u in want)
