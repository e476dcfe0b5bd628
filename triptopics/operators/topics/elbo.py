"""The variational bound of each document in DataFrame functions (O-06).

ELBO(u) = E[log p(θ)] + E[log p(z | θ)] + Σ_w c_w Σ_dim Σ_z φ_z log β_z,w
          − E[log q(θ)] − Σ_w c_w Σ_dim Σ_z φ_z log φ_z

The Dirichlet parts are sums over the J·K·L cells of γ = α + n θ, the word parts sums over the document's
distinct triples.  β travels as one array column of log weights per word (the model's vocabulary, which
bounds the broadcast); everything else is higher-order functions and one grouped sum by traveller.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.indexing import guarded_broadcast
from ...functions.special import digamma_col, gammaln_col


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _word_weights(spark, log_beta: np.ndarray, word: str) -> DataFrame:
    rows = [(i, [float(v) for v in column]) for i, column in enumerate(log_beta.T)]
    return guarded_broadcast(spark.createDataFrame(rows, f"{word} int, b_{word} array<double>"), len(rows))


def _word_bound(phi: Column, log_beta: Column) -> Column:
    """Σ_z φ_z (log β_z − log φ_z), with 0 log 0 = 0."""
    return _total(F.zip_with(phi, log_beta, lambda p, b: F.when(p > 0, p * (b - F.log(p))).otherwise(F.lit(0.0))))


def cell_bound(theta: Column, wordcount: Column, alpha: float) -> Column:
    """The Dirichlet parts from the mixture θ over the cells and the number of words."""
    gamma = F.transform(theta, lambda x: x * wordcount + alpha)
    n = F.size(theta)
    total = _total(gamma)
    log_mean = lambda g: digamma_col(g) - digamma_col(total)
    cells = _total(F.transform(gamma, lambda g: gammaln_col(g) + ((alpha - 1.0) - (g - 1.0) + (g - alpha)) * log_mean(g)))
    return gammaln_col(n * alpha) - n * gammaln_col(F.lit(alpha)) - gammaln_col(total) + cells


def elbo(theta: DataFrame, phi: DataFrame, log_beta: tuple[np.ndarray, np.ndarray, np.ndarray], alpha: float) -> DataFrame:
    """user_id, wordcount, elbo from ``estep_docs`` (user_id, wordcount, theta) and ``estep_phi`` rows."""
    words = phi
    for name, b in zip(("o", "d", "t"), log_beta, strict=True):
        words = words.join(_word_weights(phi.sparkSession, b, name), name)
    per_triple = F.col("cnt") * sum((_word_bound(F.col(f"phi_{c}"), F.col(f"b_{c}")) for c in ("d", "t")), _word_bound(F.col("phi_o"), F.col("b_o")))
    fit = words.groupBy("user_id").agg(F.sum(per_triple).alias("word_part"))
    return theta.select("user_id", "wordcount", cell_bound(F.col("theta"), F.col("wordcount"), alpha).alias("cell_part")).join(fit, "user_id").select(
        "user_id", "wordcount", (F.col("cell_part") + F.col("word_part")).alias("elbo"))
