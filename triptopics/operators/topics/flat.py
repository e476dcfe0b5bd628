"""Variational flat LDA over any vocabulary (O-04): β is a table by token and never whole on one machine.

Documents are dealt to blocks of whole travellers once.  An EM step joins β, by token, to the list of
(block, token) that says which block holds which token, so a block receives exactly the columns of its
own tokens; the E-step runs over the block (the tensor kernel with one destination and one time topic),
and the expected counts, summed by block and token, are grouped by token into the next β.  Only the
topics' totals (one number a topic) and the bound come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import ensure_checkpoint_dir
from .kernel import e_step

BLOCK_ROWS = 100_000
LOG_ZERO = -100.0
STATS = "token string, n array<double>, elbo double"


@dataclass
class FlatLDA:
    beta: DataFrame                      # token, logp: array of log p(token | topic) by topic
    history: list[tuple[int, float]] = field(default_factory=list)
    converged: bool = False

    def long(self) -> DataFrame:
        """topic, token, logp."""
        return self.beta.select(F.posexplode("logp").alias("topic", "logp"), "token").select("topic", "token", "logp")


def hash_start(topics: int) -> Callable[[Column], Column]:
    """Start counts of a token: between 1 and 2, by hashes of the token and the topic."""
    return lambda token: F.array(*[F.pmod(F.xxhash64(token, F.lit(k)), F.lit(1000)) / 1000.0 + 1.0 for k in range(topics)])


def _normalised(counts: DataFrame, topics: int) -> DataFrame:
    """token, logp from token, n (counts by topic): each topic's log shares; zero counts become ``LOG_ZERO``."""
    totals = counts.agg(*[F.sum(F.col("n")[k]) for k in range(topics)]).first()
    shares = [F.when((F.col("n")[k] > 0) & F.lit(bool(totals[k])), F.log(F.col("n")[k] / F.lit(float(totals[k] or 1.0)))).otherwise(F.lit(LOG_ZERO))
              for k in range(topics)]
    return counts.select("token", F.array(*shares).alias("logp"))


def _estep(topics: int, alpha: float, sweeps: int, tol: float):
    """(documents, needed columns of β) of one block to its expected counts by token; the first row carries the bound."""
    def run(docs: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"token": [], "n": [], "elbo": []})
        docs = docs.sort_values("user_id", kind="stable")
        word = pd.Index(needed["token"]).get_indexer(docs["token"])
        log_beta = np.stack(needed["logp"].to_numpy()).T
        users = docs["user_id"].to_numpy()
        doc = np.cumsum(np.append(0, users[1:] != users[:-1]))
        zero, cnt = np.zeros(len(docs), np.int64), docs["cnt"].to_numpy(np.float64)
        r = e_step(doc, word, zero, zero, cnt, log_beta, np.zeros((1, 1)), np.zeros((1, 1)), alpha, sweeps, tol)
        total = np.zeros((len(needed), topics))
        np.add.at(total, word, r.phi_o * cnt[:, None])
        return pd.DataFrame({"token": needed["token"], "n": list(total), "elbo": np.append(r.elbo.sum(), np.zeros(len(needed) - 1))})
    return run


def fit_flat_lda(tokens: DataFrame, topics: int, alpha: float = 0.1, max_iter: int = 11, em_tol: float = 1e-3, sweeps: int = 21,
                 var_tol: float = 1e-4, start: Callable[[Column], Column] | None = None) -> FlatLDA:
    """EM over ``tokens`` (user_id, token, cnt) until the bound changes by less than ``em_tol`` of it.

    Rows without a traveller or token are left out; without any row β is empty and nothing is learnt."""
    spark = tokens.sparkSession
    ensure_checkpoint_dir(spark)
    rows = tokens.where("user_id IS NOT NULL AND token IS NOT NULL").groupBy("user_id", "token").agg(F.sum("cnt").cast("double").alias("cnt")).checkpoint()
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    docs = rows.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
    needed = docs.select("block", "token").distinct().checkpoint()
    vocabulary = needed.select("token").distinct()
    model = FlatLDA(_normalised(vocabulary.select("token", (start or hash_start(topics))(F.col("token")).alias("n")), topics).checkpoint())
    step = _estep(topics, alpha, sweeps, var_tol)
    for i in range(max_iter):
        columns = needed.join(model.beta, "token").select(*[F.col(c).alias(c) for c in ("block", "token", "logp")])
        stats = docs.groupBy("block").cogroup(columns.groupBy("block")).applyInPandas(step, STATS)
        counts = stats.groupBy("token").agg(F.array(*[F.sum(F.col("n")[k]) for k in range(topics)]).alias("n"), F.sum("elbo").alias("elbo")).checkpoint()
        bound = counts.agg(F.sum("elbo")).first()[0]
        if bound is None:
            break
        model.beta = _normalised(counts, topics).checkpoint()
        model.history.append((i, float(bound)))
        if i and abs(model.history[-1][1] - model.history[-2][1]) <= em_tol * abs(model.history[-2][1]):
            model.converged = True
            break
    docs.unpersist()
    return model
