"""Spark side of the E-step: ``mapInPandas`` over user-sorted partitions.

The documents table ``(user_id, o, d, t, cnt)`` (word ids, one row per
distinct triple) is hash-partitioned by user and sorted inside each
partition once, then cached; each E-step streams the Arrow batches of a
partition through the NumPy kernel, cutting blocks at user boundaries
(a user that straddles two batches is carried over).  β travels inside
the task closure (model-sized: topics × vocabulary).

Two outputs:

* ``estep_stats``: per task, the topic-word sufficient statistics already
  summed over the task's documents plus the ELBO total, so the shuffle
  carries at most (J+K)·V + L·T rows per task;
* ``estep_docs``: per document γ-derived mixture θ (J·K·L, j-major),
  per-dimension topic counts, ELBO and sweeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import doc_topic_counts, e_step, topic_word_stats

DOC_COLUMNS = ["user_id", "o", "d", "t", "cnt"]
BLOCK_ROWS = 20_000

STATS_SCHEMA = "model int, dim int, topic int, word int, value double"
DOCS_SCHEMA = ("user_id bigint, wordcount double, elbo double, sweeps int, theta array<double>, "
               "cz_o array<double>, cz_d array<double>, cz_t array<double>")


def prepare_docs(doc_ids: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """Partition by user and sort within partitions (call once, then cache).

    A ``last`` column (triple of the user's last trip, for the legacy
    update) is kept when present."""
    n = n_partitions or int(doc_ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = DOC_COLUMNS + (["last"] if "last" in doc_ids.columns else [])
    return doc_ids.select(*cols).repartition(n, "user_id").sortWithinPartitions("user_id")


def user_blocks(batches: Iterator[pd.DataFrame], min_rows: int = BLOCK_ROWS, key: str = "user_id") -> Iterator[pd.DataFrame]:
    """Regroup sorted batches into blocks that hold whole users (or groups of another ``key``) only."""
    pending = None
    for pdf in batches:
        if pending is not None and len(pending):
            pdf = pd.concat([pending, pdf], ignore_index=True)
        if not len(pdf):
            continue
        users = pdf[key].to_numpy()
        cut = int(np.searchsorted(users, users[-1], side="left")) if users[0] != users[-1] else 0
        if cut >= min_rows:
            yield pdf.iloc[:cut]
            pending = pdf.iloc[cut:]
        else:
            pending = pdf
    if pending is not None and len(pending):
        yield pending


def _run(pdf: pd.DataFrame, beta, alpha, max_sweeps, var_tol, mode="aligned"):
    lo, ld, lt = beta
    users = pdf["user_id"].to_numpy()
    doc = np.r_[0, np.cumsum(users[1:] != users[:-1])]
    o = pdf["o"].to_numpy(np.int64)
    d = pdf["d"].to_numpy(np.int64)
    t = pdf["t"].to_numpy(np.int64)
    cnt = pdf["cnt"].to_numpy(np.float64)
    last = pdf["last"].to_numpy(bool) if "last" in pdf.columns else None
    if mode == "legacy" and last is None:
        raise ValueError("legacy E-step needs the 'last' flag (corpus_from_trips(..., with_last=True))")
    res = e_step(doc, o, d, t, cnt, lo, ld, lt, alpha, max_sweeps, var_tol, mode=mode, last=last)
    return users, doc, o, d, t, cnt, res


def estep_stats(docs: DataFrame, betas, alpha: float, max_sweeps: int, var_tol: float, mode: str = "aligned") -> DataFrame:
    """Topic-word statistics (dim 0/1/2 = O/D/T) and ELBO (dim -1) per task, of one or several models.

    ``betas`` is one model's (log β_O, log β_D, log β_T) or a list of them: a task reads its documents once
    and takes every block through all models."""
    stack = betas if isinstance(betas, list) else [betas]

    def fn(batches):
        totals = [[np.zeros(m.shape) for m in beta] for beta in stack]
        bound = np.zeros((len(stack), 2))
        for block in user_blocks(batches):
            for k, beta in enumerate(stack):
                _, _, o, d, t, cnt, r = _run(block, beta, alpha, max_sweeps, var_tol, mode)
                for total, word, phi in zip(totals[k], (o, d, t), (r.phi_o, r.phi_d, r.phi_t), strict=True):
                    total += topic_word_stats(word, phi, cnt, total.shape[1])
                bound[k] += float(r.elbo.sum()), r.elbo.size
        for k, mats in enumerate(totals):
            rows = []
            for dim, m in enumerate(mats):
                z, w = np.nonzero(m)
                rows.append(pd.DataFrame({"dim": dim, "topic": z, "word": w, "value": m[z, w]}))
            rows.append(pd.DataFrame({"dim": [-1, -1], "topic": [0, 1], "word": [0, 0], "value": bound[k]}))
            yield pd.concat(rows, ignore_index=True).assign(model=k)

    return docs.mapInPandas(fn, STATS_SCHEMA)


def collect_stats(stats: DataFrame, shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Reduce one model's per-task statistics (model-sized) and bring them to the driver."""
    return collect_stacked(stats, [shapes])[0]


def collect_stacked(stats: DataFrame, shapes: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float, int]]:
    """Reduce the per-task statistics of all models: one grouped sum, model-sized rows."""
    rows = stats.groupBy("model", "dim", "topic", "word").agg(F.sum("value").alias("value")).toPandas()
    out = []
    for k, own in enumerate(shapes):
        mine = rows[rows["model"] == k]
        mats = [np.zeros(shape) for shape in own]
        for dim in (0, 1, 2):
            r = mine[mine["dim"] == dim]
            mats[dim][r["topic"].to_numpy(), r["word"].to_numpy()] = r["value"].to_numpy()
        e = mine[mine["dim"] == -1].set_index("topic")["value"]
        out.append((*mats, float(e.get(0, 0.0)), int(e.get(1, 0))))
    return out


def estep_docs(docs: DataFrame, beta, alpha: float, max_sweeps: int, var_tol: float,
               mode: str = "aligned") -> DataFrame:
    """Per-document results with β fixed (also the unseen-document inference, O-12)."""

    def fn(batches):
        for block in user_blocks(batches):
            users, doc, o, d, t, cnt, r = _run(block, beta, alpha, max_sweeps, var_tol, mode)
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            n_docs = starts.size
            mix = (r.gamma - alpha).reshape(n_docs, -1)
            mix = mix / mix.sum(axis=1, keepdims=True)
            co = doc_topic_counts(starts, r.phi_o, cnt)
            cd = doc_topic_counts(starts, r.phi_d, cnt)
            ct = doc_topic_counts(starts, r.phi_t, cnt)
            yield pd.DataFrame({
                "user_id": users[starts].astype(np.int64),
                "wordcount": np.add.reduceat(cnt, starts),
                "elbo": r.elbo, "sweeps": r.sweeps.astype(np.int32),
                "theta": list(mix), "cz_o": list(co), "cz_d": list(cd), "cz_t": list(ct)})

    return docs.mapInPandas(fn, DOCS_SCHEMA)


PHI_SCHEMA = "user_id bigint, o int, d int, t int, cnt double, phi_o array<double>, phi_d array<double>, phi_t array<double>"


def estep_phi(docs: DataFrame, beta, alpha: float, max_sweeps: int, var_tol: float, mode: str = "aligned") -> DataFrame:
    """Per distinct triple the variational distributions over origin, destination and time topics."""

    def fn(batches):
        for block in user_blocks(batches):
            users, _, o, d, t, cnt, r = _run(block, beta, alpha, max_sweeps, var_tol, mode)
            yield pd.DataFrame({"user_id": users.astype(np.int64), "o": o.astype(np.int32), "d": d.astype(np.int32), "t": t.astype(np.int32),
                                "cnt": cnt, "phi_o": list(r.phi_o), "phi_d": list(r.phi_d), "phi_t": list(r.phi_t)})

    return docs.mapInPandas(fn, PHI_SCHEMA)
