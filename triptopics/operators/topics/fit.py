"""Batch (O-09) and online (O-10/O-11) fitting of the graph-regularised tensor topic model.

The driver holds only model-sized state (β: topics × vocabulary); every
pass over documents is one Spark job: ``mapInPandas`` E-step → partial
sums per task → one small aggregate collected to the driver.  Documents
are cached once in user-partitioned, user-sorted layout (batch) or
written once to a table partitioned by mini-batch under the shared
checkpoint folder (online), so a lost executor recomputes from stable
inputs and each mini-batch reads only its own files.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.indexing import dense_index, stable_hash
from ...session import ensure_checkpoint_dir
from .estep import collect_stacked, collect_stats, estep_docs, estep_stats, prepare_docs
from .model import Corpus, TopicModel
from .mstep import (StationGraph, beta_from_counts, blend, graph_m_step, initial_counts,
                    learning_rate)

BATCH_SLICES = 8            # tasks that write one stored mini-batch


@dataclass
class TensorLDAConfig:
    J: int = 10
    K: int = 10
    L: int = 4
    alpha: float = 5.0
    iter_em: int = 10            # EM passes run while i <= iter_em (batch)
    em_tol: float = 1e-3
    em_fine_tune: float = 2e-3
    iter_inference: int = 20     # E-step sweeps run while i <= iter_inference
    var_tol: float = 1e-4
    lam: float = 0.1
    g_step: float = 1e-3
    nt_tol: float = 1e-3
    nt_max_iter: int = 200
    step: str = "centered"
    beta_tol: float = 1.5e-3
    seed: int = 0
    mode: str = "aligned"        # E-step update: 'aligned' (mean field) or 'legacy' (reference, Q7)

    @property
    def max_sweeps(self) -> int:
        return self.iter_inference + 1


def init_model(corpus: Corpus, cfg: TensorLDAConfig) -> TopicModel:
    rng = np.random.default_rng(cfg.seed)
    lo = beta_from_counts(initial_counts(rng, cfg.J, corpus.n_stations))
    ld = beta_from_counts(initial_counts(rng, cfg.K, corpus.n_stations))
    lt = beta_from_counts(initial_counts(rng, cfg.L, corpus.n_hours))
    return TopicModel(lo, ld, lt, cfg.alpha, corpus.stations, corpus.hours)


def m_step(so, sd, st, cfg: TensorLDAConfig, graph_o: StationGraph | None,
           graph_d: StationGraph | None, nt_tol: float):
    """O-07 + O-08: β from statistics; O and D regularised by their graphs, T plain."""
    return counted_m_step(so, sd, st, cfg, graph_o, graph_d, nt_tol)[0]


def counted_m_step(so, sd, st, cfg: TensorLDAConfig, graph_o: StationGraph | None, graph_d: StationGraph | None, nt_tol: float):
    """``m_step`` and the gradient steps it took for O and D; ``cfg.nt_max_iter`` steps: it did not settle."""
    bo, n_o = graph_m_step(beta_from_counts(so), cfg.lam, graph_o, cfg.g_step, nt_tol, cfg.nt_max_iter, cfg.step)
    bd, n_d = graph_m_step(beta_from_counts(sd), cfg.lam, graph_d, cfg.g_step, nt_tol, cfg.nt_max_iter, cfg.step)
    return (bo, bd, beta_from_counts(st)), (n_o, n_d)


def _norms(model: TopicModel):
    return np.array([np.linalg.norm(np.exp(b)) for b in model.beta])


def infer_docs(docs: DataFrame, model: TopicModel, cfg: TensorLDAConfig) -> DataFrame:
    """O-12/O-13: E-step with β fixed; per-document θ, topic counts, ELBO."""
    return estep_docs(prepare_docs(docs), model.beta, model.alpha, cfg.max_sweeps, cfg.var_tol, cfg.mode)


class _EM:
    """One model's way through the EM passes: its β, history and stopping state."""

    def __init__(self, corpus: Corpus, cfg: TensorLDAConfig):
        self.cfg, self.model = cfg, init_model(corpus, cfg)
        self.i, self.change, self.bound = 0, -1.0, 0.1
        self.norms, self.beta_ok, self.began = np.full(3, 0.1), False, time.time()

    @property
    def running(self) -> bool:
        c = self.cfg
        return (self.change < 0 or self.change > c.em_tol or self.i < 2 or not self.beta_ok) and self.i <= c.iter_em

    def take(self, stats, graph_o: StationGraph | None, graph_d: StationGraph | None, metric_fn) -> None:
        """The M-step on a pass's statistics."""
        so, sd, st, bound, _ = stats
        cfg, model = self.cfg, self.model
        self.change = (self.bound - bound) / self.bound
        self.bound = bound
        nt_tol = cfg.nt_tol * (0.5 if 0 < self.change < cfg.em_fine_tune else 1.0)
        (model.log_bo, model.log_bd, model.log_bt), steps = counted_m_step(so, sd, st, cfg, graph_o, graph_d, nt_tol)
        norms = _norms(model)
        self.beta_ok = bool(np.all(np.abs(norms - self.norms) / self.norms < cfg.beta_tol))
        self.norms = norms
        elapsed = time.time() - self.began
        graph = [] if graph_o is None and graph_d is None else [
            ("graph_steps_o", float(steps[0])), ("graph_steps_d", float(steps[1])), ("graph_settled", float(max(steps) < cfg.nt_max_iter))]
        rows = [("elbo", bound), *graph, *(metric_fn(model, self.i) if metric_fn is not None else [])]
        model.history += [{"step": self.i, "name": name, "value": value, "elapsed_s": elapsed} for name, value in rows]
        self.i += 1
        model.steps = self.i


def fit_batch(corpus: Corpus, cfg: TensorLDAConfig, graph_o: StationGraph | None = None,
              graph_d: StationGraph | None = None, metric_fn=None,
              prepared: DataFrame | None = None) -> TopicModel:
    """O-09: variational EM until the ELBO ratio and the β norms settle.

    ``metric_fn(model, step)`` (optional) returns extra metric rows, e.g.
    hold-out perplexity (O-14/O-17).  ``prepared`` is an already partitioned
    and cached document table shared by several fits.
    """
    return fit_grid(corpus, [cfg], graph_o, graph_d, metric_fn, prepared)[0]


def fit_grid(corpus: Corpus, cfgs: list[TensorLDAConfig], graph_o: StationGraph | None = None,
             graph_d: StationGraph | None = None, metric_fn=None, prepared: DataFrame | None = None) -> list[TopicModel]:
    """O-16: the models of several settings (λ values) in shared passes.

    An EM pass reads the documents once and takes each block through every model that still runs; each
    model stops by its own rule, so the results are those of separate fits.  The settings share the
    E-step's (α, sweeps, tolerance, mode)."""
    same = {(c.alpha, c.max_sweeps, c.var_tol, c.mode) for c in cfgs}
    if len(same) != 1:
        raise ValueError("models of one grid must share alpha, sweeps, tolerance and mode of the E-step")
    alpha, max_sweeps, var_tol, mode = same.pop()
    own = prepared is None
    docs = prepare_docs(corpus.docs).persist(StorageLevel.MEMORY_AND_DISK) if own else prepared
    runs = [_EM(corpus, cfg) for cfg in cfgs]
    while live := [r for r in runs if r.running]:
        stats = estep_stats(docs, [r.model.beta for r in live], alpha, max_sweeps, var_tol, mode)
        for r, found in zip(live, collect_stacked(stats, [r.model.shape for r in live]), strict=True):
            r.take(found, graph_o, graph_d, metric_fn)
    if own:
        docs.unpersist()
    return [r.model for r in runs]


def assign_minibatches(docs: DataFrame, batch_size: int, seed: int = 0) -> tuple[DataFrame, int]:
    """Deterministic shuffled mini-batches of ``batch_size`` users (dense order of a stable hash)."""
    users = docs.select("user_id").distinct().withColumn("_h", stable_hash("user_id", seed))
    idx = dense_index(users, [F.col("_h"), F.col("user_id")], "_pos")
    mb = idx.select("user_id", (F.col("_pos") / batch_size).cast("int").alias("mb"))
    n_users = users.count()
    return docs.join(mb, "user_id"), max(1, math.ceil(n_users / batch_size))


def online_update(model: TopicModel, batch_docs: DataFrame, cfg: TensorLDAConfig, tau0: float,
                  kappa: float, graph_o: StationGraph | None = None,
                  graph_d: StationGraph | None = None, variant: str = "blend") -> tuple[TopicModel, float, int]:
    """O-10/O-11: one mini-batch: E-step with the current β, M-step on the batch
    alone, then ρ_t = (τ0 + 1 + t)^-κ (every β normalised before blending).

    ``variant`` selects the reference's online settings:
    ``'blend'``: O, D and T blended with one ρ (default);
    ``'no_od_blend'``: O and D take the regularised batch estimate, T is blended;
    ``'rho_step'``: ρ is the graph-gradient step size, O and D not blended.
    """
    so, sd, st, ll, n_docs = collect_stats(
        estep_stats(prepare_docs(batch_docs), model.beta, model.alpha, cfg.max_sweeps, cfg.var_tol, cfg.mode),
        model.shape)
    if n_docs == 0:
        return model, 0.0, 0
    rho = learning_rate(tau0, kappa, model.steps)
    step_cfg = cfg if variant != "rho_step" else TensorLDAConfig(**{**cfg.__dict__, "g_step": rho})
    # fine-tune rule with the ELBO baseline kept in the model state (per document, so
    # mini-batches of different sizes compare)
    per_doc = ll / n_docs
    converged = (model.elbo_old - per_doc) / model.elbo_old
    model.elbo_old = per_doc
    nt_tol = cfg.nt_tol * (0.5 if 0 < converged < cfg.em_fine_tune else 1.0)
    bo, bd, bt = m_step(so, sd, st, step_cfg, graph_o, graph_d, nt_tol)
    if variant == "blend":
        model.log_bo = blend(model.log_bo, bo, rho)
        model.log_bd = blend(model.log_bd, bd, rho)
    else:
        model.log_bo, model.log_bd = bo, bd
    model.log_bt = blend(model.log_bt, bt, rho)
    model.steps += 1
    return model, ll, n_docs


def fit_online(corpus: Corpus, cfg: TensorLDAConfig, batch_size: int | None = None, epochs: int = 3,
               tau0: float = 16.0, kappa: float = 0.5, graph_o: StationGraph | None = None,
               graph_d: StationGraph | None = None, eval_every: int | None = None,
               metric_fn=None, variant: str = "blend", batches: int = 16) -> TopicModel:
    """O-10/O-11/O-17: epochs over mini-batches with a metric every ``eval_every``
    mini-batches (default: at the end of each epoch).

    An epoch has ``batches`` mini-batches whose size follows the number of travellers, so the number of jobs
    does not; ``batch_size`` fixes the size instead."""
    spark = corpus.docs.sparkSession
    model = init_model(corpus, cfg)
    size = batch_size or max(1, math.ceil(corpus.docs.select("user_id").distinct().count() / batches))
    tagged, n_batches = assign_minibatches(corpus.docs, size, cfg.seed)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/online-docs-{uuid.uuid4().hex}"
    # a mini-batch is written by several tasks, each with files of few mini-batches
    slices = F.pmod(F.xxhash64("user_id"), F.lit(BATCH_SLICES))
    tagged.repartition(F.col("mb"), slices).write.mode("overwrite").partitionBy("mb").parquet(path)
    stored = spark.read.parquet(path)
    t0 = time.time()
    for epoch in range(epochs):
        for b in range(n_batches):
            model, ll, _ = online_update(model, stored.filter(F.col("mb") == b).drop("mb"), cfg, tau0, kappa,
                                         graph_o, graph_d, variant)
            el = time.time() - t0
            model.history.append({"step": model.steps, "name": "batch_elbo", "value": ll, "elapsed_s": el})
            last = b == n_batches - 1
            due = (eval_every and model.steps % eval_every == 0) or (not eval_every and last)
            if metric_fn is not None and due:
                for name, value in metric_fn(model, model.steps):
                    model.history.append({"step": model.steps, "name": name, "value": value, "elapsed_s": el})
    return model
