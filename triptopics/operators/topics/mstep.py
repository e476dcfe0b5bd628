"""M-step of the topic models (O-07, O-08) on model-sized NumPy arrays.

The sufficient statistics arrive already reduced by Spark (one value per
topic × word), so the M-step works on arrays of size topics × vocabulary,
which do not grow with the number of trips or passengers.

Graphs are held as a ``StationGraph``: a sum of weighted factor blocks
F_b (G = Σ_b w_b F_b F_bᵀ, e.g. cosine similarity of POI vectors, or
co-membership of stations in a region) and/or a sparse edge list.  The
gradient only needs deg ∘ p − G p, which the factored form gives in
O(V · factors) instead of O(V²); diagonal entries of G cancel in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LOG_ZERO = -100.0
CLAMP = 1e-2


def beta_from_counts(count_zw: np.ndarray, offset: float = 0.0) -> np.ndarray:
    """O-07: log(count / row total) (+ offset); zero counts become -100."""
    total = count_zw.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(count_zw) - np.log(total) + offset
    return np.where(count_zw > 0, out, LOG_ZERO)


def l1_rows(p: np.ndarray) -> np.ndarray:
    s = np.abs(p).sum(axis=1, keepdims=True)
    return np.where(s > 0, p / np.where(s > 0, s, 1.0), p)


@dataclass
class StationGraph:
    """G = Σ w_b F_b F_bᵀ + sparse edges, over ``n`` stations."""
    n: int
    factors: list[tuple[float, np.ndarray]] = field(default_factory=list)
    edges: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def scaled(self, w: float) -> StationGraph:
        return StationGraph(self.n, [(w * a, f) for a, f in self.factors],
                            [(w * a, i, j, v) for a, i, j, v in self.edges])

    def __add__(self, other: StationGraph) -> StationGraph:
        return StationGraph(self.n, self.factors + other.factors, self.edges + other.edges)

    def matvec_rows(self, p: np.ndarray) -> np.ndarray:
        """(G pᵀ)ᵀ for a topics × stations matrix p."""
        out = np.zeros_like(p)
        for w, f in self.factors:
            out += w * (p @ f) @ f.T
        for w, i, j, v in self.edges:
            contrib = np.zeros_like(p)
            np.add.at(contrib.T, i, (v[:, None] * p[:, j].T))
            out += w * contrib
        return out

    def degree(self) -> np.ndarray:
        return self.matvec_rows(np.ones((1, self.n)))[0]

    def dense(self) -> np.ndarray:
        """Only for tests on small graphs."""
        return self.matvec_rows(np.eye(self.n))


def mixed_graph(net: StationGraph | None, poi: StationGraph | None, mu: float) -> StationGraph | None:
    """G-02: mu * G_net + (1 - mu) * G_poi."""
    parts = []
    if net is not None and mu > 0:
        parts.append(net.scaled(mu))
    if poi is not None and mu < 1:
        parts.append(poi.scaled(1.0 - mu))
    if not parts:
        return None
    g = parts[0]
    for p in parts[1:]:
        g = g + p
    return g


def graph_gradient(p: np.ndarray, p0: np.ndarray, lam: float, graph: StationGraph | None,
                   deg: np.ndarray | None = None, scale: float = 1.0) -> np.ndarray:
    """λ·scale·p0/p − (1−λ)·Σ_j G_ij (p_i − p_j) for every topic row."""
    grad = lam * scale * p0 / p
    if graph is not None and lam < 1:
        d = graph.degree() if deg is None else deg
        grad -= (1.0 - lam) * (d[None, :] * p - graph.matvec_rows(p))
    return grad


def graph_m_step(log_p0: np.ndarray, lam: float, graph: StationGraph | None, g_step: float = 1e-3,
                 tol: float = 1e-3, max_iter: int = 200, step: str = "centered") -> tuple[np.ndarray, int]:
    """O-08: graph-regularised topic rows by projected gradient ascent.

    Starts at p0, steps ``p + g·grad`` (``step='centered'`` removes the row
    mean of the gradient first, which keeps the step on the simplex and
    makes λ = 1 return p0 exactly; ``'raw'`` is the reference's step),
    clamps non-positive entries to 1e-2, L1-normalises the rows, and stops
    when the relative change of ‖p‖_F is at most ``tol``.
    """
    p0 = np.exp(log_p0)
    if graph is None or lam >= 1.0:
        if step == "centered":
            return log_p0.copy(), 0
    deg = graph.degree() if graph is not None else None
    p = p0.copy()
    norm_old = 0.1
    it = 0
    for it in range(1, max_iter + 1):
        grad = graph_gradient(p, p0, lam, graph, deg)
        if step == "centered":
            grad -= grad.mean(axis=1, keepdims=True)
        p = p + g_step * grad
        p[p <= 0] = CLAMP
        p = l1_rows(p)
        norm = float(np.linalg.norm(p))
        conv = abs(norm - norm_old) / norm_old
        norm_old = norm
        if conv <= tol:
            break
    return np.log(p), it


def blend(log_beta: np.ndarray, log_beta_hat: np.ndarray, rho: float) -> np.ndarray:
    """Online step: (1-ρ) β + ρ β̂ on probabilities, clamp, L1 rows, log."""
    b = (1.0 - rho) * np.exp(log_beta) + rho * np.exp(log_beta_hat)
    b[b <= 0] = CLAMP
    return np.log(l1_rows(b))


def learning_rate(tau0: float, kappa: float, t: int) -> float:
    """ρ_t = (τ0 + 1 + t)^-κ with t = mini-batches already absorbed."""
    return float((tau0 + 1.0 + t) ** (-kappa))


def initial_counts(rng: np.random.Generator, n_topics: int, n_words: int) -> np.ndarray:
    """1/V + U(0, 1) pseudo counts (seeded)."""
    return 1.0 / n_words + rng.random((n_topics, n_words))
