"""Variational E-step of the three-way (origin, destination, time) topic model.

Pure NumPy; Spark hands it Arrow batches of documents (see ``estep.py``).
A document is a bag of distinct (o, d, t) word triples with counts: in the
mean-field update every occurrence of the same triple gets the same
variational distribution, so repeated trips are processed once and
weighted by their count.  Many documents are processed together as one
flat array of triples plus a document index; documents of like length form
padded groups, so every update is a matrix product per document, and a
document that has settled leaves its group.

Per document u with triples w (counts c_w):

* phiO[w, j] ∝ exp(Σ_kl phiD[w,k] phiT[w,l] ψ(γ_ujkl) + log βO[j, o_w]) (D, T alike);
* γ_ujkl = α + Σ_w c_w phiO[w,j] phiD[w,k] phiT[w,l];
* stop when the relative ELBO change and the relative change of the three
  φ norms are small, or after ``max_sweeps`` sweeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ...functions.special import digamma, digamma_gammaln, gammaln

PHI_TOL = 5e-4
# Triples per padded group (bounds the (rows, J·K) working array); a longer document is taken in slices.
ROW_BLOCK = 2048


@dataclass
class EStepResult:
    gamma: np.ndarray      # (D, J, K, L)
    phi_o: np.ndarray      # (n, J)
    phi_d: np.ndarray      # (n, K)
    phi_t: np.ndarray      # (n, L)
    elbo: np.ndarray       # (D,)
    sweeps: np.ndarray     # (D,)


def _softmax_rows(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _xlogx(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0)


def _elbo_prior(gsum, lngamma, jkl, alpha):
    """Prior and entropy of q(θ) with Σ_w c_w E[log θ] = Σ (γ-α) E[log θ]: the E[log θ] terms cancel.

    ``lngamma`` is Σ lnΓ(γ) of each document."""
    return gammaln(alpha * jkl) - jkl * gammaln(alpha) - gammaln(gsum) + lngamma


def _elbo(gamma, starts, cnt, phi_o, phi_d, phi_t, lo, ld, lt, alpha):
    g = gamma.reshape(gamma.shape[0], -1)
    ll = _elbo_prior(g.sum(axis=1), gammaln(g).sum(axis=1), g.shape[1], alpha)
    word = (-_xlogx(phi_o) + phi_o * lo).sum(axis=1)
    word += (-_xlogx(phi_d) + phi_d * ld).sum(axis=1)
    word += (-_xlogx(phi_t) + phi_t * lt).sum(axis=1)
    ll += np.add.reduceat(cnt * word, starts)
    return ll


def e_step(doc: np.ndarray, o: np.ndarray, d: np.ndarray, t: np.ndarray, cnt: np.ndarray,
           log_bo: np.ndarray, log_bd: np.ndarray, log_bt: np.ndarray, alpha: float,
           max_sweeps: int = 21, var_tol: float = 1e-4, phi_tol: float = PHI_TOL,
           mode: str = "aligned", last: np.ndarray | None = None) -> EStepResult:
    """Mean-field E-step for a block of documents.

    ``doc`` must be sorted (all triples of a document contiguous) and hold
    0-based document numbers.  Word ids index the columns of the log β
    matrices.  Returns per-document γ and ELBO and per-triple φ.

    ``mode='legacy'`` reproduces the reference's update (Q7): the prior term
    of every word uses exp() of the *document's last trip's* φ of the other
    dimensions from before their latest update (zeros on the first pass),
    so it is the same for all words of a document.  ``last`` flags the
    triple of each document's last trip (required in legacy mode).
    """
    if mode == "legacy":
        return _e_step_legacy(doc, o, d, t, cnt, log_bo, log_bd, log_bt, alpha, max_sweeps, var_tol,
                              phi_tol, last)
    J, K, L = log_bo.shape[0], log_bd.shape[0], log_bt.shape[0]
    cnt = cnt.astype(np.float64)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[starts, doc.size])
    n_docs, n = starts.size, doc.size
    out = EStepResult(np.empty((n_docs, J, K, L)), np.empty((n, J)), np.empty((n, K)), np.empty((n, L)),
                      np.zeros(n_docs), np.zeros(n_docs, dtype=np.int64))
    words = (np.asarray(o), np.asarray(d), np.asarray(t))
    beta = tuple(np.ascontiguousarray(m.T) for m in (log_bo, log_bd, log_bt))
    for docs in _groups(size):
        _settle(docs, starts, size, words, cnt, beta, alpha, max_sweeps, var_tol, phi_tol, out)
    return out


def _groups(size: np.ndarray) -> Iterator[np.ndarray]:
    """Documents by length, cut where a group padded to its longest would pass ``ROW_BLOCK`` triples."""
    order = np.argsort(size, kind="stable")[::-1]
    i = 0
    while i < order.size:
        j = i + max(1, ROW_BLOCK // int(size[order[i]]))
        yield order[i:j]
        i = j


def _soft(prior: np.ndarray, logb: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p ∝ exp(prior + logb) in place; returns Σ p (logb − log p) of each row."""
    z = prior + logb
    top = z.max(axis=-1, keepdims=True)
    np.exp(np.subtract(z, top, out=z), out=z)
    total = z.sum(axis=-1, keepdims=True)
    np.divide(z, total, out=p)
    return (np.log(total) + top)[..., 0] - (p * prior).sum(axis=-1)


def _settle(docs, starts, size, words, cnt, beta, alpha, max_sweeps, var_tol, phi_tol, out: EStepResult) -> None:
    """Sweeps over one group of documents, rows padded to the longest with count 0, until each has settled."""
    _, J, K, L = out.gamma.shape
    R, jkl = int(size[docs[0]]), J * K * L
    inside = np.arange(R)[None, :] < size[docs][:, None]
    row = np.where(inside, starts[docs][:, None] + np.arange(R)[None, :], starts[docs][:, None])
    c = np.where(inside, cnt[row], 0.0)
    logs = [b[w[row]] for w, b in zip(words, beta, strict=True)] if docs.size * R <= ROW_BLOCK else None
    phi = [np.full((docs.size, R, m), 1.0 / m) for m in (J, K, L)]
    gamma = np.repeat((alpha + c.sum(axis=1) / jkl)[:, None], jkl, axis=1)
    psi = digamma(gamma)
    elbo_old, norm_old = np.full(docs.size, 0.1), np.full((3, docs.size), 0.1)
    for sweep in range(1, max_sweeps + 1):
        D = docs.size
        psi4 = psi.reshape(D, J, K, L)
        by_kl = np.ascontiguousarray(psi4.reshape(D, J, K * L).transpose(0, 2, 1))
        by_jl = np.ascontiguousarray(psi4.transpose(0, 1, 3, 2)).reshape(D, J * L, K)
        by_jk = psi4.reshape(D, J * K, L)
        acc, word, norms = np.zeros((D, J * K, L)), np.zeros(D), np.zeros((3, D))
        for a in range(0, R, ROW_BLOCK):
            s = slice(a, a + ROW_BLOCK)
            po, pd_, pt = (p[:, s] for p in phi)
            lo, ld, lt = (m[:, s] for m in logs) if logs else (b[w[row[:, s]]] for w, b in zip(words, beta, strict=True))
            n, cs = po.shape[1], c[:, s]
            kl = (pd_[:, :, :, None] * pt[:, :, None, :]).reshape(D, n, K * L)
            w = _soft(kl @ by_kl, lo, po)
            jl = (po[:, :, :, None] * pt[:, :, None, :]).reshape(D, n, J * L)
            w += _soft(jl @ by_jl, ld, pd_)
            jk = (po[:, :, :, None] * pd_[:, :, None, :]).reshape(D, n, J * K)
            w += _soft(jk @ by_jk, lt, pt)
            acc += jk.transpose(0, 2, 1) @ (pt * cs[:, :, None])
            word += (cs * w).sum(axis=1)
            for k, p in enumerate((po, pd_, pt)):
                norms[k] += (cs * (p * p).sum(axis=2)).sum(axis=1)
        gamma = alpha + acc.reshape(D, jkl)
        psi, lngamma = digamma_gammaln(gamma)
        elbo = _elbo_prior(gamma.sum(axis=1), lngamma.sum(axis=1), jkl, alpha) + word
        norms = np.sqrt(norms)
        done = (np.abs((elbo_old - elbo) / elbo_old) <= var_tol) & (np.abs(norms - norm_old) / norm_old < phi_tol).all(axis=0)
        elbo_old, norm_old = elbo, norms
        if sweep == max_sweeps:
            done[:] = True
        if done.any():
            ended = docs[done]
            out.gamma[ended], out.elbo[ended], out.sweeps[ended] = gamma[done].reshape(-1, J, K, L), elbo[done], sweep
            own = inside[done]
            to = row[done][own]
            for whole, p in zip((out.phi_o, out.phi_d, out.phi_t), phi, strict=True):
                whole[to] = p[done][own]
            left = ~done
            if not left.any():
                return
            docs, inside, row, c, psi = docs[left], inside[left], row[left], c[left], psi[left]
            phi = [p[left] for p in phi]
            logs = [m[left] for m in logs] if logs else None
            elbo_old, norm_old = elbo_old[left], norm_old[:, left]


def _e_step_legacy(doc, o, d, t, cnt, log_bo, log_bd, log_bt, alpha, max_sweeps, var_tol, phi_tol, last):
    J, K, L = log_bo.shape[0], log_bd.shape[0], log_bt.shape[0]
    cnt = cnt.astype(np.float64)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n_docs = starts.size
    seg = np.repeat(np.arange(n_docs), np.diff(np.r_[starts, doc.size]))
    n = doc.size
    last_row = np.zeros(n_docs, dtype=np.int64)
    last_row[seg[np.flatnonzero(last)]] = np.flatnonzero(last)
    size = np.diff(np.r_[starts, n])
    lo, ld, lt = log_bo[:, o].T.copy(), log_bd[:, d].T.copy(), log_bt[:, t].T.copy()
    words = np.add.reduceat(cnt, starts)
    gamma = np.repeat((alpha + words / (J * K * L))[:, None], J * K * L, axis=1).reshape(n_docs, J, K, L)
    phi_o, phi_d, phi_t = np.full((n, J), 1.0 / J), np.full((n, K), 1.0 / K), np.full((n, L), 1.0 / L)
    old_o, old_d, old_t = np.zeros((n_docs, J)), np.zeros((n_docs, K)), np.zeros((n_docs, L))
    active = np.ones(n_docs, dtype=bool)
    sweeps = np.zeros(n_docs, dtype=np.int64)
    elbo_old, norm_old, elbo = np.full(n_docs, 0.1), np.full((3, n_docs), 0.1), np.zeros(n_docs)
    for _ in range(max_sweeps):
        if not active.any():
            break
        live, rows = np.flatnonzero(active), np.flatnonzero(active[seg])     # settled documents are not swept again
        begin = np.cumsum(size[live]) - size[live]
        of = np.repeat(np.arange(live.size), size[live])
        psi = digamma(gamma[live])
        prior = np.matmul(np.matmul(psi, np.exp(old_t[live])[:, None, :, None])[..., 0], np.exp(old_d[live])[:, :, None])[..., 0]
        was_o = phi_o[last_row[live]]
        phi_o[rows] = _softmax_rows(prior[of] + lo[rows])
        old_o[live] = was_o
        jl = np.matmul(np.exp(old_o[live])[:, None, :], psi.reshape(live.size, J, K * L)).reshape(-1, K, L)
        prior = np.matmul(jl, np.exp(old_t[live])[:, :, None])[..., 0]
        was_d = phi_d[last_row[live]]
        phi_d[rows] = _softmax_rows(prior[of] + ld[rows])
        old_d[live] = was_d
        prior = np.matmul(np.exp(old_d[live])[:, None, :], jl)[:, 0]
        was_t = phi_t[last_row[live]]
        phi_t[rows] = _softmax_rows(prior[of] + lt[rows])
        old_t[live] = was_t
        gamma[live] = alpha + _expected_counts(live, starts, size, cnt, phi_o, phi_d, phi_t)
        found = [p[rows] for p in (phi_o, phi_d, phi_t)]
        own = cnt[rows]
        new_elbo = _elbo(gamma[live], begin, own, *found, lo[rows], ld[rows], lt[rows], alpha)
        norms = np.stack([np.sqrt(np.add.reduceat(own * (p * p).sum(axis=1), begin)) for p in found])
        rel = np.abs((elbo_old[live] - new_elbo) / elbo_old[live])
        phi_ok = (np.abs(norms - norm_old[:, live]) / norm_old[:, live] < phi_tol).all(axis=0)
        elbo[live], elbo_old[live], norm_old[:, live] = new_elbo, new_elbo, norms
        sweeps[live] += 1
        active[live] = ~((rel <= var_tol) & phi_ok)
    return EStepResult(gamma, phi_o, phi_d, phi_t, elbo, sweeps)


def _expected_counts(docs, starts, size, cnt, phi_o, phi_d, phi_t) -> np.ndarray:
    """Σ_w c_w φO ⊗ φD ⊗ φT of each of ``docs``, in groups of like length and slices of ``ROW_BLOCK`` rows."""
    J, K, L = phi_o.shape[1], phi_d.shape[1], phi_t.shape[1]
    out = np.zeros((docs.size, J * K, L))
    for group in _groups(size[docs]):
        mine = docs[group]
        for a in range(0, int(size[mine[0]]), ROW_BLOCK):
            at = np.arange(a, min(a + ROW_BLOCK, int(size[mine[0]])))[None, :]
            inside = at < size[mine][:, None]
            row = starts[mine][:, None] + np.where(inside, at, 0)
            jk = (phi_o[row][:, :, :, None] * phi_d[row][:, :, None, :]).reshape(*row.shape, J * K)
            out[group] += jk.transpose(0, 2, 1) @ (phi_t[row] * np.where(inside, cnt[row], 0.0)[:, :, None])
    return out.reshape(-1, J, K, L)


def topic_word_stats(word: np.ndarray, phi: np.ndarray, cnt: np.ndarray, n_words: int) -> np.ndarray:
    """Σ over triples of c_w φ[w, z] accumulated at word id (topics × words)."""
    w = phi * cnt[:, None]
    return np.stack([np.bincount(word, weights=w[:, z], minlength=n_words) for z in range(phi.shape[1])])


def doc_topic_counts(doc_starts: np.ndarray, phi: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """Σ_w c_w φ[w, z] per document (the reference's count_uz)."""
    return np.add.reduceat(phi * cnt[:, None], doc_starts, axis=0)
