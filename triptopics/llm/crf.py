"""A linear-chain conditional random field over word-shape features, in numpy batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

FORBIDDEN = -1e4


def _padded(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.max(initial=1))[None, :] < lengths[:, None]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Model:
    tags: tuple[str, ...]
    index: dict[str, int]
    weight: np.ndarray      # features x tags
    step: np.ndarray        # tag -> next tag
    start: np.ndarray

    def emissions(self, tokens: Sequence[Sequence[str]]) -> np.ndarray:
        """Scores of each token's tags; features that training never saw add nothing."""
        ids = [[k for f in fs if (k := self.index.get(f)) is not None] for fs in tokens]
        n = np.array([len(x) for x in ids], np.int64)
        out = np.zeros((len(ids), len(self.tags)))
        np.add.at(out, np.repeat(np.arange(len(ids)), n), self.weight[np.array([k for x in ids for k in x], np.int64)])
        return out

    def decode(self, sequences: Sequence[Sequence[Sequence[str]]], cells: int = 200_000) -> list[np.ndarray]:
        """Best tag path of each sequence of token features: Viterbi over batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: len(sequences[k]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and len(sequences[order[j]]) * (j - i + 1) <= cells:
                j += 1
            part = order[i:j]
            lengths = np.array([len(sequences[k]) for k in part])
            scores = np.zeros((len(part), lengths.max(), len(self.tags)))
            scores[_padded(lengths)] = self.emissions([t for k in part for t in sequences[k]])
            for k, path in zip(part, self._viterbi(scores, lengths), strict=True):
                out[k] = path
            i = j
        return out

    def _viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        b, t_max, k = scores.shape
        back = np.zeros((b, t_max, k), np.int8)
        best = self.start + scores[:, 0]
        for t in range(1, t_max):
            live = lengths > t
            through = best[:, :, None] + self.step
            back[:, t] = through.argmax(axis=1)
            best = np.where(live[:, None], through.max(axis=1) + scores[:, t], best)
        path = np.zeros((b, t_max), np.int64)
        last = best.argmax(axis=1)
        for t in range(t_max - 1, -1, -1):
            path[:, t] = last
            last = np.where(lengths > t, back[np.arange(b), t, last], last) if t else last
        return [path[r, :n] for r, n in enumerate(lengths)]


def allowed_steps(tags: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed scores that forbid an inside tag unless its own begin or inside tag comes before."""
    step = np.zeros((len(tags), len(tags)))
    start = np.zeros(len(tags))
    for j, tag in enumerate(tags):
        if tag.startswith("I-"):
            start[j] = FORBIDDEN
            for i, before in enumerate(tags):
                if before not in (tag, "B-" + tag[2:]):
                    step[i, j] = FORBIDDEN
    return step, start


def train(sequences: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[int]], tags: Sequence[str],
          rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Maximum likelihood with a quadratic penalty: Adam steps over the whole (small) labelled table."""
    pairs = [(s, y) for s, y in zip(sequences, labels, strict=True) if len(s)]
    names = sorted({f for s, _ in pairs for t in s for f in t})
    index = {f: k for k, f in enumerate(names)}
    lengths = np.array([len(s) for s, _ in pairs])
    mask = _padded(lengths)
    b, t_max, k = *mask.shape, len(tags)
    flat = [[index[f] for f in t] for s, _ in pairs for t in s]
    feature = np.array([f for fs in flat for f in fs], np.int64)
    token = np.repeat(np.arange(len(flat)), [len(fs) for fs in flat])
    gold = np.zeros((b, t_max), np.int64)
    gold[mask] = np.concatenate([np.asarray(y) for _, y in pairs])
    truth = np.eye(k)[gold] * mask[:, :, None]
    fixed_step, fixed_start = allowed_steps(tags)
    both = mask[:, 1:] & mask[:, :-1]
    seen_steps = np.einsum("bti,btj->ij", truth[:, :-1] * both[:, :, None], truth[:, 1:])
    params = [np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        w, step, start = params[0], params[1] + fixed_step, params[2] + fixed_start
        scores = np.zeros((b, t_max, k))
        e = np.zeros((len(flat), k))
        np.add.at(e, token, w[feature])
        scores[mask] = e
        ahead = np.zeros((b, t_max, k))
        ahead[:, 0] = start + scores[:, 0]
        for t in range(1, t_max):
            ahead[:, t] = np.where(mask[:, t, None], _logsumexp(ahead[:, t - 1, :, None] + step, 1) + scores[:, t], ahead[:, t - 1])
        behind = np.zeros((b, t_max, k))
        for t in range(t_max - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], _logsumexp(step[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        total = _logsumexp(ahead[:, -1], 1)
        prob = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        edge = np.exp(ahead[:, :-1, :, None] + step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        over = (prob - truth)[mask]
        grad_w = np.zeros_like(w)
        np.add.at(grad_w, feature, over[token])
        grads = [grad_w, (edge * both[:, :, None, None]).sum(axis=(0, 1)) - seen_steps, (prob[:, 0] - truth[:, 0]).sum(axis=0)]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g / b + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    return Model(tuple(tags), index, params[0], params[1] + fixed_step, params[2] + fixed_start)
