"""Weighted acyclic automata over n-grams of up to three words.

``CountTransducer`` takes n-grams in sorted order and maps each to its count: the count stands on the
last arc of the n-gram's path.  States are closed as soon as sorted input can no longer reach them and
are looked up in a register, so equal states (the same words, counts and targets) are stored once.
``paths`` reads an automaton back as arrays, ``union`` adds up several, and ``prefix_weight`` composes
n-grams with an automaton: it walks a prefix and returns the weight found there.

N-grams are packed into one number each: word ids plus one, 21 bits a word, zero for no word, so that
numeric order is word order with a prefix before its continuations.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import U, mix

BITS = 21
MOST_WORDS = (1 << BITS) - 2
_WORD = U((1 << BITS) - 1)
_SHIFT = (U(2 * BITS), U(BITS), U(0))


def packed(first: np.ndarray, second: np.ndarray | int = 0, third: np.ndarray | int = 0) -> np.ndarray:
    """Numbers of n-grams; arguments are word ids plus one, or zero."""
    return (np.asarray(first, U) << _SHIFT[0]) | (np.asarray(second, U) << _SHIFT[1]) | np.asarray(third, U)


def word_at(keys: np.ndarray, place: int) -> np.ndarray:
    """Word ids plus one at ``place`` (0 to 2) of the n-grams."""
    return ((keys >> _SHIFT[place]) & _WORD).astype(np.int64)


def prefixes(keys: np.ndarray, words: int) -> np.ndarray:
    return (keys >> _SHIFT[words - 1]) << _SHIFT[words - 1]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def with_prefixes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and those of their prefixes that are missing, with a count of zero."""
    missing = []
    for words in (1, 2):
        p = prefixes(keys, words)
        p = p[np.append(True, p[1:] != p[:-1])[:len(p)]]
        missing.append(p[~_among(p, keys)])
    extra = np.unique(np.concatenate(missing))
    if not len(extra):
        return keys, counts
    return summed(np.concatenate([keys, extra]), np.concatenate([counts, np.zeros(len(extra), counts.dtype)]))


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def prefix_weight(keys: np.ndarray, counts: np.ndarray, grams: np.ndarray, words: int) -> np.ndarray:
    """Weight on the path of the first ``words`` words of ``grams`` in the automaton whose paths are ``keys`` (0: no path)."""
    want = prefixes(grams, words)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, counts[at], 0)


# --- construction ----------------------------------------------------------------------------

class _Layer:
    """The states of one depth: arcs (word, weight, target) state after state, with a register of closed states."""

    def __init__(self):
        self.begin = np.zeros(1, np.int64)
        self.arcs = np.zeros((3, 0), np.int64)
        self.known = np.zeros(0, U)
        self.number = np.zeros(0, np.int64)

    def close(self, degree: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Numbers of the states with the given arcs; states not in the register are added."""
        n = len(degree)
        begin = np.concatenate([[0], np.cumsum(degree)])
        row = np.repeat(np.arange(n), degree)
        place = np.arange(len(row)) - begin[row]
        h = mix(mix(arcs[0].astype(U) * U(0x9E3779B97F4A7C15) + place.astype(U)) ^ arcs[1].astype(U) * U(0xC2B2AE3D27D4EB4F)
                ^ mix((arcs[2] + 2).astype(U)))
        sign = np.add.reduceat(h, begin[:-1]) if n else np.zeros(0, U)
        signs, first, which = np.unique(sign, return_index=True, return_inverse=True)
        old = np.searchsorted(self.known, signs)
        found = (old < len(self.known)) & (self.known[np.minimum(old, max(0, len(self.known) - 1))] == signs) if len(self.known) else np.zeros(len(signs), bool)
        number = np.where(found, self.number[old * found] if len(self.known) else 0, -1)
        state = self._add(first[~found], begin, degree, arcs)
        number[~found] = state
        out = number[which]
        wrong = ~self._same(out, begin, degree, arcs)       # another state of the same hash: stored, not shared
        if wrong.any():
            out[wrong] = self._add(np.flatnonzero(wrong), begin, degree, arcs)
        known = np.concatenate([self.known, signs[~found]])
        order = np.argsort(known)
        self.known, self.number = known[order], np.concatenate([self.number, state])[order]
        return out

    def _add(self, rows: np.ndarray, begin: np.ndarray, degree: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        d = degree[rows]
        at = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(d)[:-1]]) if len(rows) else rows, d) + np.arange(d.sum())
        state = np.arange(len(rows)) + len(self.begin) - 1
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(d)])
        self.arcs = np.concatenate([self.arcs, arcs[:, at]], axis=1)
        return state

    def _same(self, state: np.ndarray, begin: np.ndarray, degree: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        out = self.begin[state + 1] - self.begin[state] == degree
        rows = np.flatnonzero(out)
        row = np.repeat(rows, degree[rows])
        place = np.arange(len(row)) - np.repeat(np.cumsum(degree[rows]) - degree[rows], degree[rows])
        equal = (self.arcs[:, self.begin[state[row]] + place] == arcs[:, begin[row] + place]).all(axis=0)
        out[row[~equal]] = False
        return out

    def follow(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every state (-1: none) its arcs, as (index into ``state``, arc)."""
        begin = self.begin[np.maximum(state, 0)]
        degree = np.where(state >= 0, self.begin[np.maximum(state, 0) + 1] - begin, 0) if len(self.begin) > 1 else np.zeros(len(state), np.int64)
        row = np.repeat(np.arange(len(state)), degree)
        place = np.arange(len(row)) - np.repeat(np.cumsum(degree) - degree, degree)
        return row, begin[row] + place if len(row) else row


class CountTransducer:
    """Automaton built from n-grams added in sorted order; every prefix of an n-gram must be among them."""

    def __init__(self):
        self.top: list[np.ndarray] = []         # arcs of the root, chunk after chunk
        self.second, self.third = _Layer(), _Layer()
        self.open = (np.zeros(0, U), np.zeros(0, np.int64))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> CountTransducer:
        """Add the next sorted n-grams; those of the last first word stay open until another word comes."""
        keys, counts = np.concatenate([self.open[0], keys]), np.concatenate([self.open[1], counts])
        cut = int(np.searchsorted(keys, prefixes(keys[-1:], 1)[0])) if len(keys) else 0
        self._close(keys[:cut], counts[:cut])
        self.open = keys[cut:], counts[cut:]
        return self

    def finish(self) -> CountTransducer:
        self._close(*self.open)
        self.open = self.open[0][:0], self.open[1][:0]
        return self

    def _close(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if not len(keys):
            return
        words = [word_at(keys, k) for k in range(3)]
        size = (words[1] > 0).astype(np.int8) + (words[2] > 0)
        one, two, three = (np.flatnonzero(size == k) for k in range(3))
        parent = np.cumsum(size == 1) - 1
        target = self._states(self.third, parent[three], len(two), np.stack([words[2][three], counts[three], np.full(len(three), -1)]))
        parent = np.cumsum(size == 0) - 1
        target = self._states(self.second, parent[two], len(one), np.stack([words[1][two], counts[two], target]))
        self.top.append(np.stack([words[0][one], counts[one], target]))

    @staticmethod
    def _states(layer: _Layer, parent: np.ndarray, n: int, arcs: np.ndarray) -> np.ndarray:
        degree = np.bincount(parent, minlength=n)
        out = np.full(n, -1)
        has = np.flatnonzero(degree)
        if len(has):
            out[has] = layer.close(degree[has], arcs)
        return out

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams with their counts: single words, then pairs, then triples, each in sorted order."""
        first = np.concatenate(self.top, axis=1) if self.top else np.zeros((3, 0), np.int64)
        row, arc = self.second.follow(first[2])
        second = self.second.arcs[:, arc]
        row3, arc3 = self.third.follow(second[2])
        third = self.third.arcs[:, arc3]
        pair = packed(first[0][row], second[0])
        return (np.concatenate([packed(first[0]), pair, pair[row3] | third[0].astype(U)]),
                np.concatenate([first[1], second[1], third[1]]))

    def n_states(self) -> int:
        return 1 + len(self.second.begin) + len(self.third.begin) - 2

    # --- bytes -------------------------------------------------------------------------------

    def arrays(self) -> list[np.ndarray]:
        self.finish()
        first = np.concatenate(self.top, axis=1) if self.top else np.zeros((3, 0), np.int64)
        return [*first, np.diff(self.second.begin), *self.second.arcs, np.diff(self.third.begin), *self.third.arcs[:2]]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> CountTransducer:
        out = cls()
        wide = [np.asarray(a, np.int64) for a in arrays]
        out.top = [np.stack(wide[:3])]
        out.second.begin, out.second.arcs = np.concatenate([[0], np.cumsum(wide[3])]), np.stack(wide[4:7])
        out.third.begin = np.concatenate([[0], np.cumsum(wide[7])])
        out.third.arcs = np.stack([*wide[8:10], np.full(len(wide[8]), -1)])
        return out


def to_bytes(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers of -1 or more, each in the narrowest unsigned type (stored plus one)."""
    parts = []
    for a in arrays:
        a = np.asarray(a, np.int64) + 1
        kind = next(k for k in "BHIQ" if not len(a) or int(a.max()) <= np.iinfo(np.dtype(k)).max)
        raw = a.astype("<" + np.dtype(kind).str[1:]).tobytes()
        parts += [kind.encode(), struct.pack("<Q", len(raw)), raw]
    return b"".join(parts)


def from_bytes(raw: bytes, at: int = 0) -> list[np.ndarray]:
    out = []
    while at < len(raw):
        dtype = np.dtype(raw[at:at + 1].decode()).newbyteorder("<")
        size = struct.unpack_from("<Q", raw, at + 1)[0]
        out.append(np.frombuffer(raw, dtype, size // dtype.itemsize, at + 9).astype(np.int64) - 1)
        at += 9 + size
    return out


# --- union -----------------------------------------------------------------------------------

def vocabulary(columns: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all columns in byte order, and each column as ids into them."""
    encoded = pa.chunked_array([c.dictionary_encode() for c in columns]).unify_dictionaries()
    words = encoded.chunk(0).dictionary
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return words.take(pa.array(order)), [rank[c.indices.to_numpy()] for c in encoded.chunks]


def union(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, sorted n-grams and summed counts of several (words, n-grams, counts)."""
    words, ids = vocabulary([p[0] for p in parts])
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in one range: take narrower ranges")
    moved = []
    for (_, keys, _), own in zip(parts, ids, strict=True):
        to = np.concatenate([[0], own + 1])
        moved.append(packed(*(to[word_at(keys, k)] for k in range(3))))
    keys, counts = summed(np.concatenate(moved), np.concatenate([p[2] for p in parts]))
    return words, keys, counts
