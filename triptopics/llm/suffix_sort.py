"""Deep-shallow sorting of short byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

WORD = 8
SHALLOW_WORDS = 4


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte words (zero-padded), which compare like the bytes."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // WORD) * WORD), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def multikey_quicksort(words: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows by their first ``depth`` words, and the ranges of places that agree in all of these.

    Every pass splits all open segments at once, each around the word of its middle row: rows below
    and above stay at the segment's depth, equal rows go one word deeper."""
    n = len(words)
    order = np.arange(n)
    deep: list[tuple[int, int]] = []
    start, end, level = np.array([0]), np.array([n]), np.array([0])
    while len(start):
        done = level == min(depth, words.shape[1])
        deep += list(zip(start[done & (end - start > 1)].tolist(), end[done & (end - start > 1)].tolist(), strict=True))
        live = ~done & (end - start > 1)
        start, end, level = start[live], end[live], level[live]
        if not len(start):
            break
        size = end - start
        seg = np.repeat(np.arange(len(size)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[seg]
        value = words[order[place], level[seg]]
        pivot = words[order[start + size // 2], level]
        side = (value >= pivot[seg]).astype(np.int64) + (value > pivot[seg])
        moved = np.argsort(seg * 3 + side, kind="stable")
        order[place] = order[place[moved]]
        count = np.bincount(seg * 3 + side, minlength=3 * len(size)).reshape(-1, 3)
        begin = start[:, None] + np.cumsum(count, axis=1) - count
        start, end = begin.ravel(), (begin + count).ravel()
        level = (level[:, None] + np.array([0, 1, 0])).ravel()
    return order, sorted(deep)


class BlindTrie:
    """Compacted trie that keeps only branching depths; a string is placed by one blind descent and one comparison."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.number = [int.from_bytes(s) for s in strings]
        self.width = len(strings[0]) if strings else 0
        self.root: list | tuple = ([0],)        # a leaf holds equal strings, a node [depth, {byte: child}]
        for k in range(1, len(strings)):
            self.insert(k)

    def common(self, a: int, b: int) -> int:
        return self.width - (-(-(self.number[a] ^ self.number[b]).bit_length() // 8))

    def insert(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        same = self.common(k, node[0][0])
        if same == self.width:
            node[0].append(k)
            return
        other = self.strings[node[0][0]][same]
        above, node = None, self.root
        while isinstance(node, list) and node[0] < same:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == same:
            node[1][s[same]] = ([k],)
            return
        split = [same, {other: node, s[same]: ([k],)}]
        if above is None:
            self.root = split
        else:
            above[1][s[above[0]]] = split

    def in_order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out += node[0]
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow_sort(rows: np.ndarray, shallow: int = SHALLOW_WORDS) -> np.ndarray:
    """Sorted order of equally long byte rows."""
    order, deep = multikey_quicksort(as_words(rows), shallow)
    skip = shallow * WORD
    for a, b in deep:
        group = order[a:b]
        trie = BlindTrie([rows[r, skip:].tobytes() for r in group]) if rows.shape[1] > skip else None
        if trie:
            order[a:b] = group[trie.in_order()]
    return order


def neighbour_lcp(rows: np.ndarray, order: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Common prefix of each row of the order with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), step):
        j = min(len(order), i + step)
        differ = rows[order[i:j]] != rows[order[i - 1:j - 1]]
        out[i:j] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out
