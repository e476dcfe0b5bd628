"""Phrase collocations by weighted acyclic automata.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words; n-grams
of one to three words are counted within pieces, everything per ``lang`` (null: ``und``).

1. A task sorts the n-grams of every ``BLOCK_TOKENS`` words, cuts them at the splitters of the prefix
   ranges, and builds a count transducer of each cut (``count_automata``).  What crosses the network
   are these automata, keyed by (lang, range).  The splitters are n-grams themselves, so the n-grams
   of a very frequent first word, or pair, are cut too; they are read off a bounded sample of the
   documents (``SAMPLE_DOCS``), which decides where ranges begin and nothing else.
2. The automata of a range are united, summing weights; n-grams under ``min_count`` drop out, exactly,
   because a range holds all counts of its n-grams.  Walking an n-gram's path gives the counts of its
   first parts.  (Splitters' own prefixes are sent along to the ranges they reach into.)
3. The survivors are cut and united once more with their words reversed: the paths of these automata
   give the counts of the last parts, so no count is ever fetched by a join on a frequent word.
4. Scores are exact whole numbers.  A pair inside a triple that has half its count is dropped; at most
   four triples can drop a pair, so this join has no frequent key.  Ranks are taken over the best
   ``top`` of each of ``SPREAD`` slices first.

Memory: a task holds one block's n-grams, or the distinct n-grams of a range (``RANGE_ENTRIES`` on
average, while the corpus needs at most ``MOST_RANGES`` of them).

Null and empty texts have no words; repeated rows count as often as they occur; an empty table gives an
empty result; very long texts are read in steps and their n-grams kept across them; other columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import count_automata as ca
from .common import hinted, text_view, written

MIN_COUNT = 10
INSIDE_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"

BLOCK_TOKENS = 2_000_000
STEP_BYTES = 1 << 22
RANGE_ENTRIES = 600_000
MOST_RANGES = 100_000
SAMPLE_DOCS = 4_000
SAMPLE_EVERY = 32           # one in so many n-grams of a block of theirs is taken,
SAMPLE_KEYS = 4_096         # and at most so many of one block
UNITE_ENTRIES = 4_000_000
SPREAD = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPLIT = _BREAK.copy()
_SPLIT[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Key = tuple[bytes, ...]
Splitters = dict[str, list[Key]]
PIECE = "lang string, range int, body binary"


# --- words -----------------------------------------------------------------------------------

def _steps(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, begin, end) of about ``STEP_BYTES``; a longer text is cut before a separator."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + STEP_BYTES, "right")) - 1))
        begin, end = int(off[i]), int(off[j])
        while end - begin > 2 * STEP_BYTES:
            cut, at = -1, begin + STEP_BYTES
            while cut < 0 and at < end:
                rest = np.flatnonzero(_SPLIT[data[at:at + STEP_BYTES]])
                cut = at + int(rest[0]) if len(rest) else -1
                at += STEP_BYTES
            if cut < 0:
                break
            yield i, j, begin, cut
            begin = cut
        yield i, j, begin, end
        i = j


def _binary(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))])


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words (a dictionary array), their rows, the number of piece breaks before each word, and of all breaks."""
    word = ~_SPLIT[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.append(False, word[:-1])
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.append(word[1:], False)
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    breaks = np.cumsum(_BREAK[data])
    return (_binary(end - start, _LOWER[data[word]]).dictionary_encode(), np.searchsorted(off, start, "right") - 1,
            breaks[start] if len(start) else start, int(breaks[-1]) if len(data) else 0)


class _Buffer:
    """Words of one language in reading order, up to a block's n-grams; the last two words stay for the next block."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.joined: list[np.ndarray] = []     # whether a word goes on in the piece of the word before
        self.size = self.head = 0

    def add(self, words: pa.Array, joined: np.ndarray) -> None:
        self.words.append(words)
        self.joined.append(joined)
        self.size += len(words)

    def ngrams(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Vocabulary in byte order, sorted n-grams and counts of the words that are new since the last call."""
        plain = pa.chunked_array(self.words).unify_dictionaries()
        vocab = plain.chunk(0).dictionary
        order = pc.sort_indices(vocab).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        one = (rank[np.concatenate([c.indices.to_numpy() for c in plain.chunks])] + 1).astype(np.uint64)
        two = np.concatenate(self.joined)
        three = two[2:] & two[1:-1]
        h = self.head
        pair = two[1:] & (np.arange(1, len(two)) >= h)
        three &= np.arange(2, len(two)) >= h
        keys = np.concatenate([ca.packed(one[h:]), ca.packed(one[:-1][pair], one[1:][pair]),
                               ca.packed(one[:-2][three], one[1:-1][three], one[2:][three])])
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(first, len(keys)))
        keep = min(2, len(one))
        tail = pa.chunked_array([c.cast(pa.large_binary()) for c in plain.chunks[-2:]]).combine_chunks()
        tail = tail.slice(max(0, len(tail) - keep)) if len(tail) >= keep else plain.cast(pa.large_binary()).combine_chunks().slice(len(one) - keep)
        self.words, self.joined = [tail.dictionary_encode()], [two[len(two) - keep:]]
        self.size = self.head = keep
        return vocab.take(pa.array(order)), keys[first], counts


def block_ngrams(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, vocabulary, sorted n-grams, counts) of every block of the batches' texts (columns text, lang)."""
    buffers: dict[str, _Buffer] = {}

    def done() -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        for lang, buffer in buffers.items():
            if buffer.size > buffer.head:
                yield lang, *buffer.ngrams()

    for batch in batches:
        data, off = text_view(batch.column("text"))
        langs = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        went = None                              # (row, its words so far end inside a piece)
        for i, j, begin, end in _steps(off, data):
            inner = np.clip(off[i:j + 1], begin, end) - begin
            words, row, breaks, total = words_of(data[begin:end], inner)
            joined = np.append(False, (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1]))[:len(row)]
            if len(row) and went == i + row[0] and breaks[0] == 0:
                joined[0] = True                 # a long text's words go on after a cut
            if begin > off[i] or end < off[j]:
                went = i if (len(row) and breaks[-1] == total) or (not len(row) and went == i and not total) else None
            else:
                went = None
            lang_of = code[i + row]
            for k in np.unique(lang_of):
                mine = np.flatnonzero(lang_of == k)
                buffer = buffers.setdefault(names[k], _Buffer())
                buffer.add(words.take(pa.array(mine)) if len(mine) < len(row) else words, joined[mine])
            if sum(b.size for b in buffers.values()) >= BLOCK_TOKENS:
                yield from done()
    yield from done()


# --- prefix ranges ---------------------------------------------------------------------------

def key_words(vocab: pa.Array, keys: np.ndarray) -> list[Key]:
    """The n-grams as tuples of words."""
    places = [ca.word_at(keys, k) - 1 for k in range(3)]
    texts = [vocab.take(pa.array(np.maximum(p, 0))).to_pylist() for p in places]
    return [tuple(t for t, p in zip(ws, ps, strict=True) if p >= 0) for ws, ps in zip(zip(*texts, strict=True), zip(*places, strict=True), strict=True)]


def _bounds(words: list[bytes], splitters: list[Key]) -> tuple[np.ndarray, list[list[int]]]:
    """For each splitter the least number that is not before it, and the numbers of its proper prefixes among ``words``."""
    low, shorter = [], []
    for key in splitters:
        ids, exact = [0, 0, 0], True
        own = []
        for place, word in enumerate(key):
            at = bisect.bisect_left(words, word)
            ids[place] = at + 1
            exact = at < len(words) and words[at] == word
            if not exact:
                break
            if place + 1 < len(key):
                own.append((ids[0] << 2 * ca.BITS) | (ids[1] << ca.BITS))
        low.append((ids[0] << 2 * ca.BITS) | (ids[1] << ca.BITS) | ids[2])
        shorter.append(own)
    return np.array(low, np.uint64), shorter


def _among(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, want)
    return at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want)]


def pieces(lang: str, vocab: pa.Array, keys: np.ndarray, counts: np.ndarray, splitters: Splitters,
           extra: np.ndarray | None = None) -> Iterator[tuple[str, int, bytes]]:
    """(lang, range, automaton) of sorted n-grams cut at the splitters; ``extra`` holds further numbers of each n-gram.

    A splitter's proper prefixes lie before it; they go along, as the range's paths begin with them."""
    bounds, shorter = _bounds(vocab.to_pylist() if splitters.get(lang) else [], splitters.get(lang, []))
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)
    for r in range(len(cuts) - 1):
        at = np.arange(cuts[r], cuts[r + 1])
        if r and shorter[r - 1]:
            at = np.concatenate([_among(keys, np.array(shorter[r - 1], np.uint64)), at])
        if len(at):
            yield lang, r, _piece(vocab, keys[at], counts[at], None if extra is None else extra[:, at])


def _piece(vocab: pa.Array, keys: np.ndarray, counts: np.ndarray, extra: np.ndarray | None) -> bytes:
    used, own = np.unique(np.concatenate([ca.word_at(keys, k) for k in range(3)]), return_inverse=True)
    if used[0] == 0:
        used, own = used[1:], own
    else:
        own = own + 1
    one, two, three = own.reshape(3, -1)
    near = ca.packed(one, two, three)
    more, sums = ca.with_prefixes(near, counts)
    if extra is not None:
        wide = np.zeros((len(extra), len(more)), np.int64)
        wide[:, np.searchsorted(more, near)] = extra
    near, counts = more, sums
    automaton = ca.CountTransducer().add(near, counts).finish()
    words = vocab.take(pa.array(used - 1))
    lengths = pc.binary_length(words).to_numpy()
    raw = b"".join(words.to_pylist())
    arrays = automaton.arrays()
    if extra is not None:
        size = (ca.word_at(near, 1) > 0).astype(int) + (ca.word_at(near, 2) > 0)
        order = np.argsort(size, kind="stable")             # as ``paths`` lists them
        arrays += list(wide[:, order])
    head = ca.to_bytes([lengths])
    return len(head).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + head + raw + ca.to_bytes(arrays)


def _unpiece(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, n-grams, counts and further numbers of an automaton's bytes."""
    head, raw = int.from_bytes(body[:8], "little"), int.from_bytes(body[8:16], "little")
    lengths = ca.from_bytes(body[16:16 + head])[0]
    arrays = ca.from_bytes(body, 16 + head + raw)
    keys, counts = ca.CountTransducer.from_arrays(arrays[:10]).paths()
    words = _binary(lengths, np.frombuffer(body, np.uint8, raw, 16 + head))
    return words, keys, counts, np.stack(arrays[10:]) if len(arrays) > 10 else np.zeros((0, len(keys)), np.int64)


def _splitters(sample: list[tuple[str, Key, float]], times: float) -> Splitters:
    """Range starts by language, one for every ``RANGE_ENTRIES`` n-grams (``times``: n-grams for a weight of one)."""
    by: dict[str, list[tuple[Key, float]]] = {}
    for lang, key, weight in sample:
        by.setdefault(lang, []).append((key, weight * times))
    entries = max(RANGE_ENTRIES, sum(w for v in by.values() for _, w in v) / MOST_RANGES)
    out = {}
    for lang, found in by.items():
        found.sort()
        total = np.cumsum([w for _, w in found])
        n = ceil(total[-1] / entries)
        starts = np.searchsorted(total, total[-1] * np.arange(1, n) / n)
        out[lang] = sorted({found[s][0] for s in starts})
    return out


def _sampled(lang: str, vocab: pa.Array, keys: np.ndarray) -> Iterator[tuple[str, list[bytes], float]]:
    at = np.unique(np.linspace(0, len(keys) - 1, min(-(-len(keys) // SAMPLE_EVERY), SAMPLE_KEYS)).astype(np.int64))
    for key in key_words(vocab, keys[at]):
        yield lang, list(key), len(keys) / len(at)


SAMPLE = "lang string, words array<binary>, weight double"


def _sample_batch(rows: list[tuple[str, list[bytes], float]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.binary())), pa.array(cols[2], pa.float64())],
                                      names=["lang", "words", "weight"])


def _collected(sample: DataFrame, times: float) -> Splitters:
    return _splitters([(r.lang, tuple(map(bytes, r.words)), r.weight) for r in sample.collect()], times)


# --- counting --------------------------------------------------------------------------------

def _piece_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                      names=["lang", "range", "body"])


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def text_splitters(docs: DataFrame) -> Splitters:
    """Range starts from the n-grams of about ``SAMPLE_DOCS`` documents."""
    n = docs.count()
    if not n:
        return {}
    share = min(1.0, SAMPLE_DOCS / n)

    def run(batches):
        rows: list = []
        for lang, vocab, keys, _ in block_ngrams(batches):
            rows += _sampled(lang, vocab, keys)
        yield _sample_batch(rows)

    return _collected(_text(docs).sample(share, seed=13).mapInArrow(run, SAMPLE), 1 / share)


def _united(rows: DataFrame, out: str, emit) -> DataFrame:
    """``emit(lang, range, words, n-grams, counts, extra)`` over the united automata of every (lang, range)."""
    def run(batches):
        at, parts, size = None, [], 0

        def unite(parts):
            if len(parts) == 1:
                return parts
            words, keys, counts = ca.union([p[:3] for p in parts])
            if not parts[0][3].size:
                return [(words, keys, counts, np.zeros((0, len(keys)), np.int64))]
            wide = []
            for k in range(len(parts[0][3])):           # each n-gram has its further numbers in one part, zeros elsewhere
                wide.append(ca.union([(w, g, x[k]) for w, g, _, x in parts])[2])
            return [(words, keys, counts, np.stack(wide))]

        def done():
            words, keys, counts, extra = unite(parts)[0]
            order = np.argsort(keys)
            yield from emit(*at, words, keys[order], counts[order], extra[:, order])

        for batch in batches:
            for lang, number, body in zip(batch.column("lang").to_pylist(), batch.column("range").to_pylist(), batch.column("body"), strict=True):
                if at is not None and at != (lang, number):
                    yield from done()
                    parts, size = [], 0
                at = lang, number
                parts.append(_unpiece(body.as_py()))
                size += len(parts[-1][1])
                if size > UNITE_ENTRIES:
                    parts = unite(parts)
                    size = len(parts[0][1])
        if at is not None:
            yield from done()

    return rows.repartition(F.col("lang"), F.col("range")).sortWithinPartitions("lang", "range").mapInArrow(run, out)


def _own(words: pa.Array, keys: np.ndarray, splitters: Splitters, lang: str, number: int) -> np.ndarray:
    """Which n-grams belong to a range: all but the splitter's proper prefixes, which came along."""
    out = np.ones(len(keys), bool)
    split = splitters.get(lang, [])
    if number:
        ids = {w: i + 1 for i, w in enumerate(words.to_pylist())} if len(split[number - 1]) > 1 else {}
        key = [ids.get(w, 0) for w in split[number - 1]]
        for n in range(1, len(key)):
            if all(key[:n]):
                out &= keys != ca.packed(*key[:n])
    return out


COUNTS = "lang string, w1 string, w2 string, w3 string, a long, l1 long, l2 long, n long"


def _texts(words: pa.Array, ids: np.ndarray) -> pa.Array:
    return words.cast(pa.large_string()).take(pa.array(ids - 1, mask=ids == 0)).cast(pa.string())


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``COUNTS``: n-grams of ``min_count`` or more, with the counts of their first one and two words; rows without
    words hold the number of word occurrences of one range in ``n``."""
    splitters = text_splitters(docs)

    def cut(batches):
        for lang, vocab, keys, counts in block_ngrams(batches):
            rows, size = [], 0
            for piece in pieces(lang, vocab, keys, counts, splitters):
                rows.append(piece)
                size += len(piece[2])
                if size > STEP_BYTES:
                    yield _piece_batch(rows)
                    rows, size = [], 0
            yield _piece_batch(rows)

    def emit(lang, number, words, keys, counts, _):
        own = _own(words, keys, splitters, lang, number)
        n = int(counts[own & (ca.word_at(keys, 1) == 0)].sum())
        at = np.flatnonzero(own & (counts >= min_count))
        k = keys[at]
        places = [ca.word_at(k, p) for p in range(3)]
        l1 = np.where(places[1] > 0, ca.prefix_weight(keys, counts, k, 1), 0)
        l2 = np.where(places[2] > 0, ca.prefix_weight(keys, counts, k, 2), 0)
        cols = [pa.concat_arrays([_texts(words, p), pa.nulls(1, pa.string())]) for p in places]
        numbers = [pa.array(np.append(x, 0)) for x in (counts[at], l1, l2)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), *cols, *numbers, pa.array(np.append(np.zeros(len(at), np.int64), n))],
                                         names=[c.split()[0] for c in COUNTS.split(", ")])

    return _united(_text(docs).mapInArrow(cut, PIECE), COUNTS, emit)


# --- scoring ---------------------------------------------------------------------------------

def score(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """floor(SCALE * a * a / (left * right)), exact: in 64 bits where they suffice, else in Python integers."""
    if len(a) and max(int(a.max()) ** 2 * SCALE, int(left.max()) * int(right.max())) < 1 << 63:
        return SCALE * a * a // (left * right)
    big = [SCALE * int(x) * int(x) // (int(y) * int(z)) for x, y, z in zip(a, left, right, strict=True)]
    return np.array(big, np.int64)


SCORED = "kind string, lang string, phrase string, a long, l long, r long, score long"


def _reversed_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, list[pa.Array], np.ndarray]]:
    """(lang, the three word columns last word first, numbers a, l1, l2) of the batch's phrases, by language."""
    batch = batch.filter(pc.is_valid(batch.column("w1")))
    langs = batch.column("lang").dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        mine = batch.filter(pc.equal(langs.indices, k))
        w1, w2, w3 = (mine.column(c) for c in ("w1", "w2", "w3"))
        two, three = pc.is_valid(w2), pc.is_valid(w3)
        first = pc.if_else(three, w3, pc.if_else(two, w2, w1))
        second = pc.if_else(three, w2, pc.if_else(two, w1, pa.scalar(None, pa.string())))
        third = pc.if_else(three, w1, pa.scalar(None, pa.string()))
        yield lang, [first, second, third], np.stack([mine.column(c).to_numpy() for c in ("a", "l1", "l2")])


def _sorted_block(words: list[pa.Array], numbers: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Vocabulary, sorted n-grams and their numbers of three word columns (null: no word)."""
    plain = [w.cast(pa.large_binary()) for w in words]
    vocab, ids = ca.vocabulary([w.drop_null() for w in plain])
    place = []
    for w, own in zip(plain, ids, strict=True):
        full = np.zeros(len(w), np.int64)
        full[w.is_valid().to_numpy(zero_copy_only=False)] = own + 1
        place.append(full)
    keys = ca.packed(*place)
    order = np.argsort(keys)
    return vocab, keys[order], numbers[:, order]


def scored_phrases(counts: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``SCORED``: candidates (kind ``phrase``) with their lowest-scoring cut, and the pairs that a triple drops (kind ``drop``).

    ``counts`` is a written ``phrase_counts`` table."""
    n = counts.count()
    share = min(1.0, SAMPLE_DOCS * 25 / max(n, 1))

    def sample(batches):
        rows: list = []
        for batch in batches:
            for lang, words, numbers in _reversed_rows(batch):
                vocab, keys, _ = _sorted_block(words, numbers)
                rows += [(lang, list(k), 1.0) for k in key_words(vocab, keys)]
        yield _sample_batch(rows)

    splitters = _collected(counts.sample(share, seed=13).mapInArrow(sample, SAMPLE), 1 / share)

    def cut(batches):
        for batch in batches:
            for lang, words, numbers in _reversed_rows(batch):
                vocab, keys, own = _sorted_block(words, numbers)
                yield _piece_batch(list(pieces(lang, vocab, keys, own[0], splitters, own[1:])))

    def emit(lang, number, words, keys, f, extra):
        own = _own(words, keys, splitters, lang, number) & (f > 0)
        last, middle, first = (ca.word_at(keys, p) for p in range(3))
        two, three = np.flatnonzero(own & (middle > 0) & (first == 0)), np.flatnonzero(own & (first > 0))
        names = [c.split()[0] for c in SCORED.split(", ")]

        def rows(kind, phrase, *numbers):
            fixed = [pa.array([x] * len(phrase), pa.string()) for x in (kind, lang)]
            return pa.RecordBatch.from_arrays([*fixed, phrase, *(pa.array(x, pa.int64()) for x in numbers)], names=names)

        def phrase(*ids):
            return pc.binary_join_element_wise(*(_texts(words, i) for i in ids), " ")

        if len(two):
            a, left, right = f[two], extra[0, two], ca.prefix_weight(keys, f, keys[two], 1)
            yield rows("phrase", phrase(middle[two], last[two]), a, left, right, score(a, left, right))
        if len(three):
            a, k3 = f[three], keys[three]
            left, right = extra[:, three], [ca.prefix_weight(keys, f, k3, 2), ca.prefix_weight(keys, f, k3, 1)]
            cuts = [score(a, left[k], right[k]) for k in range(2)]
            later = cuts[1] < cuts[0]
            chosen = [np.where(later, x[1], x[0]) for x in (left, right, cuts)]
            yield rows("phrase", phrase(first[three], middle[three], last[three]), a, *chosen)
            none = np.zeros(len(three), np.int64)
            for whole, ids in ((left[1], (first, middle)), (right[0], (middle, last))):
                hit = np.flatnonzero(100 * a >= inside_percent * whole)
                yield rows("drop", phrase(*(i[three][hit] for i in ids)), *[none[hit]] * 4)

    return _united(counts.mapInArrow(cut, PIECE), SCORED, emit)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases."""
    counts = written(phrase_counts(docs, min_count), "phrase-counts")
    sizes = hinted(written(counts.where("w1 IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes"))
    scored = written(scored_phrases(counts, inside_percent), "phrase-scores")
    dropped = scored.where("kind = 'drop'").select("lang", "phrase")
    kept = scored.where("kind = 'phrase'").drop("kind").join(dropped, ["lang", "phrase"], "left_anti")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    slices = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    first = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
