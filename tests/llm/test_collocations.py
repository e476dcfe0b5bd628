import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus_rows import make_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from triptopics.llm import collocations as co
from triptopics.llm import count_automata as ca

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    """lang -> counts of all n-grams of one to three words."""
    out = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in (1, 2, 3):
                out["und" if lang is None else lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return out


def plain(rows, min_count=10, top=2000):
    out = []
    for lang, f in plain_counts(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        dropped = {g[i:i + 2] for g, c in cand.items() if len(g) == 3 for i in (0, 1) if 100 * c >= 50 * f[g[i:i + 2]]}
        best = []
        for g, a in cand.items():
            if g not in dropped:
                s, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                best.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        best.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(best[:top])]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeABé中'-") for _ in range(rng.randint(1, 5))) for _ in range(vocabulary)]
    weight = [1 / (i + 1) for i in range(vocabulary)]
    text = lambda: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "\x0b", "\x85"])
                           for w in rng.choices(words, weight, k=rng.randint(0, 150)))
    return [(text(), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(n)]


def frame(spark, rows):
    return make_docs(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)])


@pytest.fixture
def small(monkeypatch):
    """Blocks, steps and ranges so small that every text crosses them."""
    monkeypatch.setattr(co, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(co, "STEP_BYTES", 64)
    monkeypatch.setattr(co, "RANGE_ENTRIES", 150)
    monkeypatch.setattr(co, "UNITE_ENTRIES", 500)
    monkeypatch.setattr(co, "SAMPLE_EVERY", 3)


def local_blocks(rows, size=50):
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[i:i + size]], pa.string()), pa.array([k for _, k in rows[i:i + size]], pa.string())],
                                          names=["text", "lang"]) for i in range(0, len(rows), size)]
    out = defaultdict(Counter)
    for lang, vocab, keys, counts in co.block_ngrams(batches):
        assert (keys[1:] > keys[:-1]).all()
        for g, c in zip(co.key_words(vocab, keys), counts.tolist(), strict=True):
            out[lang][tuple(x.decode() for x in g)] += c
    return out


def test_block_counts_equal_plain_counts(small):
    rows = corpus(1, 120) + [("x y " * 400 + "z. " + "x y " * 90, "en"), ("a" * 1000, "fr"), (None, "en"), ("", None), (" \t", "en")]
    want = {k: v for k, v in plain_counts(rows).items() if v}
    assert local_blocks(rows) == want


def test_block_counts_without_small_blocks():
    rows = corpus(2, 200)
    assert local_blocks(rows) == {k: v for k, v in plain_counts(rows).items() if v}


grams = st.dictionaries(st.lists(st.integers(1, 6), min_size=1, max_size=3).map(tuple), st.integers(1, 4), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(grams, st.lists(st.integers(0, 200), max_size=5))
def test_transducer_round_trip_in_any_steps(counts, cuts):
    keys = np.array(sorted(ca.packed(*g).item() for g in counts), np.uint64)
    by = {ca.packed(*g).item(): c for g, c in counts.items()}
    values = np.array([by[k] for k in keys.tolist()], np.int64)
    keys, values = ca.with_prefixes(keys, values)
    t = ca.CountTransducer()
    at = sorted({min(c, len(keys)) for c in cuts} | {0, len(keys)})
    for i, j in zip(at[:-1], at[1:], strict=True):
        t.add(keys[i:j], values[i:j])
    read = ca.CountTransducer.from_arrays(ca.from_bytes(ca.to_bytes(t.finish().arrays())))
    k, v = read.paths()
    assert dict(zip(k.tolist(), v.tolist(), strict=True)) == dict(zip(keys.tolist(), values.tolist(), strict=True))


def test_equal_states_are_shared():
    keys = np.unique(np.concatenate([ca.packed(i, j, k) for i in range(1, 30) for j in range(1, 4) for k in ([1, 2], [1, 2])]))
    keys, counts = ca.with_prefixes(keys, np.ones(len(keys), np.int64))
    t = ca.CountTransducer()
    for s in range(0, len(keys), 7):
        t.add(keys[s:s + 7], counts[s:s + 7])
    assert t.finish().n_states() == 3           # the root, one state after any word, one after any pair


def test_a_hash_clash_shares_nothing(monkeypatch):
    monkeypatch.setattr(ca, "mix", lambda x: x * ca.U(0))
    keys = np.array(sorted(ca.packed(i, j, k).item() for i in range(1, 5) for j in range(1, 4) for k in range(1, 1 + i)), np.uint64)
    keys, counts = ca.with_prefixes(keys, np.arange(len(keys)))
    k, v = ca.CountTransducer().add(keys, counts).finish().paths()
    assert dict(zip(k.tolist(), v.tolist(), strict=True)) == dict(zip(keys.tolist(), counts.tolist(), strict=True))


def test_scores_beyond_64_bits():
    a = np.array([2 ** 40 + 7, 12], np.int64)
    left, right = a + np.array([2 ** 41, 3]), a + np.array([2 ** 39, 5])
    assert co.score(a, left, right).tolist() == [10 ** 6 * int(x) ** 2 // (int(y) * int(z)) for x, y, z in zip(a, left, right, strict=True)]


def test_result_equals_plain_form(spark, small):
    rows = corpus(3, 260) + [("hot word " * 300, "en"), (None, None), ("", "en"), ("New York City! " * 12, "en")]
    want = plain(rows)
    assert len(want) > 50 and got(co.collocations(frame(spark, rows).repartition(5))) == want


def test_one_range_equals_plain_form(spark):
    rows = corpus(4, 150)
    assert got(co.collocations(frame(spark, rows).repartition(3))) == plain(rows)


def test_top_and_repeated_rows(spark):
    rows = corpus(5, 60) * 3
    assert got(co.collocations(frame(spark, rows), top=7)) == plain(rows, top=7)


def test_empty_and_edge(spark, no_docs, edge_docs, edge):
    assert got(co.collocations(no_docs)) == []
    assert got(co.collocations(edge_docs)) == plain([(t, lang) for _, t, lang, _ in edge])
