import hashlib
import random

import numpy as np
import pytest

from triptopics.llm import suffix_dedup, suffix_sort


def brute(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        cover = [False] * len(t)
        for p in range(len(t) - length + 1):
            if t[p:p + length] in seen:
                cover[p:p + length] = [True] * length
            else:
                seen.add(t[p:p + length])
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        kept = bytes(x for x, c in zip(t, cover, strict=True) if not c)
        out[d] = (len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("alphabet", [2, 256])
def test_sort(alphabet):
    rng = np.random.default_rng(alphabet)
    rows = rng.integers(0, alphabet, (900, 60)).astype(np.uint8)
    rows[:500] = rows[0]
    for r in range(0, 500, 2):
        rows[r, rng.integers(0, 60)] = 1
    order = suffix_sort.deep_shallow_sort(rows)
    strings = [rows[r].tobytes() for r in order]
    assert strings == sorted(strings) and sorted(order) == list(range(900))
    lcp = suffix_sort.neighbour_lcp(rows, order)
    for a, b, n in zip(strings, strings[1:], lcp[1:], strict=False):
        assert a[:n] == b[:n] and (n == 60 or a[n] != b[n])


@pytest.mark.parametrize("hot", [20_000, 0])
def test_against_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    text = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    shared = [text(n) for n in (90, 100, 101, 150, 400)]
    docs = [(7 * d, "".join(rng.choice([text(rng.randint(0, 200)), rng.choice(shared), "a" * rng.randint(50, 300), "ab" * rng.randint(30, 120)])
                            for _ in range(rng.randint(0, 5)))) for d in range(60)]
    docs += [(5000, docs[3][1]), (5001, docs[3][1]), (5002, ""), (5003, "a" * 3000)]
    got = suffix_dedup.kept_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute([(d, t.encode()) for d, t in docs])
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_pieces_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(3)
    text = np.tile(rng.integers(97, 110, 700), 3).astype(np.uint8)
    whole = suffix_dedup.anchors(text, np.array([0, len(text)]))
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    cut = suffix_dedup.anchors(text, np.array([0, len(text)]))

    def windows(rows):
        return {(p, a) for a, lo, hi in zip(*rows[1:4], strict=True) for p in range(lo, hi + 1)}

    assert windows(cut) == windows(whole) and {p for p, _ in windows(cut)} == set(range(len(text) - 99))


def test_edges(edge_docs, edge, no_docs):
    got = suffix_dedup.kept_bytes(edge_docs).collect()
    want = brute([(d, (t or "").encode()) for d, t, *_ in edge if d is not None])
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert [(r.n_removed, r.n_spans) for r in got if r.doc_id is None] == [(0, 0)] * 2
    assert suffix_dedup.kept_bytes(no_docs).count() == 0


def test_repeated_rows_are_not_earlier_than_each_other(spark):
    rows = [(1, "x" + "abcdefghij" * 3 + str(k % 1) * 90) for k in range(2)]
    got = suffix_dedup.kept_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got[0] == got[1]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_one_id_with_several_texts(spark, monkeypatch, hot):
    """Texts of one id are judged each for itself against smaller ids; repeated rows alike."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    text = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n))
    shared = [text(n) for n in (100, 130, 300)]
    rows = [(d, text(rng.randint(0, 150)) + rng.choice(shared) + text(rng.randint(0, 60)) + rng.choice(["", *shared])) for d in (1, 2, 2, 2, 5, 5, 9) for _ in range(2)]
    a, b = text(820), text(820)
    rows += [(20, a), (21, a), (21, b), (21, b), (22, b), (22, a + b)]
    got = suffix_dedup.kept_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for d, t in rows:
        raw, seen = t.encode(), set()
        for e, other in rows:
            if e < d:
                seen |= {other.encode()[p:p + 100] for p in range(len(other.encode()) - 99)}
        cover = [False] * len(raw)
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                cover[p:p + 100] = [True] * 100
            seen.add(raw[p:p + 100])
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        want.append((d, len(raw), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(raw, cover, strict=True) if not c)).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)
