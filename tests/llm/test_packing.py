import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from triptopics.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def test_cached_ids_equal_the_tokenizers(tokenizer):
    import random

    enc = packing.CachedEncoder(packing.vocabulary(), parts=50)
    rng = random.Random(1)
    texts = [" a", "a  b", "a \n b", "a\n \nb", "a   b ", "  ", "\n", "it's they'll'S 12 3a", "<|endoftext|> a <|endoftext|>b", "a\x1c b", "x" * 900, "word. word, word! " * 20]
    texts += ["".join(rng.choice(["a", "b", "'s", " ", " ", "\n", "\t", "1", "é", "!", "<|endoftext|>", "\u00a0", "\u3000", "\x85", "中"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_round_trip(edge_docs, edge, tokenizer):
    pieces = packing.pack(edge_docs).collect()
    streams = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in edge)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    last = max(sequences)
    for s, parts in sequences.items():
        parts.sort(key=lambda p: p.offset)
        ends = [p.offset + p.length for p in parts]
        assert [p.offset for p in parts] == [0, *ends[:-1]]
        assert ends[-1] == packing.WINDOW or s == last
    assert sum(p.length for p in pieces) == sum(map(len, streams)) and set(sequences) == set(range(last + 1))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for d, t, *_ in edge:
        if d is None:
            continue
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[d], key=lambda p: p.start)
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        assert sum(p.length for p in parts) == len(ids) == parts[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) for p in parts)


def test_empty(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_remembered_parts_are_bounded_by_the_callers_number(tokenizer):
    import corpus_pipeline

    small, large = packing._encoder(None, 40), packing._encoder(None, packing.CACHE_PARTS)
    assert small is not large and packing._encoder(None, 40) is small
    text = " ".join(f"w{k}" for k in range(300))
    for _ in range(3):
        assert small.encode(text) == large.encode(text)
    assert len(small.recent) + len(small.older) <= 40 < len(large.recent) + len(large.older)
    assert corpus_pipeline.PACKING_PARTS <= packing.CACHE_PARTS // 2


def test_new_parts_of_a_text_are_merged_in_one_call():
    enc = packing.CachedEncoder(packing.vocabulary())
    calls, merge = [], enc.merge
    enc.merge = lambda t: calls.append(t) or merge(t)
    for text in ("Zorbit qan-tel x\ny café, 12,5 你好 fin. " * 2 + "end", "end of Zorbit, qan-tel's <b> z"):
        calls.clear()
        want = np.array([*enc.whole.encode(text, add_special_tokens=False).ids, packing.END_ID], enc.dtype).tobytes()
        assert enc.encode(text) == want
        assert len(calls) <= 2
