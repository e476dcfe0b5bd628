import random
import re
from hashlib import sha256

import numpy as np

from triptopics.llm import crf, pii


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1]))) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    find = lambda p: re.finditer(p, text)
    return {
        "email": [m.span() for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")],
        "ip": [m.span() for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in find(r"[0-9]([\x20-]?[0-9])+") if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 8 <= len(digits(m)) <= 15]}


def test_base_patterns_on_noise():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice("a1.@-+ ()5 29.@%_é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + " @ " + "1" * 300_000 + "+1" * 1000)["email"] == []


def test_viterbi_and_gradient_against_all_paths():
    rng = np.random.default_rng(0)
    tags = ("O", "B-x", "I-x")
    step, start = crf.allowed_steps(tags)
    model = crf.Model(tags, {f"f{k}": k for k in range(5)}, rng.normal(size=(5, 3)), step + rng.normal(size=(3, 3)), start)
    seqs = [[[f"f{rng.integers(0, 6)}"] for _ in range(n)] for n in (1, 4, 0, 6, 4)]
    for seq, path in zip(seqs, model.decode(seqs), strict=True):
        if not seq:
            assert not len(path)
            continue
        e = model.emissions(seq)
        best = max(np.ndindex(*[3] * len(seq)), key=lambda p: model.start[p[0]] + sum(e[t, k] for t, k in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(path) == best


def test_held_out_accuracy(spark):
    model = pii.trained(pii.labelled_examples(spark))
    hit = total = wrong = 0
    for text, kind, a, b in pii.labelled_examples(spark, copies=3, seed=99).collect():
        toks = pii.tokens_of(text, 0, len(text))
        got = list(pii.tagged(toks, model.decode([pii.features(text, toks)])[0]))
        total += kind != ""
        hit += (kind, a, b) in got
        wrong += sum(g != (kind, a, b) for g in got)
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_added_spans_keep_base_spans(spark, edge_docs, edge, no_docs):
    rows = {r.doc_id: r for r in pii.personal_data(edge_docs).collect()}
    for d, t, *_ in edge:
        if d is None:
            continue
        base = plain(t or "")
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert rows[d].base_sha256 == sha256(text.encode()).hexdigest()
        assert {s for s in text.split(",") if s} <= set(rows[d].spans.split(","))
        if not re.search("[0-9@]", t or ""):
            assert rows[d].spans == ""
    assert (rows[17].n_email, rows[17].n_ip, rows[17].n_phone) == (1, 1, 1)
    assert pii.personal_data(no_docs).count() == 0


def test_redaction(edge_docs):
    clean = pii.redacted(edge_docs)
    assert clean.columns == edge_docs.columns and clean.count() == edge_docs.count()
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows[17].startswith("Mail [EMAIL] or [PHONE], [IP].") and rows[4] is None and rows[5] == ""


def test_the_field_finds_other_spellings(spark):
    model = pii.trained(pii.labelled_examples(spark))
    text = "call (555) 123-4567 today"
    assert pii.added_spans(model, [text], [pii.base_spans(text)])[0]["phone"] == [(5, 19)]
