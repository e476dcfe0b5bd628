import random
import re

from corpus_rows import make_docs

from triptopics.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    found = set()
    seen = {}
    for i, t in items:
        if i is not None and len(words(t)) >= decontaminate.MIN_WORDS:
            key = tuple(words(t))
            seen[key] = min(i, seen.get(key, i))
    for d, t in docs:
        w = words(t)
        for b, i in seen.items():
            span = min(len(b), decontaminate.WINDOW)
            allowed = decontaminate.SUBSTITUTIONS if len(b) >= decontaminate.WINDOW else 0
            if d is not None and any(sum(x != y for x, y in zip(w[p:p + span], b[q:q + span], strict=True)) <= allowed
                                     for q in range(len(b) - span + 1) for p in range(len(w) - span + 1)):
                found.add((d, i))
    return found


def test_masks_are_lossless():
    assert decontaminate.lossless()
    assert not decontaminate.lossless(masks=decontaminate.MASKS[:1])


def test_against_every_alignment(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(60)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate((30, 20, 13, 12, 9, 7, 40, 15))]
    items += [(50, items[0][1].upper()), (51, None), (None, " ".join(prose(20))), (52, "")]
    docs = []
    for d in range(80):
        body = prose(rng.randint(0, 60))
        source = words(items[rng.randrange(8)][1])
        cut = source[rng.randint(0, 3):rng.randint(len(source) - 3, len(source))]
        for _ in range(rng.randint(0, 5)):
            cut[rng.randrange(len(cut))] = "other"
        at = rng.randint(0, len(body))
        docs.append((d, ", ".join(body[:at] + cut + body[at:])))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[0][1]), (502, items[0][1]), (503, "v1 " * 5000)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and (502, 0) in want


def test_empty_tables_and_filter(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the one benchmark passage that nobody wrote anywhere else in these texts at all")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(edge_docs, none).count() == 0
    assert decontaminate.without_contaminated(edge_docs, items).count() == edge_docs.count()


def test_one_word_100_000_times(spark):
    """Every position of a repetitive text is a hit; none of them carries the text."""
    import time

    rows = [(1, "spam " * 100_000, "en", "a"), (2, "spam " * 12, "en", "a"), (3, "ham spam " * 200, "en", "a")]
    items = spark.createDataFrame([(7, "spam " * 30)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.first_word, r.n_windows, r.substitutions) for r in decontaminate.contaminated(make_docs(spark, rows), items).collect()}
    n, w = 100_000, 30
    total = sum(max(0, min(w, n - s) - max(0, -s) - 12) for s in range(-w, n))
    assert got == {1: (0, total, 0)} and time.time() - began < 100
