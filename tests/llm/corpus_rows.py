"""Rows of documents the operator tests share."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, w string, rep string, key string, `a.b` string"


def make_docs(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    full = [(d, t, lang, src, None if t is None else len(t), "x", "y", "z", "k", "d") for d, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    """Null, empty, blank, tiny, repeated, long and odd texts; null ids and sources."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    swapped = base.split()
    swapped[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(swapped), "en", "b"), (4, None, "en", "a"), (5, "", None, None),
        (6, " \t\n ", "fr", "b"), (7, "one", "fr", "b"), (8, "One", "fr", "b"), (9, prose(8000), "de", "c"), (10, "spam " * 300, "de", "c"),
        (11, passage + "\n" + prose(40), "en", "c"), (12, prose(30) + " " + passage, "en", "c"), (13, "\n".join(["same line here"] * 9), "en", "a"),
        (14, "a" * 5000, "en", None), (15, "Ünïcödé " * 40 + "中文 text", "xx", "d"), (None, prose(70), "en", "a"), (None, base, None, None),
        (16, "All rights reserved.\n" + prose(80), "en", "d"), (17, "Mail a.b@x.org or +1 (555) 123-4567, 10.0.0.1.\n" + prose(90), "en", "d"),
    ]
    return rows + [(20 + k, prose(60 + k), "en", f"h{k % 3}") for k in range(12)]
