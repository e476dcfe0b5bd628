import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triptopics.llm import licenses, quality_rules, site_quality, urls
from triptopics.session import table

SF = "/root/testdata/sf0.01"


# --- quality rules ---------------------------------------------------------------------------

def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i:i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(edge_docs, edge, no_docs):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measures(edge_docs).collect())
    assert got == sorted((str(d), *measured(t)) for d, t, *_ in edge)
    assert quality_rules.quality_verdicts(no_docs).count() == 0


def test_hosts_are_shrunk(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, "short", "bad") for k in range(60)] + [(100 + k, good, "bad") for k in range(4)]
    rows += [(200, "short", "tiny")] + [(1000 + k, good, f"s{k % 5}") for k in range(300)] + [(2000, good, "tiny"), (2001, good, None)]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[100 + k].kept for k in range(4)) and not got[100].base_failed
    assert got[2000].kept and got[2001].kept and got[2000].host_rate < 0.5


def test_keep_good(edge_docs):
    kept = quality_rules.keep_good(edge_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge_docs.columns and 4 not in ids and 10 not in ids and 1 in ids and ids.count(None) == 2


# --- urls ------------------------------------------------------------------------------------

def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHARD_KEYS", 700)
    monkeypatch.setattr(urls, "BITS_PER_KEY", 3)
    keys = spark.range(6000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    cascades = urls.build(keys)
    assert len(cascades) == 2 and all(len(levels) > 2 for levels in cascades)
    judged = urls.listed_by_cascade(keys, "key", cascades, "found")
    assert judged.where("found <> listed").count() == 0


def test_rules_and_odd_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x"), (2, "https://net/"), (3, "https://x.net"), (4, "https://example.net/fr/?a#b"), (5, None), (6, "no scheme"), (7, "a://b.org/fr/1?x"),
            (8, "x://y://example.com/de/"), (9, "ftp://notexample.com/de/"), (10, "http://q.example.com/de/#z"), (11, ""), (11, "")]
    got = {r.page_id: r for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2].rule == "net/" and got[3].rule is None and got[3].path == "" and got[4].verdict == "block" and got[4].path == "/fr/"
    assert (got[5].host, got[5].path, got[5].verdict) == ("", "", "allow") and got[6].host == "" and got[7].rule == "org/fr/"
    assert got[8].host == "y:" and got[9].rule is None and got[10].rule == "example.com/de/"
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- licences --------------------------------------------------------------------------------

def test_listing_loses_no_size():
    for size in range(1, 60):
        listed = set(licenses.matching_sizes(size))
        assert listed == {u for u in range(1, 400) if 200 * min(u, size) >= licenses.DICE_PERCENT * (u + size)}


def test_licenses(spark, edge_docs, no_docs):
    rows = [(1, "x y\nReleased under the MIT license\nmore"), (2, "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files"),
            (3, None), (4, "All rights"), (5, "ALL RIGHTS RESERVED\nAll rights reserved."), (None, "All rights reserved.")]
    got = {(r.doc_id, r.license): r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT-notice"), (5, "ARR")}
    assert got[1, "MIT"].first_unit == 2 and got[2, "MIT-notice"].first_unit == 0 and got[5, "ARR"].n_units == 3    # both lines and the whole
    assert [r.doc_id for r in licenses.licenses(edge_docs).collect()] == [16]
    assert licenses.licenses(no_docs).count() == 0


def test_wrapped_and_embedded_notices(spark):
    """Notices wrapped over lines of a longer text or standing among other words, against every window of words."""
    prose = "".join(f"note{k} of the page{k} stands here\n" for k in range(40))
    bsd = "Redistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n"
    gpl = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation.\n")
    inc = "Copyright 2020 Example Inc. All rights reserved."
    mit = "This page is released under the MIT License and may be shared."
    rows = [(1, prose + bsd + prose), (2, prose + gpl + prose), (3, f"{prose}{inc}\n{prose}"), (4, prose + mit), (5, prose), (6, mit),
            (7, f"{prose}{inc}\nAll rights reserved.\n{prose}{inc} {inc}"), (8, prose + bsd.replace("with or without", "with and without") + prose + gpl)]

    def slow(text):
        words, out = re.findall(r"[^\W_]+", text.lower()), {}
        b = [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]
        for name, grams in licenses.template_bigrams().items():
            sizes = [2 * len(g & set(grams)) / (len(g) + len(grams)) for i in range(len(b)) for n in range(1, 2 * len(grams)) if (g := set(b[i:i + n]))]
            if max(sizes) >= licenses.DICE_PERCENT / 100:
                out[name] = max(sizes)
        return out

    got = {(r.doc_id, r.license): r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(d, name): x for d, t in rows for name, x in slow(t).items()}
    assert {k: round(r.dice, 9) for k, r in got.items()} == {k: round(x, 9) for k, x in want.items()}
    assert {k[0] for k in got} == {1, 2, 3, 4, 6, 7, 8}
    assert got[1, "BSD"].first_unit == 41 and got[2, "GPL-notice"].n_units == 1 and got[3, "ARR"].first_unit == 41
    assert (got[7, "ARR"].n_units, got[7, "ARR"].first_unit) == (4, 41)


# --- site quality ----------------------------------------------------------------------------

def test_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    known = labels.where("doc_id % 4 <> 0")
    got = site_quality.quality(docs, known).join(labels.where("doc_id % 4 = 0"), "doc_id")
    r = got.agg(F.avg((F.col("kept") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("double")), F.count(F.lit(1))).first()
    assert r[0] > 0.9 and r[1] > 500


def test_sparse_sites_follow_the_corpus(spark):
    rows = [(f"s{k % 4}", "en", 1.0 if k % 10 else 0.0) for k in range(400)] + [("tiny", "en", 0.0), (None, None, 1.0)] + [("bad", "en", 0.0)] * 200
    got = {r.source: r for r in site_quality.site_posteriors(spark.createDataFrame(rows, "source string, lang string, good double"), 0.5).collect()}
    assert got["bad"].site_rate < 0.1 < 0.2 < got["tiny"].site_rate and got["s0"].site_rate > 0.75
    assert all(0 <= r.path_rate <= 1 for r in got.values())


def test_edges_of_site_quality(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, None), (4, None, 1), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = site_quality.quality(edge_docs, none).collect()
    assert len(rows) == edge_docs.count() and all(r.kept for r in rows)
    assert site_quality.quality(edge_docs, some).count() == edge_docs.count()
    assert site_quality.quality(no_docs, some).count() == 0


def test_features_of_odd_texts():
    data = np.frombuffer(b"Ab ab 12!", np.uint8)
    ids, start = site_quality.document_features(data, np.array([0, 0, 9, 9]))
    assert start.tolist() == [0, 6, 14, 20] and len(ids) == 20


@pytest.mark.parametrize("good", [0.0, 1.0])
def test_one_class_does_not_break_the_fit(good):
    model = site_quality.fit([np.array([1, 2])] * 20, np.full(20, good))
    assert np.isfinite(model.score(np.array([1, 2]), np.array([0, 2]))).all()
