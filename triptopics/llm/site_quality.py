"""Quality by hierarchical empirical Bayes: a document classifier under site and path posteriors.

A logistic model over hashed words and text shape is fitted to a bounded sample of labelled rows
(good: quality 1 and not toxic).  Its probability is a document's own evidence.  Documents are then
summed up by site (``source``) and by path within the site (``source`` and ``lang``), a label
counting for its document and the classifier's probability for the others.  Each site's good rate is
shrunk to the corpus rate, each path's to its site's, with beta priors whose strengths come from the
spread of the rates, so sparse sites keep close to the level above.  The path's posterior replaces
the corpus prior in the document's odds; a document is kept if the result is at least ``KEEP``.

Null text is the empty text; a null source or lang is a site or path of its own; several labels of one
doc_id are averaged, null labels left out; a doc_id that is null has no label; without any label the
evidence is neutral and all are kept; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U, hinted, row_blocks, text_view, word_hashes, written
from .quality_rules import beta_prior

TRAIN_ROWS = 40_000
WORD_BITS = 18
MIN_SHARE = 0.002
SHAPES, BINS = 6, 12
KEEP = 0.5
MAX_STRENGTH = 1e6

_SITE = "source", "lang"
_ASCII = np.arange(256)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_PLAIN = np.where(_LETTER | _DIGIT, _ASCII, 32).astype(np.uint8)


def document_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the rows ``off`` delimits in ``data``, and where each row's begin: distinct hashed words
    (letters and digits, lower case) and one bin of each of ``SHAPES`` text shapes."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    block = data[off[0]:off[-1]]
    o = off - off[0]

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask[block])])
        return (c[o[1:]] - c[o[:-1]]) / size

    h, row = word_hashes(_PLAIN[block], o, lower=True)
    word = (h >> U(64 - WORD_BITS)).astype(np.int64)
    words = np.bincount(row, minlength=n)
    pair = np.unique((row.astype(np.int64) << WORD_BITS) | word)
    distinct = np.bincount(pair >> WORD_BITS, minlength=n)
    shapes = (share(_LETTER), share(_UPPER), share(_DIGIT), share(SPACE), distinct / np.maximum(words, 1), np.log2(words + 1) / 16)
    binned = [(1 << WORD_BITS) + k * BINS + np.minimum(BINS - 1, (s * BINS).astype(np.int64)) for k, s in enumerate(shapes)]
    rows = np.concatenate([pair >> WORD_BITS, *([np.arange(n)] * SHAPES)])
    ids = np.concatenate([pair & ((1 << WORD_BITS) - 1), *binned])
    order = np.argsort(rows, kind="stable")
    start = np.zeros(n + 1, np.int64)
    np.cumsum(distinct + SHAPES, out=start[1:])
    return ids[order], start


@dataclass
class Evidence:
    """A fitted document classifier: weights, and the good rate of its training rows."""
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[ids])])
        return self.bias + total[start[1:]] - total[start[:-1]]


def fit(features: list[np.ndarray], good: np.ndarray, epochs: int = 20, batch: int = 128, rate: float = 0.1, decay: float = 1e-4) -> Evidence:
    """Logistic regression by AdaGrad over shuffled batches; a feature of under ``MIN_SHARE`` of the rows (or 5) keeps weight 0."""
    size = (1 << WORD_BITS) + SHAPES * BINS
    frequent = np.bincount(np.concatenate(features), minlength=size) >= max(5, MIN_SHARE * len(good))
    features = [f[frequent[f]] for f in features]
    w, g2 = np.zeros(size), np.full(size, 1e-2)
    prior = float(np.clip(good.mean(), 0.01, 0.99))
    bias, b2 = float(np.log(prior / (1 - prior))), 1e-2
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(good))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            part = [features[r] for r in rows]
            ids, n = np.concatenate(part), np.array([len(p) for p in part])
            total = np.concatenate([[0.0], np.cumsum(w[ids])])
            end = np.cumsum(n)
            s = bias + total[end] - total[end - n]
            over = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - good[rows]) / len(rows)
            at, inverse = np.unique(ids, return_inverse=True)
            g = np.bincount(inverse, np.repeat(over, n), minlength=len(at)) + decay * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            b2 += over.sum() ** 2
            bias -= rate * over.sum() / np.sqrt(b2)
    return Evidence(w, bias, prior)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good (0 to 1): label rows averaged by doc_id; toxic documents are not good."""
    good = F.when(F.col("quality").isNotNull(), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("double"))
    return labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")).groupBy("doc_id").agg(
        F.avg("good").alias("good")).where("good IS NOT NULL")


def train(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS) -> Evidence | None:
    """Fit to at most ``rows`` labelled documents, those with the least hashes of their doc_id."""
    sample = written(known.where("good IN (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "site-sample")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(hinted(sample), "doc_id")

    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("text"))
            for i, j in row_blocks(off):
                ids, start = document_features(data, off[i:j + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("good").slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "good", "ids"])

    got = texts.mapInArrow(run, "doc_id long, good double, ids array<int>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    if not len(got):
        return None
    return fit([x.values.to_numpy() for x in got.column("ids").combine_chunks()], got.column("good").to_numpy())


def evidence(docs: DataFrame, model: Evidence | None) -> DataFrame:
    """doc_id, source, lang and log_odds: each document's odds of being good, in units of the training rows' odds."""
    base = float(np.log(model.prior / (1 - model.prior))) if model else 0.0

    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("text"))
            for i, j in row_blocks(off):
                s = np.zeros(j - i)
                if model:
                    s = np.clip(model.score(*document_features(data, off[i:j + 1])), -30, 30) - base
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", *_SITE)), pa.array(s)],
                                                 names=["doc_id", *_SITE, "log_odds"])

    return docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in _SITE), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, source string, lang string, log_odds double")


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def site_posteriors(judged: DataFrame, prior: float) -> DataFrame:
    """source, lang, site_rate, path_rate from the rows' ``good`` shares, shrunk level by level."""
    paths = written(judged.groupBy(*_SITE).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("good").alias("n_failed")), "site-paths")
    sites = written(paths.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_failed").alias("n_failed")), "site-sites")
    mean, strength = beta_prior(sites)
    mean = min(max(mean or prior, 0.01), 0.99)
    rate = lambda level, k: (F.col("n_failed") + F.lit(k) * level) / (F.col("n_docs") + F.lit(k))
    sites = sites.select("source", rate(F.lit(mean), strength).alias("site_rate"))
    both = written(paths.alias("p").join(hinted(written(sites, "site-rates")).alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
                   .select("p.source", "lang", "n_docs", "n_failed", "site_rate"), "site-both")
    own = path_strength(both)
    return both.select(*_SITE, "site_rate", rate(F.col("site_rate"), own).alias("path_rate"))


def path_strength(both: DataFrame) -> float:
    """Pseudo-documents of the paths' prior: how far path rates spread around their sites' beyond chance (moments)."""
    m = F.col("site_rate")
    off = F.col("n_failed") / F.col("n_docs") - m
    spread, chance, noise = both.agg(
        F.sum(F.col("n_docs") * off * off), F.sum(m * (1 - m)), F.sum(F.col("n_docs") * m * (1 - m))).first()
    if not noise or noise <= chance:
        return MAX_STRENGTH
    return 1 / min(0.5, max(1 / (1 + MAX_STRENGTH), (spread - chance) / (noise - chance))) - 1


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_document (the classifier alone), site_rate, path_rate, p_good and kept of every document."""
    known = written(labelled(labels), "site-labels")
    model = train(docs, known)
    prior = model.prior if model else 0.5
    base = float(np.log(prior / (1 - prior)))
    alone = _chance(F.col("log_odds") + F.lit(base))
    judged = written(evidence(docs, model).join(known, "doc_id", "left").select(
        "doc_id", *_SITE, "log_odds", alone.alias("p_document"), F.coalesce("good", alone).alias("good")), "site-judged")
    levels = hinted(written(site_posteriors(judged, prior), "site-levels"))
    placed = judged.alias("d").join(levels.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & F.col("d.lang").eqNullSafe(F.col("l.lang")), "left")
    bounded = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("path_rate")))
    return placed.select(
        "doc_id", F.round("p_document", 6).alias("p_document"), F.round("site_rate", 6).alias("site_rate"), F.round("path_rate", 6).alias("path_rate"),
        F.round(_chance(F.col("log_odds") + _odds(bounded)), 6).alias("p_good")).withColumn("kept", F.col("p_good") >= KEEP)
