"""Per-document quality rules and host-level verdicts, in DataFrame functions only.

Base rules judge each document alone.  A host (the ``source`` column) is then judged by its
failures as a whole: its failure rate is shrunk towards the corpus rate with a beta prior whose
strength comes from the spread of the hosts' rates (moments), so a host of a few documents is never
condemned by them alone.  Documents of a host whose shrunk rate is over ``max_rate`` go too.

Null text has no words (and fails); documents without a source form one host; a repeated row is
counted as often as it occurs; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, without, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
MAX_STRENGTH = 1e6
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base measures of every whole text.

    Repeated 3-word windows are found by sorting each text's windows: a window is repeated if a
    neighbour is equal; the words covered are summed over the gaps between repeated positions."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = text.select("doc_id", "source", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")
    windows = F.transform(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.struct(F.concat(x, F.lit(" "), F.get("w", i + 1), F.lit(" "), F.get("w", i + 2)).alias("g"), i.alias("p")))
    sized = words.select(
        "doc_id", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.array_sort(windows).alias("g"))
    same = lambda x, i, k: F.coalesce(F.get("g", i + k)["g"] == x["g"], F.lit(False))
    placed = sized.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(F.transform(F.filter("g", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["p"])).alias("p"))
    covered = _sum(F.transform("p", lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get("p", i - 1))).cast("long")))
    return placed.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed(min_words: int = MIN_WORDS, repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """source, n_docs, n_failed, host_rate: failure rates shrunk with the hosts' own beta prior.

    The prior's two numbers (mean and strength) are aggregates over the hosts and come to the driver."""
    hosts = written(judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "quality-hosts")
    mean, strength = beta_prior(hosts)
    return hosts.select("source", "n_docs", "n_failed", (
        (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))).alias("host_rate"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength (pseudo-documents) of the beta distribution of the hosts' failure rates, by moments."""
    n, f = hosts.agg(F.sum("n_docs"), F.sum("n_failed")).first()
    if not n or f in (0, n):
        return (f or 0) / (n or 1), MAX_STRENGTH
    mean = f / n
    share, rate = F.col("n_docs") / F.lit(n), F.col("n_failed") / F.col("n_docs")
    s, c, d = hosts.agg(F.sum(share * (rate - mean) * (rate - mean)), F.sum(share * (1 - share)),
                        F.sum(share * (1 - share) / F.col("n_docs"))).first()
    rho = (s - mean * (1 - mean) * d) / (mean * (1 - mean) * (c - d)) if c > d else 0.0
    return mean, 1 / min(0.5, max(1 / (1 + MAX_STRENGTH), rho)) - 1


def quality_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The base measures, base_failed, host_rate and kept of every document."""
    judged = written(measures(docs).withColumn("base_failed", base_failed()), "quality-measures")
    hosts = hinted(host_rates(judged))
    return judged.alias("d").join(hosts.alias("h"), F.col("d.source").eqNullSafe(F.col("h.source")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"), F.col("d.source").alias("host"), F.round("host_rate", 6).alias("host_rate"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents (rows of one doc_id stand or fall together; a null doc_id stays)."""
    return without(docs, quality_verdicts(docs).where(~F.col("kept")), "quality-rejected")
