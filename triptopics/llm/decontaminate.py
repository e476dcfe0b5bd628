"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A document is contaminated by a benchmark item if some aligned window of ``WINDOW`` words of both
differs in at most ``SUBSTITUTIONS`` words (words: runs of letters and digits, lower-cased).  The
seeds are masks that look at some positions of a stretch and ignore the others; the masks below are
lossless: wherever the substitutions fall in a window, at least one mask fits between them (shown by
enumeration in the tests).  Hashes of the masked words of documents and items are joined, and each
alignment (document, item, shift) that a hit proposes is verified word by word.

Items of ``MIN_WORDS`` to ``WINDOW`` - 1 words must occur whole, without substitutions; shorter ones
are no evidence and never match.  Items of equal words are one item, named by the smallest id.
Null texts have no words; rows without a doc_id are not judged (they cannot be named); rows that
repeat a doc_id are one document, contaminated if any of them is; empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, without, written

WINDOW = 13
SUBSTITUTIONS = 3
MIN_WORDS = 8
MASKS = ((0, 2, 3, 5, 6), (0, 3, 4, 5, 8), (0, 1, 3, 9, 10))
SEED_BROADCAST_ROWS = 1_000_000


def _words(df: DataFrame, key: str) -> DataFrame:
    """key, w: hashes of the words of each text, in order."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")
    return df.select(F.col(key).cast("long").alias(key), F.transform(words, lambda x: F.xxhash64(x)).alias("w"))


def _seeds(words: DataFrame, keep: list[str], masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """keep, at, seed: one row per word position and mask that fits behind it."""
    at = words.select(*keep, "w", F.posexplode("w").alias("at", "_first"))

    def seed(m: int, mask: tuple[int, ...]) -> Column:
        whole = F.col("at") + mask[-1] < F.size("w")
        return F.when(whole, F.xxhash64(F.lit(m), F.col("_first"), *(F.get("w", F.col("at") + k) for k in mask[1:])))

    rows = at.select(*keep, "at", F.explode(F.array(*(seed(m, mask) for m, mask in enumerate(masks)))).alias("seed"))
    return rows.where(F.col("seed").isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word (of the earliest matching window), n_windows (matching windows over all
    alignments) and substitutions (of the best one), a row for each contaminated document and item."""
    words = _words(docs, "doc_id").where(F.col("doc_id").isNotNull())
    items = written(_words(benchmark, "item_id").where((F.size("w") >= MIN_WORDS) & F.col("item_id").isNotNull())
                    .groupBy("w").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("w")), "bench-items")
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most five lengths
    masks = (*MASKS, *(tuple(range(n)) for n in short))

    seeds = written(_seeds(items, ["item_id"], masks).select("item_id", F.col("at").alias("item_at"), "seed"), "bench-seeds")
    hits = (_seeds(words, ["doc_id"], masks).join(hinted(seeds, SEED_BROADCAST_ROWS), "seed")
            .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    hits = written(hits, "bench-hits")

    named = written(hits.select("doc_id").distinct(), "bench-docs")
    texts = words.join(hinted(named), "doc_id", "left_semi").withColumnRenamed("w", "d")
    small_items = hinted(items.withColumnRenamed("w", "b"), 20_000)
    listed = hits.join(small_items.select("item_id", "n"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "n")).alias("hits"))
    return _verified(_aligned(texts.join(listed, "doc_id")).join(small_items, "item_id"))


def _aligned(texts: DataFrame) -> DataFrame:
    """doc_id, item_id, shift, lo and p: the words of the document that an alignment sets against the item's from ``lo`` on.

    A document meets its hits in one row and gives each its few words, so no hit carries the whole text."""
    def part(h: Column) -> Column:
        lo = F.greatest(F.lit(0), -h["shift"])
        hi = F.least(h["n"], F.size("d") - h["shift"])
        return F.struct(h["item_id"].alias("item_id"), h["shift"].alias("shift"), lo.alias("lo"),
                        F.slice("d", lo + h["shift"] + 1, F.greatest(hi - lo, F.lit(0))).alias("p"))

    return texts.select("doc_id", F.explode(F.transform("hits", part)).alias("x")).select("doc_id", "x.*")


def _verified(aligned: DataFrame) -> DataFrame:
    """Matching windows of each alignment (p: words of the document against b from ``lo`` on; shift: position in the document less that in b)."""
    span = F.least(F.col("n"), F.lit(WINDOW))
    allowed = F.when(F.col("n") < WINDOW, 0).otherwise(SUBSTITUTIONS)
    differ = F.transform("p", lambda x, k: (x != F.get("b", k + F.col("lo"))).cast("int"))
    marked = aligned.where(F.size("p") >= span).select("doc_id", "item_id", (F.col("lo") + F.col("shift")).alias("from"), span.alias("span"),
                                                       allowed.alias("allowed"), differ.alias("x"))
    # fewer equal words than a window needs: no window can match
    marked = marked.where(F.aggregate("x", F.lit(0), lambda a, v: a + 1 - v) >= F.col("span") - F.col("allowed"))
    sums = F.transform(F.sequence(F.lit(0), F.greatest(F.size("x") - F.col("span"), F.lit(0))),
                       lambda o: F.aggregate(F.slice("x", o + 1, F.col("span")), F.lit(0), lambda a, v: a + v))
    windows = marked.select("doc_id", "item_id", "from", "allowed", sums.alias("s"))
    good = F.filter("s", lambda v: v <= F.col("allowed"))
    first = F.array_position(F.transform("s", lambda v: v <= F.col("allowed")), True).cast("int") - 1
    found = windows.where(F.size(good) > 0).select(
        "doc_id", "item_id", (F.col("from") + first).alias("first"), F.size(good).alias("n"), F.array_min("s").alias("best"))
    return found.groupBy("doc_id", "item_id").agg(
        F.min("first").cast("long").alias("first_word"), F.sum("n").cast("long").alias("n_windows"), F.min("best").cast("long").alias("substitutions"))


def lossless(masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> bool:
    """Whether some mask fits between any ``substitutions`` positions of a window."""
    from itertools import combinations

    places = [{o + k for k in m} for m in masks for o in range(window - m[-1])]
    return all(any(not p & {*bad} for p in places) for bad in combinations(range(window), substitutions))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    return without(docs, contaminated(docs, benchmark), "bench-found")
