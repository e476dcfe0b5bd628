"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact confirmation.

A document's set holds its distinct 5-word shingles (lower-cased; with fewer words the whole
sequence is one shingle).  Equal sets are collapsed first, so copies cost one row.  The MinHash
samples of a set are used twice: the first ``BANDS`` groups of ``ROWS`` name its buckets, and all
samples are folded into an odd sketch, a bitmap of parities.  The XOR of two sketches has few bits
exactly when the sets are similar, so candidate pairs with too many are dropped before their full
sets are compared.

No bucket is expanded into all pairs.  Each member is first compared with its bucket's centre, the
member that shares the most buckets with others; the confirmed links join most of a group into one
component.  Where members of a bucket then lie in several components, those outside the largest one
are compared with the members of the others (sketches and set sizes first, and each pair in one of
its common buckets only), so a link that the comparisons with centres cannot see is found here.

Null and empty texts (and texts of white space) have empty sets and are linked with nothing;
repeated rows of one doc_id stand for the same document and get a row each; a null doc_id is linked
with nothing and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, hinted, mix, row_blocks, shingles, text_view, without, word_hashes, written
from .components import components

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = 1024
SKETCH_BITS = 4096
#: Of 4096 bits, sets of similarity 0.75 differ in 453 on average, with a standard deviation of about 25; 564 is 4.5 of these more.
SKETCH_MAX = 564

_rng = np.random.default_rng(75)
_XOR = _rng.integers(0, 2 ** 32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 2 ** 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_BAND = _rng.integers(1, 2 ** 63, (ROWS, BANDS), dtype=np.uint64) | U(1)
_FOLD = _rng.integers(1, 2 ** 63, SAMPLES, dtype=np.uint64) | U(1)

SKETCHED = "doc_id long, n_shingles long, set0 long, set1 long, bands array<long>, odd array<long>"


def shingle_sets(batch: pa.RecordBatch, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, flat sorted distinct shingles, start of each row's) by blocks of rows."""
    data, off = text_view(batch.column("text"))
    for i, j in row_blocks(off):
        h, row = word_hashes(data, off[i:j + 1], lower=True)
        sh, row = shingles(h, row, j - i, width)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        sets = [np.unique(sh[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        start = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=start[1:])
        yield i, j, np.concatenate(sets) if sets else np.zeros(0, U), start


def minhash(flat: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """MinHash samples of the non-empty ``rows``: minima of one 32-bit hash per sample."""
    x = (flat >> U(32)).astype(np.uint32)
    begin = start[:-1][rows]
    out = np.empty((len(rows), SAMPLES), np.uint32)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], begin)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of each row's samples, as 64-bit words."""
    at = (mix(samples.astype(U) + _FOLD) % U(SKETCH_BITS)).astype(np.int64)
    n = len(samples)
    flat = (at + np.arange(n)[:, None] * SKETCH_BITS).ravel()
    bits = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).reshape(n, SKETCH_BITS // 64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    s = samples[:, :BANDS * ROWS].astype(U).reshape(len(samples), BANDS, ROWS)
    return mix(mix((s * _BAND.T[None]).sum(axis=2, dtype=U)) + np.arange(1, BANDS + 1, dtype=U)).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """``SKETCHED``: set size, 128-bit digest of the set, band keys and odd sketch of every text."""
    def run(batches):
        for batch in batches:
            for i, j, flat, start in shingle_sets(batch):
                size = np.diff(start)
                rows = np.flatnonzero(size)
                bands, odd = np.zeros((0, BANDS), np.int64), np.zeros((0, SKETCH_BITS // 64), np.int64)
                digest = np.zeros((j - i, 2), np.int64)
                if len(rows):
                    samples = minhash(flat, start, rows)
                    bands, odd = band_keys(samples), odd_sketch(samples)
                    digest[rows] = np.frombuffer(b"".join(
                        blake2b(flat[start[r]:start[r + 1]].tobytes(), digest_size=16).digest() for r in rows), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(size), pa.array(np.ascontiguousarray(digest[:, 0])),
                     pa.array(np.ascontiguousarray(digest[:, 1])), _lists(bands, size > 0), _lists(odd, size > 0)],
                    names=["doc_id", "n_shingles", "set0", "set1", "bands", "odd"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCHED)


def _lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
    off = np.zeros(len(has) + 1, np.int32)
    np.cumsum(has * values.shape[1], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.ravel()))


def _alike(x: str, y: str) -> Column:
    """Odd sketches and set sizes of aliases ``x`` and ``y`` allow the similarity."""
    differ = reduce(lambda a, b: a + b, (
        F.bit_count(F.col(f"{x}.odd")[k].bitwiseXOR(F.col(f"{y}.odd")[k])) for k in range(SKETCH_BITS // 64)))
    return (differ <= SKETCH_MAX) & (100 * F.least(f"{x}.n_shingles", f"{y}.n_shingles") >= PERCENT * F.greatest(f"{x}.n_shingles", f"{y}.n_shingles"))


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= ``PERCENT`` * union."""
    def run(batches):
        for batch in batches:
            for i, j, flat, start in shingle_sets(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.view(np.int64)))],
                    names=["doc_id", "s"])

    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-ids")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(hinted(ids), "doc_id", "left_semi")
    sets = written(text.dropDuplicates(["doc_id"]).mapInArrow(run, "doc_id long, s array<long>"), "near-sets")
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    sig = written(sketch(docs), "near-sketch")
    known = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    firsts = written(known.groupBy("set0", "set1", "n_shingles").agg(F.min("doc_id").alias("rep")), "near-firsts")
    reps = written(known.join(hinted(firsts.select("rep")), F.col("doc_id") == F.col("rep"), "left_semi")
                   .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "odd"), "near-reps")

    entries = reps.select("rep", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(entries.join(shared, "key").select("key", "rep"), "near-members")
    star = written(_plausible(_with_centres(members), reps), "near-star")
    links = written(confirmed(docs, star), "near-links")
    crossing = _crossing(_open_rows(members, links), reps).join(star, ["a", "b"], "left_anti")
    more = written(confirmed(docs, written(crossing, "near-crossing")), "near-more")
    joined = components(links.union(more))

    group = sig.alias("d").join(firsts, ["set0", "set1", "n_shingles"], "left")
    found = group.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, rep, component, largest: the members of every bucket that holds more than one component so far."""
    label = components(links).withColumnRenamed("id", "rep")
    placed = written(members.join(label, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "near-placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return written(placed.join(mixed.select("key", "largest"), "key"), "near-open")


def _ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _with_centres(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of each member with its bucket's centre: the member of the most buckets, the smallest of several."""
    typical = members.join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "rep")
    centres = typical.groupBy("key").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("centre"))
    return members.join(centres, "key").where("rep <> centre").select(*_ordered("rep", "centre")).distinct()


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sketches and sizes allow the similarity."""
    x, y = (reps.select(F.col("rep").alias(k), "n_shingles", "odd").alias(t) for k, t in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_alike("x", "y")).select("a", "b")


def _crossing(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Plausible pairs (a < b) within a bucket whose members lie in different components."""
    rows = written(rows.join(reps, "rep"), "near-open-sketch")
    x, y = rows.where("component <> largest").alias("x"), rows.alias("y")
    differ = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.largest")) | (F.col("x.rep") < F.col("y.rep")))
    here = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & differ & _alike("x", "y") & here).select(*_ordered("x.rep", "y.rep"))


def keep_first_of_group(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: the smallest doc_id of each component stays (rows of a null doc_id stay)."""
    return without(docs, near_duplicates(docs).where(~F.col("kept")), "near-dropped")
