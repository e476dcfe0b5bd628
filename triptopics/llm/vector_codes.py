"""Vector codes: product quantisation with exact nearest entries by slice-and-intersect bitmasks.

A vector's integer components are cut into ``PARTS`` equal parts, each coded by the nearest entry of
that part's codebook.  For every dimension of a part the entries are sorted by their coordinate, and
place k of the sorted list carries a mask (uint64 words) of the k entries before it.  The entries
within a radius of a point in one dimension are then the exclusive-or of two such masks, and the AND
over all dimensions leaves the entries within the cube of that radius.

The first radius is the typical distance between neighbouring entries.  An empty cube widens it by half;
a cube whose best entry lies beyond the radius is looked up once more with that entry's distance as
radius, and that cube holds every entry at least as near.  Entries of the narrower cubes are masked out,
so each candidate is measured once.  So the nearest entry is exact, ties going to
the lower index, whatever the radius begins with.

Training reads the vectors once a round: tasks add up their parts by entry, and a grouped sum of one
number per entry and component (bounded by the codebooks' size) comes to the driver.

Vectors that are null or hold null or non-finite components are dropped, and so are empty ones and
those whose length is not the commonest (of lengths that ``PARTS`` divides; ties: the shortest), which
cannot be cut like the others.  A component of 2**27 / 1024 or more in size is an error: squared
distances and sums would leave 64 bits.  Null ids come last when the first entries are taken, ties of ids go by
the components; repeated rows count as often as they occur; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 27
BLOCK_ROWS = 4096
PAIRS = 1 << 18
INT = np.int64


class SliceIndex:
    """Exact nearest entries of one codebook part (``entries``: whole numbers, one row each)."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, INT)
        n, width = self.entries.shape
        self.words = (n + 63) // 64
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.coords = np.ascontiguousarray(np.take_along_axis(self.entries, order, axis=0).T)
        own = np.zeros((n, self.words), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.masks = np.zeros((width, n + 1, self.words), np.uint64)
        for d in range(width):
            self.masks[d, 1:] = np.bitwise_or.accumulate(own[order[:, d]], axis=0)
        self.radius = self._typical_radius()

    def _typical_radius(self) -> int:
        """Median over the entries of the largest coordinate difference to the nearest other entry."""
        n = len(self.entries)
        near = [np.delete(np.abs(self.entries - e).max(axis=1), i).min() for i, e in enumerate(self.entries)] if n > 1 else [1]
        return max(1, int(np.median(near)))

    def cube(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each point in every dimension."""
        out = np.full((len(points), self.words), ~np.uint64(0))
        for d, coords in enumerate(self.coords):
            lo = np.searchsorted(coords, points[:, d] - radius, "left")
            hi = np.searchsorted(coords, points[:, d] + radius, "right")
            out &= self.masks[d][hi] ^ self.masks[d][lo]
        return out

    def _best(self, points: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points with a candidate, their nearest one (ties: the lowest index) and its squared distance."""
        bits = np.unpackbits(np.ascontiguousarray(masks).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        if not len(row):
            return row, entry, row
        dist = np.empty(len(row), INT)
        for s in range(0, len(row), PAIRS):
            diff = points[row[s:s + PAIRS]] - self.entries[entry[s:s + PAIRS]]
            dist[s:s + PAIRS] = np.einsum("ij,ij->i", diff, diff)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(dist, first)
        hit = np.flatnonzero(dist == np.repeat(least, np.diff(np.append(first, len(row)))))
        at = hit[np.searchsorted(hit, first)]
        return row[first], entry[at], least

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each point."""
        code, dist = np.full(len(points), len(self.entries)), np.full(len(points), np.iinfo(INT).max)
        radius = np.full(len(points), self.radius, INT)
        seen = np.zeros((len(points), self.words), np.uint64)
        todo = np.arange(len(points))
        while len(todo):
            r = radius[todo]
            masks = self.cube(points[todo], r)
            row, entry, d = self._best(points[todo], masks & ~seen[todo])       # each candidate is measured once
            seen[todo] = masks
            at = todo[row]
            nearer = (d < dist[at]) | ((d == dist[at]) & (entry < code[at]))
            code[at[nearer]], dist[at[nearer]] = entry[nearer], d[nearer]
            best = dist[todo]
            empty = best == np.iinfo(INT).max
            root = np.sqrt(np.where(empty, 0, best)).astype(INT) + 1
            far = ~empty & (root > r) & (best > r * r)
            radius[todo[far]] = root[far]
            radius[todo[empty]] = r[empty] + (r[empty] + 1) // 2
            todo = todo[far | empty]
        return code, dist


@dataclass
class Codebooks:
    """Entries by part, entry and position within the part."""

    entries: np.ndarray

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> np.ndarray:
        """The components that ``code`` stands for."""
        return np.concatenate([self.entries[p, k] for p, k in enumerate(bytes.fromhex(code))])

    def nearest(self, vectors: np.ndarray, indexes: list[SliceIndex]) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances (rows x parts)."""
        width = self.entries.shape[2]
        found = [index.nearest(vectors[:, p * width:(p + 1) * width]) for p, index in enumerate(indexes)]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def indexes(self) -> list[SliceIndex]:
        return [SliceIndex(e) for e in self.entries]


def _vectors(batch: pa.RecordBatch, width: int):
    """Blocks of the batch's vectors as (first row, rows x width)."""
    col = batch.column("v")
    values = col.flatten().to_numpy(zero_copy_only=False).astype(INT).reshape(-1, width)
    for s in range(0, len(values), BLOCK_ROWS):
        yield s, values[s:s + BLOCK_ROWS]


def integer_vectors(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, v (whole components) of the kept vectors, written once, and their length."""
    usable = F.col("embedding").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    checked = F.when(F.exists(whole, lambda x: F.abs(x) >= LARGEST), F.raise_error(F.lit(f"a component is {LARGEST // SCALE} or more in size"))).otherwise(
        F.transform(whole, lambda x: x.cast("int")))
    kept = written(vectors.where(F.coalesce(usable, F.lit(False))).select("vec_id", "label", checked.alias("v")), "vector-integers")
    size = (kept.groupBy(F.size("v").alias("size")).count().where(f"size > 0 AND size % {parts} = 0")
            .orderBy(F.desc("count"), "size").first())
    if size is None:
        return kept.where(F.lit(False)), 0
    return kept.where(F.size("v") == size["size"]), size["size"]


def train(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``kept`` vectors (``integer_vectors``) after ``rounds`` rounds from the ``entries`` least ids."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = size // parts
    start = np.array([r.v for r in first], INT).reshape(len(first), parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _improved(kept, books)
    return books


def _improved(kept: DataFrame, books: Codebooks) -> Codebooks:
    parts, n, width = books.entries.shape

    def run(batches):
        indexes = books.indexes()
        total = np.zeros((parts, n, width + 1), INT)
        for batch in batches:
            for _, vectors in _vectors(batch, parts * width):
                codes, _ = books.nearest(vectors, indexes)
                for p in range(parts):
                    np.add.at(total[p, :, 0], codes[:, p], 1)
                    np.add.at(total[p, :, 1:], codes[:, p], vectors[:, p * width:(p + 1) * width])
        used = np.flatnonzero(np.repeat(total[:, :, 0].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], names=["k", "x"])

    sums = kept.select("v").mapInArrow(run, "k long, x long").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(parts * n * (width + 1), INT)
    total[sums["k"].to_numpy(INT)] = sums["x"].to_numpy(INT)
    total = total.reshape(parts, n, width + 1)
    count = total[:, :, :1]
    return Codebooks(np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books.entries))


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code, error of every vector of ``kept``."""
    parts, _, width = books.entries.shape

    def run(batches):
        indexes = books.indexes()
        for batch in batches:
            for s, vectors in _vectors(batch, parts * width):
                codes, dist = books.nearest(vectors, indexes)
                text = codes.astype(np.uint8).tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").slice(s, len(vectors)), batch.column("label").slice(s, len(vectors)),
                     pa.array([text[i:i + step] for i in range(0, len(text), step)], pa.string()), pa.array(dist.sum(axis=1))],
                    names=["vec_id", "label", "code", "error"])

    types = dict(kept.dtypes)
    return kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    kept, size = integer_vectors(vectors, parts)
    if not size:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = train(kept, size, parts, entries, rounds)
    coded = written(encode(kept, books), "vector-codes")
    labels = hinted(written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels"))
    return coded.alias("c").join(labels.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
