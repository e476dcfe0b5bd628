"""Helpers shared by the operators: shared-folder tables, checked broadcasts, Arrow text views and word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BROADCAST_ROWS = 500_000
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 22
ROW_GROUP_BYTES = 32 << 20       # a writing task holds one row group in memory
U = np.uint64


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` below ``spark.checkpoint.dir`` (shared by the cluster) and read it again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow, already written ``df`` of at most ``rows`` rows; a larger one joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; a null doc_id stays, and so do all columns in their order."""
    found = hinted(written(ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), name))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.join(found, "doc_id", "left_anti").select(columns)


# --- Arrow views -----------------------------------------------------------------------------

def text_view(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without copying; null is the empty text."""
    arr = pc.fill_null(col, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, width)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def binary_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary column without nulls."""
    width = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def row_blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes each, or of a single longer row."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of the intervals as maximal runs: start, end, start, end, ..."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])[:len(start)]
    first = np.flatnonzero(new)
    return np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], axis=1).ravel()


# --- hashing ---------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse for i < n, modulo 2**64 (kept for the largest block seen)."""
    if not _POW or _POW[0][0].size < n:
        size = 1 << max(20, int(n).bit_length())
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        _POW[0] = (out[0], out[1])
    return _POW[0][0][:n], _POW[0][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (shift, multiply by odd constants)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """P with P[e] - P[s] = sum of table[byte] * base**position over [s, e)."""
    p, _ = powers(len(data))
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(table[data] * p, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of each byte span [start, end)."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


def _block_words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    first[len(data)] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.append(word[1:], False)
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    h = span_hash(prefix_hash(data, _BYTE_LOWER if lower else _BYTE), start, end)
    return h, np.searchsorted(off, start, "right") - 1


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text cut before whitespace into pieces of about ``PIECE_BYTES``."""
    i = 0
    while i < len(data):
        j = min(len(data), i + PIECE_BYTES)
        if j < len(data):
            rest = np.flatnonzero(SPACE[data[j:j + PIECE_BYTES]])
            while not len(rest) and j < len(data):
                j = min(len(data), j + PIECE_BYTES)
                rest = np.flatnonzero(SPACE[data[j:j + PIECE_BYTES]])
            j = min(len(data), j + (int(rest[0]) if len(rest) else 0))
        yield data[i:j]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every word ``[^\\x20\\x09-\\x0D]+`` of the rows ``off`` delimits in ``data``
    (``lower``: A-Z taken as a-z)."""
    lo = off[0]
    if off[-1] - lo <= 2 * PIECE_BYTES or len(off) > 2:
        return _block_words(data[lo:off[-1]], off - lo, lower)
    parts = [_block_words(p, np.array([0, len(p)]), lower)[0] for p in _pieces(data[lo:off[-1]])]
    h = np.concatenate(parts)
    return h, np.zeros(len(h), np.int64)


_STEP = _RNG.integers(1, 2 ** 63, 64, dtype=np.uint64) | U(1)


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``width``-word shingle; a row with fewer words has one shingle of all its words."""
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=n_rows)
    acc = np.zeros(max(0, len(h) - width + 1), U)
    for k in range(width):
        acc += h[k:k + len(acc)] * _STEP[k]
    full = row[:len(acc)] == row[width - 1:] if len(acc) else np.zeros(0, bool)
    out, rows = mix(acc[full]), row[:len(acc)][full]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(row, short)
        extra = np.array([np.sum(h[b:b + c] * _STEP[:c], dtype=U) + U(c) for b, c in zip(begin, count[short], strict=True)], U)
        out, rows = np.concatenate([out, mix(mix(extra))]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows
