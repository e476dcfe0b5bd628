"""Exact substring dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Every 100-byte window of a text has an anchor, the place in it whose ``GRAM``-byte string has the least
hash.  Equal windows have their anchor at the same offset, so only windows whose anchors start with
the same bytes need comparing, and about one place in 35 is an anchor.

1. Each anchor is a row: hash of its gram, hash of the whole stretch of windows it stands for, doc_id
   and place.  Grams that occur once drop out after a grouped count.
2. Among the rest an equal stretch in an earlier document removes the whole stretch; each distinct
   stretch is left once.
3. Where distinct stretches share a gram (the ends of repeated passages), their contexts are fetched
   and suffix-sorted: forwards from the anchor and backwards before it, by multikey quicksort to a
   shallow depth and blind tries below it (``suffix_sort``).  Common prefixes of neighbours say for
   each offset which windows are equal; all but the earliest are removed.
   A gram shared by more than ``HOT`` distinct stretches is never brought together in one task: its
   windows are grouped by their hashes instead, which sums up on the map side.

"Earlier" is a smaller doc_id, or an earlier start in the same document; the input is judged, not
what is left.  Null text is the empty text; rows without a doc_id are neither judged nor compared
and keep all bytes; of rows that repeat a doc_id none is earlier than the other, and those of different texts
are judged each for itself (``version`` is a hash of the row's text); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _least
from .common import U, merged, mix, powers, prefix_hash, row_blocks, span_hash, text_view, written
from .suffix_sort import deep_shallow_sort, neighbour_lcp

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM           # offsets of an anchor in its windows: 0 to REACH
PIECE = 1 << 22
HOT = 20_000
GROUP_ROWS = 50_000
BROADCAST_RUNS = 1_000_000

BYTE_TABLE = np.random.default_rng(100).integers(1, 2 ** 63, 256, dtype=np.uint64)
_PLACE_BITS = 28                # a piece's places; the other bits of a ranked value hold its hash


def _piece_anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, anchor, first and last window start, gram hash and stretch hash of the anchors of a block of rows."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, U) for _ in range(2))
    prefix = prefix_hash(data)
    end = np.repeat(off[1:], np.diff(off))
    at = np.arange(n)
    gram = np.zeros(n, U)
    gram[:n - GRAM + 1] = span_hash(prefix, at[:n - GRAM + 1], at[GRAM - 1:] + 1)
    low = U((1 << _PLACE_BITS) - 1)
    ranked = np.where(at + GRAM <= end, (gram & ~low) | at.astype(U), ~U(0))
    least = _least(ranked, REACH + 1)
    starts = np.flatnonzero(at[:len(least)] + LENGTH <= end[:len(least)])
    anchor = (least[starts] & low).astype(np.int64)
    row = np.searchsorted(off, starts, "right") - 1
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))[:len(starts)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    a, lo, hi = anchor[first], starts[first], starts[last]
    return row[first], a, lo, hi, gram[a], span_hash(prefix, lo, hi + LENGTH)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_piece_anchors``, with places counted from each row's begin; a very long text goes piece by piece."""
    lo = off[0]
    if off[-1] - lo <= 2 * PIECE or len(off) > 2:
        row, a, b, c, gram, stretch = _piece_anchors(data[lo:off[-1]], off - lo)
        begin = (off - lo)[row]
        return row, a - begin, b - begin, c - begin, gram, stretch
    parts = []
    for s in range(lo, off[-1], PIECE):
        e = min(off[-1], s + PIECE + LENGTH - 1)
        row, a, b, c, gram, stretch = _piece_anchors(data[s:e], np.array([0, e - s]))
        parts.append((row, a + s - lo, b + s - lo, c + s - lo, gram, stretch))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _packed(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, again: np.ndarray) -> np.ndarray:
    return (a << 16) | ((a - lo) << 9) | ((hi - lo) << 1) | again


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = place >> 16
    lo = a - ((place >> 9) & 0x7F)
    return a, lo, lo + ((place >> 1) & 0xFF)


def _versioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and version (a hash of the text) of every row with a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def anchor_table(docs: DataFrame) -> DataFrame:
    """gram, stretch, doc_id, version, place of every anchor (place: anchor, its windows, and whether the text had the stretch before)."""
    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("text"))
            ids, version = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
            for i, j in row_blocks(off):
                row, a, lo, hi, gram, stretch = anchors(data, off[i:j + 1])
                order = np.lexsort((a, stretch, gram, row))
                again = np.zeros(len(row), np.int64)
                same = (np.diff(row[order]) == 0) & (gram[order[1:]] == gram[order[:-1]]) & (stretch[order[1:]] == stretch[order[:-1]]) if len(row) else []
                again[order[1:]] = same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids[i:j][row]), pa.array(version[i:j][row]),
                     pa.array(_packed(a, lo, hi, again))], names=["gram", "stretch", "doc_id", "version", "place"])

    return _versioned(docs).where("doc_id IS NOT NULL").mapInArrow(run, "gram long, stretch long, doc_id long, version long, place long")


def _bounded_by(df: DataFrame, runs: str) -> DataFrame:
    """Broadcast hint for a written ``df`` whose lists ``runs`` hold at most ``BROADCAST_RUNS`` items in all."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(runs))).first()[0] or 0) <= BROADCAST_RUNS else df


CONTEXT = "gram long, doc_id long, version long, place long, before binary, after binary"


def contexts(docs: DataFrame, open_places: DataFrame) -> DataFrame:
    """``CONTEXT``: the REACH bytes before each anchor, reversed, and the LENGTH bytes from it (zeros beyond the text)."""
    listed = written(open_places.groupBy("doc_id", "version").agg(F.collect_list(F.struct("gram", "place")).alias("open")), "suffix-listed")
    texts = _versioned(docs).join(listed, ["doc_id", "version"])

    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("text"))
            lists = batch.column("open")
            item = lists.offsets.to_numpy()
            every = [lists.values.field(c).to_numpy() for c in ("gram", "place")]
            for r in range(len(off) - 1):
                text = np.concatenate([np.zeros(REACH, np.uint8), data[off[r]:off[r + 1]], np.zeros(LENGTH, np.uint8)])
                # rows that repeat a text list its places as often
                gram, place = (c[item[r]:item[r + 1]] for c in every)
                place, first = np.unique(place, return_index=True)
                gram = gram[first]
                for x in range(0, len(place), 1 << 13):
                    part = slice(x, x + (1 << 13))
                    a = (place[part] >> 16)[:, None]
                    before = np.ascontiguousarray(text[a + np.arange(REACH - 1, -1, -1)])
                    after = np.ascontiguousarray(text[a + REACH + np.arange(LENGTH)])
                    own = [pa.array(np.full(len(a), batch.column(c)[r].as_py(), np.int64)) for c in ("doc_id", "version")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[part]), *own, pa.array(place[part]), _fixed(before), _fixed(after)], names=[c.split()[0] for c in CONTEXT.split(", ")])

    return texts.select("doc_id", "version", "text", "open").mapInArrow(run, CONTEXT)


def _fixed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def repeated_windows(doc: np.ndarray, version: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, version, start, end of the removed stretches around anchors of equal grams (whole groups of rows).

    At offset d two windows are equal if the sorted contexts share LENGTH - d bytes after the anchor and
    d bytes before it; runs of such neighbours are numbered, and in each pair of runs the rows of the
    earliest document (rows are in order of document, version and place) keep the first window of each of its versions."""
    first = np.lexsort((place >> 16, version, doc))
    doc, version, place, before, after = doc[first], version[first], place[first], before[first], after[first]
    a, lo, hi = _unpacked(place)
    n = len(doc)
    text = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))[:n]
    lcp = []
    for rows in (after, before):
        order = deep_shallow_sort(rows)
        lcp.append((order, neighbour_lcp(rows, order)))
    low, high = np.full(n, LENGTH), np.full(n, -1)
    for d in range(REACH + 1):
        live = np.flatnonzero((a - d >= lo) & (a - d <= hi))
        if len(live) < 2:
            continue
        run = []
        for (order, shared), need in zip(lcp, (LENGTH - d, d), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(shared < need)
            run.append(number[live])
        both = run[0] * (n + 1) + run[1]
        _, head, inverse = np.unique(both, return_index=True, return_inverse=True)
        ahead = live[head[inverse]]
        _, head, own = np.unique(inverse * n + text[live], return_index=True, return_inverse=True)
        later = (doc[ahead] != doc[live]) | (a[live[head[own]]] != a[live])
        low[live[later]] = np.minimum(low[live[later]], d)
        high[live[later]] = d
    hit = high >= 0
    return doc[hit], version[hit], (a - high)[hit], (a - low + LENGTH)[hit]


def _window_hashes(before: np.ndarray, after: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, rows, hash of their window at this offset) for every offset."""
    text = np.concatenate([before[:, ::-1], after], axis=1)
    width = text.shape[1]
    pw, inv = powers(width + 1)
    prefix = np.zeros((len(text), width + 1), U)
    np.cumsum(BYTE_TABLE[text] * pw[:width], axis=1, out=prefix[:, 1:])
    a, lo, hi = _unpacked(place)
    for d in range(REACH + 1):
        rows = np.flatnonzero((a - d >= lo) & (a - d <= hi))
        s = REACH - d
        yield d, rows, mix((prefix[rows, s + LENGTH] - prefix[rows, s]) * inv[s])


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """doc_id, version, start, end removed within grams of at most ``HOT`` distinct stretches."""
    def run(batches):
        def done(parts):
            t = pa.Table.from_batches(parts)
            found = repeated_windows(*(t.column(c).to_numpy() for c in ("doc_id", "version", "place")), _matrix(t.column("before"), REACH), _matrix(t.column("after"), LENGTH))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc_id", "version", "start", "end"])

        parts, size = [], 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            change = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            if parts and (len(change) or parts[-1].column("gram")[-1].as_py() != gram[0]) and size >= GROUP_ROWS:
                same = parts[-1].column("gram")[-1].as_py() == gram[0]
                cut = int(change[0]) if same else 0
                yield done([*parts, batch.slice(0, cut)])
                parts, size, batch = [], 0, batch.slice(cut)
            parts.append(batch)
            size += len(batch)
        if size:
            yield done(parts)

    return rows.repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(run, "doc_id long, version long, start long, end long")


def _hashed_windows(rows: DataFrame) -> DataFrame:
    """doc_id, version, start, end removed within grams of more than ``HOT`` distinct stretches: windows grouped by hash."""
    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            place, gram, doc, version = (t.column(c).to_numpy() for c in ("place", "gram", "doc_id", "version"))
            for d, at, h in _window_hashes(_matrix(t.column("before"), REACH), _matrix(t.column("after"), LENGTH), place):
                yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(np.full(len(at), d)), pa.array(h.view(np.int64)), pa.array(doc[at]), pa.array(version[at]), pa.array((place[at] >> 16) - d)],
                                                 names=["gram", "d", "h", "doc_id", "version", "start"])

    windows = rows.mapInArrow(run, "gram long, d long, h long, doc_id long, version long, start long")
    local = windows.groupBy("gram", "d", "h", "doc_id", "version").agg(F.min("start").alias("least"))
    heads = local.groupBy("gram", "d", "h").agg(F.min("doc_id").alias("first_doc"))
    joined = windows.join(local, ["gram", "d", "h", "doc_id", "version"]).join(heads, ["gram", "d", "h"])
    return joined.where("first_doc < doc_id OR least < start").select("doc_id", "version", "start", (F.col("start") + LENGTH).alias("end"))


def removed_runs(docs: DataFrame) -> DataFrame:
    """doc_id, version, runs: the maximal removed byte runs [start, end) of every text that has any."""
    rows = anchor_table(docs)
    common = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(rows.join(common.select("gram"), "gram"), "suffix-shared")
    firsts = shared.groupBy("gram", "stretch").agg(F.min("doc_id").alias("first_doc"))
    placed = written(shared.join(firsts, ["gram", "stretch"]).select("gram", "stretch", "doc_id", "version", "place",
                     ((F.col("first_doc") == F.col("doc_id")) & (F.col("place").bitwiseAND(F.lit(1)) == 0)).alias("head")), "suffix-placed")
    a, lo = F.shiftright("place", 16), F.shiftright("place", 16) - F.shiftright("place", 9).bitwiseAND(F.lit(0x7F))
    whole = placed.where(~F.col("head")).select("doc_id", "version", lo.alias("start"), (lo + F.shiftright("place", 1).bitwiseAND(F.lit(0xFF)) + LENGTH).alias("end"))

    heads = placed.where("head")
    mixed = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_places = heads.join(mixed, "gram").select("gram", "doc_id", "version", "place", (F.col("n") > HOT).alias("hot"))
    around = written(contexts(docs, open_places), "suffix-contexts")
    hot = written(mixed.where(F.col("n") > HOT).select("gram"), "suffix-hot")
    if hot.count():
        parts = _sorted_groups(around.join(hot, "gram", "left_anti")).union(_hashed_windows(around.join(hot, "gram", "left_semi")))
    else:
        parts = _sorted_groups(around)
    found = whole.union(parts).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def run(batches):
        for batch in batches:
            lists = batch.column("found")
            off = lists.offsets.to_numpy()
            start, end = (lists.values.field(c).to_numpy() for c in ("start", "end"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(
                [merged(start[x:y], end[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)], pa.list_(pa.int64()))], names=["doc_id", "version", "runs"])

    return found.mapInArrow(run, "doc_id long, version long, runs array<long>")


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    runs = written(removed_runs(docs), "suffix-runs")
    texts = _versioned(docs).join(_bounded_by(runs, "runs"), ["doc_id", "version"], "left")

    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("text"))
            rows = []
            for r, cut in enumerate(batch.column("runs").to_pylist()):
                text = data[off[r]:off[r + 1]]
                ends = np.minimum(np.array([0, *(cut or ()), len(text)]), len(text))
                keep = sha256()
                for x, y in zip(ends[::2], ends[1::2], strict=True):
                    keep.update(np.ascontiguousarray(text[x:y]))
                rows.append((len(text), int((ends[2:-1:2] - ends[1:-1:2]).sum()), len(cut or ()) // 2, keep.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
