"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the UTF-8 bytes of each text; a chunk ends where the hash is the least
within ``REACH`` bytes on either side, so boundaries depend on nearby content alone and an insertion
only moves the boundaries next to it.  Long stretches without such a place (periodic ones) are cut
where the hash is the least of the whole stretch.
Chunks are deduplicated by digest: a chunk is a repeat if an equal one comes earlier (in a smaller
doc_id, or before it in the same text).  Single small chunks agree by chance, so only runs of
adjoining repeats of at least ``MIN_RUN_BYTES``, or of a whole text, are removed.

Chunks do not end where a passage ends, so adjoining repeats of one earlier place are extended byte by
byte to both sides against the text there (``CONTEXT`` bytes: beyond a chunk and what decides its ends,
an equal neighbour would be a repeat itself).  A stretch that reaches the length only so is removed too,
and a long run loses the bytes around it that go on at its earlier place.

Null and empty texts have no chunks; rows without a doc_id come after all others and are not
reported (they cannot be named); of rows that repeat a doc_id none is earlier than the other, those of
equal text are reported as one and those of other text each for itself; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, prefix_hash, row_blocks, span_hash, text_view, written

REACH = 16
GEAR_BYTES = 32
MAX_BYTES = 256
PERIOD_BYTES = 64
MIN_RUN_BYTES = 150
CONTEXT = MAX_BYTES + GEAR_BYTES + REACH

_GEAR = np.append(np.random.default_rng(32).integers(1, 2 ** 32, 256, dtype=np.uint32), np.uint32(0))
_GAP = 256              # stands between the texts of a block; adds nothing to the hash
_LAST_ID = 2 ** 63 - 1


def gear_hash(values: np.ndarray) -> np.ndarray:
    """Gear hash at every byte (256: a gap): the sum of the last 32 table values, each shifted by its age."""
    h = _GEAR[values]
    age = 1
    while age < GEAR_BYTES:
        longer = h.copy()
        longer[age:] += h[:-age] << np.uint32(age)
        h, age = longer, 2 * age
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every i."""
    m, k = x, 1
    while 2 * k <= width:
        m = np.minimum(m[:len(m) - k], m[k:])
        k *= 2
    return np.minimum(m[:len(m) - (width - k)], m[width - k:]) if k < width else m


def _cut_long(h: np.ndarray, begin: int, start: int, end: int) -> np.ndarray:
    """Ends of the chunks within a stretch without boundaries: places of its least hash, ``PERIOD_BYTES`` apart
    (in a periodic stretch this gives equal chunks), and every ``MAX_BYTES`` where there is none."""
    part = h[begin + start:begin + end]
    out, last = [], start
    for at in (np.flatnonzero(part == part[GEAR_BYTES + REACH:].min()) + start + 1).tolist():
        if at - last >= PERIOD_BYTES and at < end:
            out += range(last + MAX_BYTES, at, MAX_BYTES)
            out.append(at)
            last = at
    return np.array([*out, *range(last + MAX_BYTES, end, MAX_BYTES)], np.int64)


def chunk_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, start, end of every chunk of the rows ``off`` delimits in ``data``; start and end count from the row's begin."""
    size = np.diff(off)
    begin = np.cumsum(size + GEAR_BYTES) - size           # of each row in the block with gaps
    total = int(size.sum()) + GEAR_BYTES * (len(size) + 1)
    row_of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row_of)) + (begin - (off[:-1] - off[0]))[row_of]
    values = np.full(total, _GAP, np.int64)
    values[place] = data[off[0]:off[-1]]
    h = gear_hash(values)
    h[values == _GAP] = np.uint32(2 ** 32 - 1)
    edge = np.full(REACH, 2 ** 32 - 1, np.uint32)
    least = _least(np.concatenate([edge, h, edge]), REACH)
    cut = np.flatnonzero((h < least[:total]) & (h <= least[REACH + 1:REACH + 1 + total]))
    row = np.searchsorted(begin, cut, "right") - 1
    at = cut - begin[row] + 1
    inside = at < size[row]                               # the end of a row always cuts
    some = np.flatnonzero(size)
    rows = np.concatenate([row[inside], some])
    ends = np.concatenate([at[inside], size[some]])
    order = np.lexsort((ends, rows))
    rows, ends = rows[order], ends[order]
    starts = np.where(np.append(True, rows[1:] != rows[:-1])[:len(rows)], 0, np.append(0, ends[:-1])[:len(rows)])
    long = np.flatnonzero(ends - starts > MAX_BYTES)
    if len(long):
        more = [_cut_long(h, begin[rows[k]], starts[k], ends[k]) for k in long]
        rows = np.concatenate([rows, np.repeat(rows[long], [len(m) for m in more])])
        ends = np.concatenate([ends, *more])
        order = np.lexsort((ends, rows))
        rows, ends = rows[order], ends[order]
        starts = np.where(np.append(True, rows[1:] != rows[:-1]), 0, np.append(0, ends[:-1]))
    return rows, starts, ends


def chunk_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """digest, doc_id, version (hash of the row's text), place (start, length and two flags in one long), back (bytes
    from the first equal chunk of the row) of every chunk."""
    data, off = text_view(batch.column("text"))
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for i, j in row_blocks(off):
        row, start, end = chunk_bounds(data, off[i:j + 1])
        base = (off[i:j] - off[i])[row]
        prefix = prefix_hash(data[off[i]:off[j]])
        digest = span_hash(prefix, base + start, base + end)
        version = span_hash(prefix, off[i:j] - off[i], off[i + 1:j + 1] - off[i]).view(np.int64)
        last = end == np.diff(off[i:j + 1])[row]
        order = np.lexsort((start, digest, row))
        again = np.zeros(len(row), bool)
        again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
        earliest = np.maximum.accumulate(np.where(again[order], 0, np.arange(len(row))))
        back = np.empty(len(row), np.int64)
        back[order] = start[order] - start[order[earliest]]
        place = (start << 13) | ((end - start) << 2) | (last << 1) | again
        yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(ids[i:j][row]), pa.array(version[row]), pa.array(place), pa.array(back)],
                                         names=["digest", "doc_id", "version", "place", "back"])


def chunked(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield from chunk_rows(batch)

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        run, "digest long, doc_id long, version long, place long, back long")


def stretches(place: np.ndarray, source: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of run start, run end, 1 if it ends the text, stretch start, stretch end, index of its first chunk.

    ``place``: repeated chunks of one text in order, each once; ``source``: number of the text that each repeats,
    ``at``: where.  A run is made of adjoining repeats, a stretch of those of a run that follow each other in the
    text they repeat as well."""
    start, size = place >> 13, (place >> 2) & 0x7FF
    end = start + size
    new_run = np.append(True, start[1:] != end[:-1])[:len(start)]
    new = new_run | np.append(True, (source[1:] != source[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]))[:len(start)]
    first, runs = np.flatnonzero(new), np.flatnonzero(new_run)
    final, run_final = np.append(first[1:], len(start)) - 1, np.append(runs[1:], len(start)) - 1
    run = np.searchsorted(runs, first, "right") - 1
    last = (place[run_final[run]] >> 1) & 1
    return np.stack([start[runs[run]], end[run_final[run]], last, start[first], end[final], first], axis=1)


STRETCH = "doc_id long, version long, n_repeats long, a long, b long, last long, s long, e long, from_doc long, from_version long, at long, until long"
_NAMES = [f.split()[0] for f in STRETCH.split(", ")]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("places")
        off = lists.offsets.to_numpy()
        flat = np.stack([lists.values.field(k).to_numpy() for k in range(4)], axis=1)          # place, from_doc, from_version, at
        ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
        out = [np.zeros((0, len(_NAMES)), np.int64)]
        for d, v, i, j in zip(ids, versions, off[:-1], off[1:], strict=True):
            rows = flat[i:j]
            rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
            source = np.unique(rows[:, 1:3], axis=0, return_inverse=True)[1].ravel()
            x = stretches(rows[:, 0], source, rows[:, 3])
            own = np.tile(np.array([[d, v, len(rows)]]), (len(x), 1))
            begin = rows[x[:, 5], 3]
            out.append(np.column_stack([own, x[:, :5], rows[x[:, 5], 1:3], begin, begin + x[:, 4] - x[:, 3]]))
        table = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], names=_NAMES)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before and after the asked stretches of each text."""
    for batch in batches:
        data, off = text_view(batch.column("text"))
        rows = []
        for r, (d, asked) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
            text = data[off[r]:off[r + 1]]
            version = None
            for x in asked:
                if version is None:
                    version = int(span_hash(prefix_hash(text), np.array([0]), np.array([len(text)])).view(np.int64)[0])
                if x["version"] == version:
                    rows.append((d, version, x["s"], x["e"], text[max(0, x["s"] - CONTEXT):x["s"]].tobytes(), text[x["e"]:x["e"] + CONTEXT].tobytes(), len(text)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "version", "s", "e", "left", "right", "size"])


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int(np.argmax(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in ("left", "right", "from_left", "from_right")}
        before = np.array([_common(x[::-1], y[::-1]) for x, y in zip(cols["left"], cols["from_left"], strict=True)], np.int64)
        after = np.array([_common(x, y) for x, y in zip(cols["right"], cols["from_right"], strict=True)], np.int64)
        keep = [batch.column(k) for k in ("doc_id", "version", "n_repeats", "a", "b")]
        x, y = batch.column("s").to_numpy() - before, batch.column("e").to_numpy() + after
        yield pa.RecordBatch.from_arrays([*keep, pa.array(x), pa.array(y), pa.array((y == batch.column("size").to_numpy()).astype(np.int64))],
                                         names=["doc_id", "version", "n_repeats", "a", "b", "x", "y", "last"])


def removed_spans(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, last: np.ndarray, min_run: int = MIN_RUN_BYTES) -> np.ndarray:
    """start, end, start, end, ... of what is removed: the spans x:y that are long enough, whole texts, or of a run a:b that is."""
    keep = (y - x >= min_run) | (b - a >= min_run) | ((x == 0) & (last == 1))
    return merged(x[keep], y[keep])


def repeated_passages(docs: DataFrame, min_run: int = MIN_RUN_BYTES) -> DataFrame:
    """doc_id, n_repeats (repeated chunks), n_removed (bytes), n_spans and spans ("start:end" in bytes, comma-joined)
    of every document with a removed run (of each text, if rows of a doc_id differ)."""
    rows = chunked(docs)
    start = F.shiftright("place", 13)
    shared = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "version", start.alias("at"))).alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").select("digest", "first")
    earlier = F.col("first.doc_id") < F.col("doc_id")
    repeats = rows.where(F.col("doc_id") != _LAST_ID).join(shared, "digest").where(earlier | (F.col("place").bitwiseAND(F.lit(1)) == 1))
    per_doc = repeats.groupBy("doc_id", "version").agg(F.collect_set(F.struct(
        "place", F.when(earlier, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("from_doc"),
        F.when(earlier, F.col("first.version")).otherwise(F.col("version")).alias("from_version"),
        F.when(earlier, F.col("first.at")).otherwise(start - F.col("back")).alias("at"))).alias("places"))
    found = written(per_doc.mapInArrow(_stretches, STRETCH), "chunk-stretches")

    # a stretch deep inside a run ends within it
    edge = found.where((F.col("s") - F.col("a") < CONTEXT) | (F.col("b") - F.col("e") < CONTEXT))
    asked = edge.select("doc_id", "version", "s", "e").union(edge.select("from_doc", "from_version", "at", "until")).distinct()
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("version", "s", "e")).alias("asked"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(asked, "doc_id")
    around = written(texts.mapInArrow(_around, "doc_id long, version long, s long, e long, left binary, right binary, size long").groupBy("doc_id", "version", "s", "e").agg(
        F.first("left").alias("left"), F.first("right").alias("right"), F.first("size").alias("size")), "chunk-contexts")
    source = around.select(F.col("doc_id").alias("from_doc"), F.col("version").alias("from_version"), F.col("s").alias("at"), F.col("e").alias("until"),
                           F.col("left").alias("from_left"), F.col("right").alias("from_right"))
    both = edge.join(around, ["doc_id", "version", "s", "e"]).join(source, ["from_doc", "from_version", "at", "until"])
    spans = both.mapInArrow(_extended, "doc_id long, version long, n_repeats long, a long, b long, x long, y long, last long").union(
        found.select("doc_id", "version", "n_repeats", "a", "b", "a", "b", "last").distinct())
    spans = spans.where((F.col("y") - F.col("x") >= min_run) | (F.col("b") - F.col("a") >= min_run) | ((F.col("x") == 0) & (F.col("last") == 1)))
    per_text = spans.groupBy("doc_id", "version", "n_repeats").agg(F.collect_list(F.struct("a", "b", "x", "y", "last")).alias("spans"))

    def run(batches):
        for batch in batches:
            lists = batch.column("spans")
            off, flat = lists.offsets.to_numpy(), [lists.values.field(k).to_numpy() for k in range(5)]
            ends = [removed_spans(*(c[i:j] for c in flat), min_run) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_repeats"), pa.array([int((x[1::2] - x[::2]).sum()) for x in ends], pa.int64()),
                 pa.array([len(x) // 2 for x in ends], pa.int64()),
                 pa.array([",".join(f"{x}:{y}" for x, y in zip(e[::2], e[1::2], strict=True)) for e in ends], pa.string())],
                names=["doc_id", "n_repeats", "n_removed", "n_spans", "spans"])

    return per_text.mapInArrow(run, "doc_id long, n_repeats long, n_removed long, n_spans long, spans string")
