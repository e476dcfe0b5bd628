"""Packing by concatenate and cut.

The documents' token streams (ids, then one end id) are laid end to end and cut into windows of
``window`` ids.  Two passes: the first tokenises each input partition once, numbers its ids from 0
and writes both down; the partition totals (one row per task) give by prefix sum where each
partition begins in the whole stream; the second pass turns every document into its pieces.
Every sequence but the last is full, so at most one sequence of the corpus is padded.

Null text is the empty text (a single end id); a null ``doc_id`` stays null; repeated rows are
packed as often as they occur; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_view, row_blocks, text_view, written

WINDOW = 1024
END_ID = 0
CACHE_PARTS = 200_000       # parts a worker remembers, some 250 bytes each
MET = 1 << 20               # places of the table of parts met once
MARKS = ".,;:!?"
LONG_PART = 400
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[tuple[str, int], CachedEncoder] = {}

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary() -> str:
    """Path of the public byte-level BPE on this machine (asked for inside the task)."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class CachedEncoder:
    """``tokenizers`` ids of whole texts, with a bounded cache over space-delimited parts.

    The byte-level pre-tokeniser never joins a non-space character with the space after it, so a text
    may be cut before every space and its parts encoded alone, unless a part is empty or begins or
    ends with white space (a run of white space is one token); such texts, parts that might hold a
    special token and very long parts go to the tokenizer itself.  Cache misses are merged by tiktoken with the ranks
    of the same vocabulary file; ``tests/llm`` compares the two.
    """

    def __init__(self, path: str, parts: int = CACHE_PARTS):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        shown = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(shown[c] for c in t): i for t, i in self.whole.get_vocab(with_added_tokens=False).items() if t not in special}
        self.merge = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = tuple(special)
        self.opens = np.zeros(self.whole.get_vocab_size(), bool)       # tokens that begin with a space
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.dtype = np.dtype("H" if self.whole.get_vocab_size() <= 1 << 16 else "I")
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.marks = {m: self._exact(m) for m in MARKS}
        # parts met for the second time, in two generations: when the recent one holds half of the parts, it replaces the older one
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.half = max(1, parts // 2)
        self.met, self.n_met = bytearray(MET), 0

    def _exact(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, text: str) -> bytes:
        if len(text) > LONG_PART or any(t in text for t in self.special):
            return self._exact(text)
        return array(self.dtype.char, self.merge(text)).tobytes()

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of a space and each part, merged in one call: only a part's first token begins with a space."""
        text = " " + " ".join(parts)
        if max(map(len, parts)) <= LONG_PART and not any(t in text for t in self.special):
            ids = np.array(self.merge(text), self.dtype)
            at = np.flatnonzero(self.opens[ids]) * self.dtype.itemsize
            if len(at) == len(parts):
                raw = ids.tobytes()
                return [raw[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(raw)], strict=True)]
        return [self._ids(" " + p) for p in parts]

    def _keep(self, part: str, ids: bytes) -> None:
        """Remember a part that is met for the second time."""
        place = hash(part) % MET
        if not self.met[place]:
            self.n_met += 1
            if 2 * self.n_met > MET:
                self.met, self.n_met = bytearray(MET), 0
            self.met[place] = 1
        else:
            self._remember(part, ids)

    def _remember(self, part: str, ids: bytes) -> None:
        if len(self.recent) >= self.half:
            self.older, self.recent = self.recent, {}
        self.recent[part] = ids

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` and the end id, as little-endian bytes of ``dtype``."""
        if not text:
            return self.end
        first, *parts = text.split(" ")
        if first and (first[0].isspace() or first[-1].isspace()):
            return self._exact(text) + self.end
        got = list(map(self.recent.get, parts))
        if None in got:
            k, missing = -1, []
            while True:
                try:
                    k = got.index(None, k + 1)
                except ValueError:
                    break
                part = parts[k]
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._exact(text) + self.end
                ids = self.older.get(part)
                if ids is not None:
                    self._remember(part, ids)
                elif part[-1] in self.marks and part[:-1].isalpha() and (stem := self.recent.get(part[:-1])) is not None:
                    ids = stem + self.marks[part[-1]]       # a closing mark after letters is a token of its own
                    self._keep(part, ids)
                else:
                    missing.append(k)
                got[k] = ids
            if missing:
                for k, ids in zip(missing, self._parts([parts[k] for k in missing]), strict=True):
                    got[k] = ids
                    self._keep(parts[k], ids)
        return (self._ids(first) if first else b"") + b"".join(got) + self.end


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _encoder(path: str | None, parts: int) -> CachedEncoder:
    key = path or vocabulary(), parts
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(*key)
    return _ENCODERS[key]


def tokenise(docs: DataFrame, path: str | None = None, parts: int = CACHE_PARTS) -> DataFrame:
    """doc_id, part, part_start, n, ids: each document's ids (little-endian, 2 or 4 bytes each) with the
    end id, and how many ids of its input partition come before it."""
    def run(batches):
        enc, part, seen = _encoder(path, parts), TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column("text").fill_null("")
            _, off = text_view(text)
            for i, j in row_blocks(off):
                rows = [enc.encode(t) for t in text.slice(i, j - i).to_pylist()]
                n = np.array([len(r) for r in rows], np.int64) // enc.dtype.itemsize
                start = seen + np.cumsum(n) - n
                seen += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(start),
                     pa.array(n), pa.array(rows, pa.binary())],
                    names=["doc_id", "part", "part_start", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, part int, part_start long, n long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, parts: int = CACHE_PARTS) -> DataFrame:
    """One row per piece; see ``PIECES``.  ``parts``: parts of words a worker remembers, for speed only."""
    tokens = written(tokenise(docs, path, parts), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # one row per input partition: bounded by the number of tasks
    placed = tokens.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("part_start") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            n = batch.column("n").to_numpy()
            if not len(at):
                continue
            first, last = at // window, (at + n - 1) // window
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(at)), pieces)
            seq = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[doc]
            lo = np.maximum(seq * window, at[doc])
            hi = np.minimum((seq + 1) * window, (at + n)[doc])
            start, length = lo - at[doc], hi - lo
            raw, off = binary_view(batch.column("ids"))
            width = int((off[1] - off[0]) // n[0])
            stored = np.dtype(f"<u{width}")
            begin, size = off[doc] + width * start, width * length
            crc = np.array([zlib.crc32(raw[b:b + k].view(stored).astype("<u4")) for b, k in zip(begin, size, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (start, length, crc, n[doc], seq, lo - seq * window))],
                names=[c.split()[0] for c in PIECES.split(", ")])

    return placed.mapInArrow(cut, PIECES)
