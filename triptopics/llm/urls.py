"""URL verdicts by listed rules and an exact Bloom filter cascade.

A cascade stores a key list S within a known key universe U: level 0 is a Bloom filter of S, level 1
one of the keys of U outside S that level 0 lets pass, level 2 one of the keys of S that level 1 lets
pass, and so on until nothing passes wrongly.  A key of U belongs to S exactly when the first level
that rejects it has an odd number.  Pages are judged by the filters alone, no page is joined with
the list.  Keys are dealt into shards by hash, so that no filter is larger than ``SHARD_KEYS`` keys
ask for however long the list gets; each shard's filters go to the tasks as one broadcast.

Null or odd URLs have empty host and path; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import mix, text_view, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The listed rules.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

SHARD_KEYS = 4_000_000
BITS_PER_KEY = 8
HASHES = 3
HOST_BLOCK_SHARE = 0.4


def with_host_path(pages: DataFrame) -> DataFrame:
    """page_id, host (lower case), path of every url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"))


def longest_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_listing(ruled: DataFrame, share: float = HOST_BLOCK_SHARE) -> DataFrame:
    """host, listed: the key universe; a host is listed when rules block more than ``share`` of its pages."""
    blocked = F.sum((F.col("ruled") == "block").cast("long"))
    return ruled.groupBy("host").agg(
        (F.coalesce(blocked, F.lit(0)) > F.lit(share) * F.count(F.lit(1))).alias("listed"))


# --- cascade ---------------------------------------------------------------------------------

def _positions(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """``HASHES`` bit positions of each key (two hash halves a row) at this level, by double hashing."""
    salt = mix(np.array([2 * level + 1], np.uint64))
    base, step = mix(h[:, 0] ^ salt), mix(h[:, 1] + salt) | np.uint64(1)
    return ((base[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) >> np.uint64(7)) % np.uint64(bits)


def _passes(h: np.ndarray, level: int, words: np.ndarray) -> np.ndarray:
    pos = _positions(h, level, 64 * len(words))
    return ((words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63))) & np.uint64(1)).all(axis=1).astype(bool)


def _member(h: np.ndarray, levels: Sequence[np.ndarray]) -> np.ndarray:
    """Exact membership of keys of the universe: parity of the first level that rejects."""
    out = np.zeros(len(h), bool)
    alive = np.arange(len(h))
    for level, words in enumerate(levels):
        ok = _passes(h[alive], level, words)
        out[alive[~ok]] = level % 2 == 1
        alive = alive[ok]
    out[alive] = len(levels) % 2 == 1
    return out


def _key_hash(col: pa.Array) -> np.ndarray:
    """128-bit hashes of whole strings as two 64-bit halves a row; null is the empty key."""
    raw, off = text_view(col)
    view = memoryview(np.ascontiguousarray(raw))
    digests = b"".join(xxh3_128_digest(view[a:b]) for a, b in zip(off[:-1], off[1:], strict=True))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def _halves(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1")], axis=1)


def _fill(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """Bloom filter of ``keys`` (``h0``, ``h1``): words are OR-ed per task, then summed up by word; what
    reaches the driver is the filter itself, of ``BITS_PER_KEY`` bits a key."""
    words = max(1, -(-n * BITS_PER_KEY // 64))

    def bits(batches):
        own = np.zeros(words, np.uint64)
        for b in batches:
            pos = _positions(_halves(b), level, 64 * words).ravel()
            np.bitwise_or.at(own, (pos >> np.uint64(6)).astype(np.int64), np.uint64(1) << (pos & np.uint64(63)))
        at = np.flatnonzero(own)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + (1 << 16)]), pa.array(own[at[i:i + (1 << 16)]].view(np.int64))], names=["w", "v"])

    got = keys.select("h0", "h1").mapInArrow(bits, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def build(universe: DataFrame, max_levels: int = 64) -> list[list[np.ndarray]]:
    """Cascades, one list of filters per shard, of the keys of ``universe`` (key, listed).

    Keys are compared by 128-bit hashes; a level is one grouped OR and one pass over the other side."""
    def hashed(batches):
        for b in batches:
            h = _key_hash(b.column("key"))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(h[:, k]).view(np.int64)) for k in (0, 1)), b.column("listed")],
                                             names=["h0", "h1", "listed"])

    keys = written(universe.select("key", "listed").mapInArrow(hashed, "h0 long, h1 long, listed boolean"), "url-keys")
    shards = max(1, -(-keys.where("listed").count() // SHARD_KEYS))
    out = []
    for s in range(shards):
        part = keys.where(F.pmod(F.col("h0"), F.lit(shards)) == s)
        inside, outside, levels = part.where("listed"), part.where(~F.col("listed")), []
        while len(levels) < max_levels and (n := inside.count()):
            words = _fill(inside, len(levels), n)
            levels.append(words)
            inside, outside = written(_passing(outside, len(levels) - 1, words), "url-level"), inside
        out.append(levels)
    return out


def _passing(keys: DataFrame, level: int, words: np.ndarray) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(words)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(_passes(_halves(b), level, shared.value)))

    return keys.select("h0", "h1").mapInArrow(keep, "h0 long, h1 long")


def listed_by_cascade(rows: DataFrame, key: str, cascades: list[list[np.ndarray]], out: str) -> DataFrame:
    """``rows`` and a boolean column ``out``: whether its key (of the universe) is on the list."""
    sc = rows.sparkSession.sparkContext
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` boolean"
    shared = [sc.broadcast(levels) for levels in cascades]

    def probe(batches):
        for b in batches:
            h = _key_hash(b.column(key))
            shard = h[:, 0].view(np.int64) % len(shared)
            got = np.zeros(len(h), bool)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                got[at] = _member(h[at], shared[s].value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, out])

    return rows.mapInArrow(probe, schema)


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, share: float = HOST_BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest fitting rule decides; without one, a page of a
    listed host (see ``host_listing``) is blocked, any other allowed."""
    name, verdict = longest_rule(rules)
    ruled = with_host_path(pages).select("*", name.alias("rule"), verdict.alias("ruled"))
    universe = written(host_listing(ruled, share).select(F.col("host").alias("key"), "listed"), "url-universe")
    judged = listed_by_cascade(ruled, "host", build(universe), "listed")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
