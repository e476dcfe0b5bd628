"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` virtual slots, whatever the number of shards.  Bytes and
rows are summed by slot, and a small map says which shard holds each slot.  The map is a versioned
table: version 0 deals the slots in turn, and each later version is an edit of the one before
(``levelled`` moves slots from the fullest shard to the emptiest until no move brings the two closer;
``grown`` gives a new shard its part and moves nothing else).  Records never change their slot, so an
edit moves only the records of the slots it names.

A slot is a hash of doc_id.  Where a slot holds far more than its part (records of one id, or without
an id, all hash to one slot) it is split: its records are dealt by their row number in the written
record table over as many sub-slots as it takes, and the map lists the sub-slots.

The map holds at most ``SLOTS`` slots and ``2 * SLOT_PARTS * SLOTS`` sub-slots whatever the input, which bounds
what reaches the driver and what is broadcast.

Null text has no bytes (size 1); a null doc_id is a value like any other; repeated rows count as often
as they occur; an empty table gives an empty result; extra columns are ignored by ``place`` and kept by
``with_shards``.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import written

SLOTS = 8192
SLOT_PARTS = 4          # a slot of more than this many times the mean is split
MAP_SCHEMA = "slot_id int, part int, parts int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class Slot:
    """One line of the map: a part of a slot, its load and the shard that holds it."""

    slot_id: int
    part: int
    parts: int
    bytes: int
    rows: int


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, slot_id and a row number of every document, written once: later steps read this
    narrow table, so a lost executor changes no number."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return written(docs.select(
        doc_id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(doc_id, slots).alias("slot_id"), F.monotonically_increasing_id().alias("row_no")), "shard-records")


def part_of(parts: Column) -> Column:
    """The sub-slot of a record in a slot of ``parts`` parts."""
    return F.pmod(F.xxhash64("row_no"), parts).cast("int")


def slot_loads(recs: DataFrame) -> list[Slot]:
    """Bytes and rows of every slot, heavy slots split into parts (at most ``2 * SLOT_PARTS * SLOTS`` lines in all)."""
    totals = recs.groupBy("slot_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    if not totals:
        return []
    n = len(totals)
    all_bytes, all_rows = sum(t.bytes for t in totals), sum(t.rows for t in totals)
    heavy = {}
    for t in totals:
        times = max(t.bytes * n / all_bytes, t.rows * n / all_rows)
        if times > SLOT_PARTS and t.rows > 1:
            heavy[t.slot_id] = min(t.rows, int(-(-times // 1)))
    light = [Slot(t.slot_id, 0, 1, t.bytes, t.rows) for t in totals if t.slot_id not in heavy]
    if not heavy:
        return sorted(light, key=lambda s: s.slot_id)
    spark = recs.sparkSession
    split = spark.createDataFrame(list(heavy.items()), "slot_id int, parts int")
    parts = (recs.join(F.broadcast(split), "slot_id").withColumn("part", part_of(F.col("parts")))
             .groupBy("slot_id", "part", "parts").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect())
    return sorted(light + [Slot(p.slot_id, p.part, p.parts, p.bytes, p.rows) for p in parts], key=lambda s: (s.slot_id, s.part))


# --- the map ---------------------------------------------------------------------------------

def dealt(loads: Iterable[Slot], shards: int) -> dict[Slot, int]:
    """Version 0: the slots in turn."""
    return {s: (s.slot_id + s.part) % shards for s in loads}


def _best_move(held: list[Slot], gap: int) -> Slot | None:
    """The slot whose move out of a shard ``gap`` bytes above another brings the two closest (ties: the least slot)."""
    fit = [s for s in held if 0 < s.bytes < gap]
    return min(fit, key=lambda s: (abs(gap - 2 * s.bytes), s.slot_id, s.part)) if fit else None


def levelled(held: dict[Slot, int], shards: int) -> dict[Slot, int]:
    """An edit that evens the bytes: the fullest shard gives a slot to the emptiest one while that brings them closer.

    Each move lowers the sum of squares of the shards' bytes, so this ends; then the two differ by no more
    than the least slot of the fuller one."""
    by = {k: [s for s, at in held.items() if at == k] for k in range(shards)}
    load = {k: sum(s.bytes for s in v) for k, v in by.items()}
    out = dict(held)
    while True:
        full, low = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        move = _best_move(by[full], load[full] - load[low])
        if move is None:
            return out
        by[full].remove(move)
        by[low].append(move)
        load[full] -= move.bytes
        load[low] += move.bytes
        out[move] = low


def grown(held: dict[Slot, int], shards: int) -> dict[Slot, int]:
    """An edit for one more shard: the fullest shards give it slots until it holds its part; no other slot moves."""
    load = dict.fromkeys(range(shards), 0)
    by: dict[int, list[Slot]] = {k: [] for k in range(shards)}
    for s, k in held.items():
        load[k] += s.bytes
        by[k].append(s)
    target = sum(load.values()) / (shards + 1)
    out, new = dict(held), 0
    queue = [(-v, k) for k, v in load.items()]
    heapq.heapify(queue)
    while queue:
        _, k = heapq.heappop(queue)
        fit = [s for s in by[k] if 0 < s.bytes <= min(load[k] - target, target - new) + 0.5]
        if not fit:
            continue
        move = max(fit, key=lambda s: (s.bytes, -s.slot_id, -s.part))
        by[k].remove(move)
        load[k] -= move.bytes
        new += move.bytes
        out[move] = shards
        heapq.heappush(queue, (-load[k], k))
    return out


class SlotMap:
    """The versions of a slot-to-shard map, one Parquet folder each below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-slot-map-{uuid.uuid4().hex}"

    def save(self, version: int, held: dict[Slot, int]) -> DataFrame:
        """Store a version (whole, so a repeated write of the same version changes nothing) and read it back."""
        rows = [(s.slot_id, s.part, s.parts, k, s.bytes, s.rows) for s, k in held.items()]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version}")

    def held(self, version: int) -> dict[Slot, int]:
        return {Slot(r.slot_id, r.part, r.parts, r.bytes, r.rows): r.shard for r in self.load(version).collect()}

    def moves(self, before: int, after: int) -> DataFrame:
        """slot_id, part, bytes, rows and both shards of the slots that change hands between two versions."""
        old = self.load(before).select("slot_id", "part", F.col("shard").alias("from_shard"))
        return self.load(after).join(old, ["slot_id", "part"]).where("shard <> from_shard").select(
            "slot_id", "part", "bytes", "rows", "from_shard", F.col("shard").alias("to_shard"))


# --- records to shards -----------------------------------------------------------------------

def located(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``recs`` with the part of their slot and the shard of the map (one bounded broadcast, no shuffle of records)."""
    parts = slot_map.select("slot_id", "parts").distinct()
    return recs.join(F.broadcast(parts), "slot_id").withColumn("part", part_of(F.col("parts"))).join(
        F.broadcast(slot_map.select("slot_id", "part", "shard")), ["slot_id", "part"])


def numbered(placed: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``placed`` with ``slot``, the record's place in its shard: records are numbered within their slot's part
    (which is small), after the rows that the shard's earlier parts hold by the map."""
    before = slot_map.select("slot_id", "part", (F.coalesce(F.sum("rows").over(
        Window.partitionBy("shard").orderBy("slot_id", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slot_id", "part").orderBy(F.col("doc_id").asc_nulls_first(), "row_no"))
    return placed.withColumn("inside", inside).join(F.broadcast(before), ["slot_id", "part"]).withColumn(
        "slot", (F.col("before") + F.col("inside") - 1).cast("long"))


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Every record with its shard and place, by the evened map (version 1), and the map's versions
    (0: dealt, 1: evened, 2: one more shard)."""
    slot_map = slot_map or SlotMap(docs.sparkSession)
    recs = records(docs, slots)
    first = dealt(slot_loads(recs), shards)
    slot_map.save(0, first)
    even = levelled(first, shards)
    current = slot_map.save(1, even)
    slot_map.save(2, grown(even, shards))
    return numbered(located(recs, current), current), slot_map


def place(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``), and the virtual slot."""
    rows, _ = sharded(docs, shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), F.col("slot_id").alias("virtual_slot"), F.col("part").alias("slot_part"))


def with_shards(docs: DataFrame, slot_map: DataFrame, slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """``docs`` with their shard by a stored map without split slots, e.g. for ``write.partitionBy(name)``."""
    table = slot_map.where("part = 0").select(F.col("slot_id").alias("__slot"), F.col("shard").alias("__shard"))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.withColumn("__slot", virtual_slot(F.col("doc_id").cast("long"), slots)).join(
        F.broadcast(table), "__slot", "left").select(*columns, F.col("__shard").alias(name))
