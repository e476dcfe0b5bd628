"""Event-time forms of the day loop: trips, flows and documents from events in any order (T-03 ... T-05).

* ``chained_trips`` buffers events in a list state and releases them in a traveller's time order when the
  watermark has passed them (the state's key is a share of the travellers, so a call handles many at once), so files may hold events of several days, in any order within the delay.
  What the watermark has passed when it arrives is late: Spark drops and counts it, and
  ``late_events`` writes it to a side table.
* Every trip carries ``released``, the watermark at its release, as the event time of the steps behind:
  flow windows over it close, so no hour of the past is held (``flow_increments``; a trip may be
  released days after its hour began, hence an hour's flow is the sum of its increments).
* ``document_segments`` keeps one row for a traveller who travels and lets go of it ``idle`` after
  the last trip, giving out the segment of the document; a document is the sum of its segments, so
  state is held for the travellers of the last ``idle`` only.

``write_event_files`` deals a table of events to files that arrive one after the other and closes the
stream with marker events far in the future, so the watermark passes all events.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.indexing import stable_hash
from ..session import ensure_checkpoint_dir
from .ops import scratch_path
from .shares import PACKED, by_share, chain, event_table, instants, known_events, packed, starts, timeline, trip_rows, unpacked

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKER = "end of stream"
MARKERS = 3
MARKER_GAP = timedelta(days=365)

TRIP = ("user_id long, event_id long, ts timestamp, txn_type string, origin int, dest int, hour int, tsu long, released timestamp")
SEGMENT = "user_id long, subtype string, wordcount long, first_tsu long, first_id long, closed timestamp"
DOCUMENT = pa.schema([("user_id", pa.int64()), ("tsu", pa.int64()), ("event_id", pa.int64()), ("txn_type", pa.string()), ("wordcount", pa.int64()), ("timer", pa.int64())])


class TripChainer(StatefulProcessor):
    """Events of a share of the travellers, in any order, to trips in each one's time order; see ``chained_trips``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.last = handle.getValueState("last", PACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            pdf = pdf[pdf["txn_type"] != MARKER]
            if len(pdf):
                self.waiting.appendValue(packed(event_table(pdf)))
                first = min(x for x in (first, int(pdf["tsu"].min())) if x is not None)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        now = timerValues.getCurrentWatermarkInMs()
        events = pa.concat_tables([unpacked(v) for v in self.waiting.get()])
        passed = pc.less_equal(events["tsu"], 1000 * now)
        ready, rest = events.filter(passed), events.filter(pc.invert(passed))
        if len(ready):
            if len(rest):
                self.waiting.put([packed(rest)])
            else:
                self.waiting.clear()
            before = unpacked(self.last.get()) if self.last.exists() else ready.slice(0, 0)
            rows, at, ends = chain(before, ready)
            self.last.update(packed(rows.take(pa.array(ends))))
            if len(at):
                yield trip_rows(rows, at).assign(released=instants([1000 * now] * len(at)))
        if len(rest):
            self.handle.registerTimer(-(-pc.min(rest["tsu"]).as_py() // 1000))

    def close(self) -> None:
        pass


def chained_trips(events: DataFrame, delay: str, shares: int | None = None) -> DataFrame:
    """``TRIP``: the trips of an event stream (all types; filter behind), each once, in a traveller's time order."""
    known = known_events(events).withWatermark("ts", delay)
    return by_share(known, shares).transformWithStateInPandas(
        TripChainer(), TRIP, "Append", "eventTime", eventTimeColumnName="released")


def flow_increments(trips: DataFrame, window: str = "1 hour") -> DataFrame:
    """T-03: per hour of origin, origin and destination the trips released within a window; closed windows leave the state."""
    hour = F.timestamp_micros(F.expr("tsu - pmod(tsu, 3600000000)"))
    return trips.groupBy(F.window("released", window).alias("w"), hour.alias("bin_start"), "origin", "dest").agg(F.count(F.lit(1)).alias("n")).select(
        "bin_start", "origin", "dest", "n")


class DocumentGrower(StatefulProcessor):
    """Trips of a share of the travellers to segments of their documents; see ``document_segments``."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = handle.getValueState("documents", PACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer = max(timerValues.getCurrentWatermarkInMs(), 0) + self.idle_ms
        parts = [pa.Table.from_pandas(pdf.assign(wordcount=1, timer=timer)[DOCUMENT.names], DOCUMENT, preserve_index=False) for pdf in rows if len(pdf)]
        if parts:
            held = [unpacked(self.documents.get())] if self.documents.exists() else []
            grown = timeline(pa.concat_tables([*held, *parts]))
            first = starts(grown["user_id"].to_numpy())
            now = grown.take(pa.array(first)).drop_columns(["wordcount", "timer"])      # a traveller's first trip, and what the rows add up to
            now = now.append_column("wordcount", pa.array(np.add.reduceat(grown["wordcount"].to_numpy(), first)))
            now = now.append_column("timer", pa.array(np.maximum.reduceat(grown["timer"].to_numpy(), first)))
            self.documents.update(packed(now))
            self.handle.registerTimer(timer)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.documents.exists():
            return
        held = unpacked(self.documents.get())
        idle = pc.less_equal(held["timer"], expiredTimerInfo.getExpiryTimeInMs())
        done, rest = held.filter(idle), held.filter(pc.invert(idle))
        if not len(done):
            return
        if len(rest):
            self.documents.update(packed(rest))
        else:
            self.documents.clear()
        done = done.to_pandas()
        yield pd.DataFrame({"user_id": done["user_id"], "subtype": done["txn_type"], "wordcount": done["wordcount"], "first_tsu": done["tsu"],
                            "first_id": done["event_id"], "closed": instants([1000 * timerValues.getCurrentWatermarkInMs()] * len(done))})

    def close(self) -> None:
        pass


def document_segments(trips: DataFrame, idle: timedelta, shares: int | None = None) -> DataFrame:
    """T-05: ``SEGMENT``s of the travellers' documents, given out ``idle`` after a traveller's last trip."""
    return by_share(trips, shares).transformWithStateInPandas(
        DocumentGrower(int(idle.total_seconds() * 1000)), SEGMENT, "Append", "eventTime", eventTimeColumnName="closed")


def documents(segments: DataFrame) -> DataFrame:
    """user_id, subtype (type of the first trip), wordcount from all segments."""
    return segments.groupBy("user_id").agg(
        F.min_by("subtype", F.struct("first_tsu", "first_id")).alias("subtype"), F.sum("wordcount").alias("wordcount"))


# --- sources and sinks -----------------------------------------------------------------------

def write_event_files(events: DataFrame, path: str, files: int, jitter_hours: int = 6, seed: int = 11) -> str:
    """Write ``events`` as ``files`` parts that arrive one after the other, then ``MARKERS`` closing events.

    An event arrives up to ``jitter_hours`` after its time (by a hash of its id), so days overlap between
    parts and a part's rows are in no order; a watermark delay of more than the jitter loses nothing."""
    late = stable_hash("event_id", seed) % F.lit(jitter_hours * 3600)
    at = F.unix_micros(F.col("ts").cast("timestamp")) + late.cast("long") * 1_000_000
    first, last = events.select(F.min(at), F.max(at)).first()
    columns = events.columns
    if first is None:
        events.limit(0).write.parquet(f"{path}/part-0000")
        return path
    step = (last - first) // files + 1
    dealt = events.withColumn("_part", ((at - F.lit(first)) / F.lit(step)).cast("int"))
    for i in range(files):
        dealt.where(F.col("_part") == i).select(*columns).orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{path}/part-{i:04d}")
    close_stream(events, path, last)
    return path


def close_stream(events: DataFrame, path: str, last_us: int) -> None:
    """Add the marker events (user -1): each pushes the watermark of one more step behind past everything before it."""
    spark = events.sparkSession
    types = dict(events.dtypes)
    for i in range(MARKERS):
        at = last_us + (i + 1) * int(MARKER_GAP.total_seconds()) * 1_000_000
        fixed = {"ts": F.timestamp_micros(F.lit(at)), "user_id": F.lit(-1), "event_id": F.lit(-1 - i), "event_type": F.lit(MARKER)}
        row = spark.range(1).select(*[fixed.get(c, F.lit(None)).cast(types[c]).alias(c) for c in events.columns])
        row.coalesce(1).write.parquet(f"{path}/part-end-{i}")


def read_event_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """The parts as a stream, one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part-*")


@dataclass
class Progress:
    """What the state operators of a run did."""

    batches: int = 0
    rows_evicted: int = 0
    rows_late: int = 0
    state_rows: int = 0         # held after the last batch
    most_state_rows: int = 0


def run_appending(stream: DataFrame, path: str, name: str) -> Progress:
    """Run all that is there into ``path`` (one folder a batch, overwritten if the batch is replayed)."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    schema = stream.schema
    try:
        query = (stream.writeStream.outputMode("append")
                 .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"))
                 .option("checkpointLocation", scratch_path(spark, f"ckpt-{name}")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    out = Progress()
    for p in query.recentProgress:
        ops = p["stateOperators"]
        out.batches += 1
        out.rows_evicted += sum(o["numRowsRemoved"] for o in ops)
        out.rows_late += sum(o["numRowsDroppedByWatermark"] for o in ops)
        out.state_rows = sum(o["numRowsTotal"] for o in ops)
        out.most_state_rows = max(out.most_state_rows, out.state_rows)
    if not out.batches:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    return out


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an appending run."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def late_events(stream: DataFrame, delay: timedelta, path: str) -> int:
    """Write the events that arrive behind the watermark of the earlier files to ``path``; returns their number.

    A state operator drops what the batch before had passed: the watermark of batch k comes from the files of
    the batches before k, and batch k + 1 counts as late what lies at or before it.  Each batch's latest time is a file of its own, so a replayed batch finds the same one."""
    spark = stream.sparkSession
    marks = f"{ensure_checkpoint_dir(spark).rstrip('/')}/late-marks-{uuid.uuid4().hex}"
    delay_us = int(delay.total_seconds() * 1_000_000)
    mark = "batch long, latest long"

    def write(df: DataFrame, batch: int) -> None:
        timed = known_events(df)
        done = spark.read.schema(mark).parquet(f"{marks}/*").where(F.col("batch") < batch - 1).agg(F.max("latest")).first()[0] if batch > 1 else None
        found = timed if done is not None else timed.limit(0)
        found.where(F.col("tsu") <= F.lit(-(2 ** 62) if done is None else (done // 1000) * 1000 - delay_us)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        latest = timed.agg(F.max("tsu")).first()[0]
        spark.createDataFrame([(batch, latest)], mark).write.mode("overwrite").parquet(f"{marks}/{batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "ckpt-late")).trigger(availableNow=True).start()
    query.awaitTermination()
    return appended(spark, path).count()
