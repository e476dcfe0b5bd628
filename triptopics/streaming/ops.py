"""Structured Streaming forms of the trip pipeline (T-01 ... T-05).

* ``chain_trips``: events of a traveller become trips as they arrive; the
  state is the last event of each traveller, kept by share of the travellers
  in ``applyInPandasWithState``; events of a traveller are assumed to
  arrive in time order (a file or partition per day, as the fare files).
* ``od_flow_stream``: hourly OD flow (T-03).  The watermark given to
  ``chain_trips`` does not pass through the stateful chaining, so it evicts
  no hour of the flow and drops no late row; state grows with the hours.
* ``cohort_stream``: stream-static left-semi join with the cohort (T-04).
* ``doc_stream``: growing passenger documents: per traveller the word
  count and subtype, updated as trips arrive (T-05).
* ``online_lda_stream``: ``foreachBatch`` that runs one online update per
  micro-batch (T-01, T-02); β versions are parquet folders keyed by the
  batch id, so a replayed batch finds its version and is skipped.

Sinks are idempotent upserts: every micro-batch writes its updated rows
under ``batch=<id>`` (overwrite), and the current table is the latest
row per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.indexing import guarded_broadcast
from ..session import ensure_checkpoint_dir
from .shares import EVENT, PACKED, by_share, chain, event_table, known_events, packed, trip_rows, unpacked

CHAIN_OUT = ("user_id long, event_id long, ts timestamp, txn_type string, origin int, dest int, hour int")
DOC_OUT = "user_id long, subtype string, wordcount long"
DOC_STATE = EVENT.append(pa.field("subtype", pa.string())).append(pa.field("wordcount", pa.int64()))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Event files as a stream (one file per trigger), timestamps as event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
         .option("basePath", sf_dir).parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))
    return s


def _arrived(pdfs: Iterator[pd.DataFrame]) -> pa.Table:
    return pa.concat_tables([EVENT.empty_table(), *(event_table(pdf) for pdf in pdfs if len(pdf))])


def chain_trips(events: DataFrame, watermark: str | None = None, shares: int | None = None) -> DataFrame:
    """Stateful chaining of an event stream into trips (all types; filter later).

    A traveller's last event goes before this batch's events, which are taken in time order."""
    e = known_events(events)
    if watermark:
        e = e.withWatermark("ts", watermark)

    def fn(key, pdfs, state):
        new = _arrived(pdfs)
        if not len(new):
            return
        rows, heads, ends = chain(unpacked(state.get) if state.exists else EVENT.empty_table(), new)
        state.update(packed(rows.take(pa.array(ends))))
        if len(heads):
            yield trip_rows(rows, heads).drop(columns="tsu")

    return by_share(e, shares).applyInPandasWithState(fn, CHAIN_OUT, PACKED, "append", GroupStateTimeout.NoTimeout)


def used(trips: DataFrame) -> DataFrame:
    return trips.filter(F.col("txn_type") != "error")


def od_flow_stream(trips: DataFrame) -> DataFrame:
    """T-03: trips per (hour window, origin, destination); needs a watermark on ``ts``."""
    return trips.groupBy(F.window("ts", "1 hour").getField("start").alias("bin_start"), "origin", "dest").agg(
        F.count(F.lit(1)).alias("amount"))


def od_flow_rebinned_stream(trips: DataFrame, bin_hours: int = 7, start_hour: int = 5,
                            service_hours: int = 21) -> DataFrame:
    """T-03 with n-hour bins anchored at the service-day start (Q20).

    Grouped by a one-day event-time window starting at ``start_hour`` (so the
    watermark can evict finished service days) plus the computed bin;
    hours outside the service calendar are dropped as in the batch form.
    """
    off = F.pmod(F.col("hour") - F.lit(start_hour), F.lit(24))
    day = F.window("ts", "1 day", "1 day", f"{start_hour} hours")
    return (trips.withColumn("_off", off).filter(F.col("_off") < service_hours)
            .groupBy(day.alias("w"), F.floor(F.col("_off") / bin_hours).cast("int").alias("bin"), "origin", "dest")
            .agg(F.count(F.lit(1)).alias("amount"))
            .select(F.to_date(F.col("w.start")).alias("sday"), "bin", "origin", "dest", "amount", "w"))


def cohort_stream(trips: DataFrame, cohort: DataFrame, size: int) -> DataFrame:
    """T-04: stream-static left-semi join; the cohort (at most ``size`` users) is broadcast."""
    return trips.join(guarded_broadcast(cohort, size), "user_id", "left_semi")


def doc_stream(events: DataFrame, shares: int | None = None) -> DataFrame:
    """T-05: chain events and grow each traveller's document summary (used trips only)."""

    def fn(key, pdfs, state):
        new = _arrived(pdfs)
        if not len(new):
            return
        held = unpacked(state.get) if state.exists else DOC_STATE.empty_table()
        rows, heads, ends = chain(held.select(EVENT.names), new)
        users, types = rows["user_id"].to_numpy(), rows["txn_type"].to_numpy()
        travellers = users[ends]
        used_rows = heads[types[heads] != "error"]
        owner = np.searchsorted(travellers, users[used_rows])
        wordcount = np.bincount(owner, minlength=len(travellers))
        subtype = np.full(len(travellers), None, dtype=object)
        with_used, first = np.unique(owner, return_index=True)
        subtype[with_used] = types[used_rows[first]]
        before = held["wordcount"].to_numpy()
        known = np.searchsorted(travellers, held["user_id"].to_numpy())
        wordcount[known] += before
        subtype[known[before > 0]] = held["subtype"].to_numpy()[before > 0]      # the first used trip's stays
        last = rows.take(pa.array(ends))
        state.update(packed(pa.table([*last.columns, pa.array(subtype, pa.string()), pa.array(wordcount)], schema=DOC_STATE)))
        out = (wordcount > 0) & np.isin(travellers, new["user_id"].to_numpy())
        if out.any():
            yield pd.DataFrame({"user_id": travellers[out], "subtype": subtype[out], "wordcount": wordcount[out]})

    return by_share(known_events(events), shares).applyInPandasWithState(fn, DOC_OUT, PACKED, "update", GroupStateTimeout.NoTimeout)


# ---- sinks -------------------------------------------------------------------

def upsert_sink(path: str):
    """foreachBatch writer: the micro-batch's rows under ``batch=<id>`` (overwrite = idempotent)."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current table of an upsert sink: the row of the latest batch per key."""
    try:
        df = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException:       # nothing written yet
        return None
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "batch")


def run_to_end(stream: DataFrame, sink_path: str, mode: str, name: str) -> None:
    """Process everything available now (batch trigger), checkpointing under the shared folder.

    If the stream had no data at all, an empty batch with the stream's
    schema is left in the sink, so readers get an empty table, not an error.
    """
    spark = stream.sparkSession
    q = (stream.writeStream.outputMode(mode).foreachBatch(upsert_sink(sink_path))
         .option("checkpointLocation", scratch_path(spark, f"ckpt-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        spark.read.parquet(f"{sink_path}/batch=*").limit(1).collect()
    except AnalysisException:
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{sink_path}/batch=-1")
