"""Chaining by share of the travellers, for both streaming forms.

A stateful operator keyed by the traveller calls Python, and reads and writes its state, once a traveller in every
micro-batch.  Here the key is a share of the travellers: a call handles many at once, and their state is one Arrow table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.fixtures import event_stations

SHARE_EVENTS = 25_000       # events of a share of the travellers, in all files together

EVENT = pa.schema([("user_id", pa.int64()), ("tsu", pa.int64()), ("event_id", pa.int64()), ("txn_type", pa.string()), ("k", pa.int32()), ("hour", pa.int32())])
PACKED = "packed binary"


def share_count(spark: SparkSession, events: int) -> int:
    """Shares of the travellers for a stream of about ``events`` events: some for every partition, and no large ones."""
    return max(4 * shuffle_partitions(spark), -(-events // SHARE_EVENTS))


def by_share(df: DataFrame, shares: int | None) -> GroupedData:
    """``df`` by share of the travellers, a function of the traveller alone: one call and one state a share, not a
    traveller.  A checkpoint belongs to its number of shares."""
    return df.withColumn("share", F.pmod(F.xxhash64("user_id"), F.lit(shares or share_count(df.sparkSession, 0)))).groupBy("share")


def event_frame(events: DataFrame) -> DataFrame:
    """Columns of the chaining: the hour is the wall-clock hour, whatever the session's time zone."""
    e = event_stations(events).withColumnRenamed("origin", "k").withColumn("hour", F.hour("ts"))
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("tsu", F.unix_micros("ts"))


def known_events(events: DataFrame) -> DataFrame:
    """``event_frame`` without events that lack a traveller or a time: they belong to no timeline."""
    return event_frame(events).where("user_id IS NOT NULL AND ts IS NOT NULL")


def instants(micros: np.ndarray | list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(np.asarray(micros, np.int64), unit="us", utc=True))


def packed(table: pa.Table) -> tuple[bytes]:
    """A table as one state value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def unpacked(value: tuple) -> pa.Table:
    return pa.ipc.open_stream(bytes(value[0])).read_all()


def event_table(pdf: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(pdf[EVENT.names], EVENT, preserve_index=False)


def timeline(table: pa.Table, *before: np.ndarray) -> pa.Table:
    """Rows by traveller, then ``before``, time and event (null first); equal ones stay in order."""
    keys = [table["event_id"].fill_null(-(2 ** 63)).to_numpy(), table["tsu"].to_numpy(), *before, table["user_id"].to_numpy()]
    return table.take(pa.array(np.lexsort(keys)))


def starts(users: np.ndarray) -> np.ndarray:
    """Where each traveller's rows begin."""
    return np.flatnonzero(np.append(True, users[1:] != users[:-1]))


def chain(held: pa.Table, events: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """``held`` rows, then ``events`` (at least one), in each traveller's time order; the rows that a trip begins with,
    its destination being the next row's station; and each traveller's last row."""
    rows = timeline(pa.concat_tables([held, events]), np.repeat([0, 1], [len(held), len(events)]))
    users, k = rows["user_id"].to_numpy(), rows["k"]
    same = np.append(users[1:] == users[:-1], False)
    same[:-1] &= k.is_valid().to_numpy()[1:]                # as in the batch form, a trip ends at a known station
    return rows, np.flatnonzero(same), np.append(starts(users)[1:], len(users)) - 1


def trip_rows(rows: pa.Table, heads: np.ndarray) -> pd.DataFrame:
    """The trips of a chain, with ``tsu`` behind."""
    trips = rows.take(pa.array(heads)).to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}.get)
    return pd.DataFrame({
        "user_id": trips["user_id"], "event_id": trips["event_id"], "ts": instants(trips["tsu"]), "txn_type": trips["txn_type"],
        "origin": trips["k"], "dest": pd.array(rows["k"].take(pa.array(heads + 1)).to_numpy(), "Int32"), "hour": trips["hour"],
        "tsu": trips["tsu"]})
