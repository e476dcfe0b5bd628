"""Streams in event time: events in any order within the delay give the batch result, and state is let go."""

import tempfile
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tables import SF_SMALL
from triptopics.operators import flow
from triptopics.session import table
from triptopics.sources.fixtures import trips_from_events, used_trips
from triptopics.streaming import event_time as et
from triptopics.streaming import ops as so


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def events(spark):
    """Events without a station among them; a third of the travellers pause in the middle of the time."""
    ev = table(spark, SF_SMALL, "events")
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    ev = ev.where(~((F.col("user_id") % 3 == 0) & F.col("ts").between(F.lit(first + third * 0.9), F.lit(last - third * 0.9))))
    return ev.withColumn("props", F.when(F.col("event_id") % 9 == 0, F.lit("{}")).otherwise(F.col("props")))


@pytest.fixture(scope="module")
def files(spark, events):
    return et.write_event_files(events, tempfile.mkdtemp(prefix="tt-events-"), 3)


def rows(df):
    return sorted(map(str, df.collect()))


def test_files_overlap_and_hold_all_events(spark, events, files):
    parts = [spark.read.schema(events.schema).parquet(f"{files}/part-{i:04d}") for i in range(3)]
    spans = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert sum(p.count() for p in parts) == events.count()
    assert all(a[1] > b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
    times = [r.ts for r in parts[0].select("ts").collect()]
    assert times != sorted(times)


def test_flow_of_permuted_files_equals_batch(spark, events, files):
    sink = tempfile.mkdtemp(prefix="tt-sink-")
    stream = et.flow_increments(so.used(et.chained_trips(et.read_event_files(spark, files, events.schema), "8 hours")))
    done = et.run_appending(stream, sink, "flow")
    got = et.appended(spark, sink).groupBy("bin_start", "origin", "dest").agg(F.sum("n").alias("amount"))
    want = flow.od_flow_hourly(used_trips(trips_from_events(events)))
    assert rows(got.select(F.col("bin_start").cast("timestamp_ntz"), "origin", "dest", "amount")) == rows(want)
    assert done.rows_evicted > 0 and done.rows_late == 0 and done.state_rows < done.most_state_rows


def test_documents_expire_and_equal_batch(spark, events, files):
    sink = tempfile.mkdtemp(prefix="tt-sink-")
    trips = so.used(et.chained_trips(et.read_event_files(spark, files, events.schema), "8 hours"))
    done = et.run_appending(et.document_segments(trips, timedelta(days=2)), sink, "docs")
    segments = et.appended(spark, sink)
    used = used_trips(trips_from_events(events))
    want = used.groupBy("user_id").agg(F.min_by("txn_type", F.struct("ts", "event_id")).alias("subtype"), F.count(F.lit(1)).alias("wordcount"))
    assert rows(et.documents(segments)) == rows(want)
    assert segments.count() > want.count() > 0                      # some documents expired and began again
    assert done.rows_late == 0


def test_late_events_are_dropped_counted_and_kept_aside(spark, events, files):
    src = tempfile.mkdtemp(prefix="tt-late-")
    days = events.agg(F.min("ts"), F.max("ts")).first()
    middle = days[0] + (days[1] - days[0]) / 2
    old = events.where(F.col("ts") < F.lit(middle)).where("event_id % 10 = 3")
    rest = events.join(old, "event_id", "left_anti").select(*events.columns)
    rest.where("event_id % 50 > 0").coalesce(1).write.parquet(f"{src}/part-0000")
    rest.where("event_id % 50 = 0").coalesce(1).write.parquet(f"{src}/part-0001")
    old.coalesce(1).write.parquet(f"{src}/part-0002")
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    et.close_stream(events, src, last)
    sink, aside = tempfile.mkdtemp(prefix="tt-sink-"), tempfile.mkdtemp(prefix="tt-aside-")
    done = et.run_appending(et.chained_trips(et.read_event_files(spark, src, events.schema), "8 hours"), sink, "late")
    n = et.late_events(et.read_event_files(spark, src, events.schema), timedelta(hours=8), aside)
    assert n == done.rows_late == old.count() > 0
    assert {r.event_id for r in et.appended(spark, aside).select("event_id").collect()} == {r.event_id for r in old.select("event_id").collect()}
    kept = trips_from_events(events.join(old, "event_id", "left_anti").select(*events.columns))
    columns = ["user_id", "event_id", "origin", "dest", "hour"]
    assert rows(et.appended(spark, sink).select(*columns)) == rows(kept.select(*columns))


def test_no_events(spark, events):
    src = et.write_event_files(events.limit(0), tempfile.mkdtemp(prefix="tt-none-"), 3)
    sink = tempfile.mkdtemp(prefix="tt-sink-")
    et.run_appending(et.chained_trips(et.read_event_files(spark, src, events.schema), "8 hours"), sink, "none")
    assert et.appended(spark, sink).count() == 0


class Value:
    """State variables of one key, kept here."""

    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0]

    def update(self, value):
        self.held = [value]

    def clear(self):
        self.held = []


class Values(Value):
    def get(self):
        return iter(self.held)

    def appendValue(self, value):
        self.held.append(value)

    def put(self, values):
        self.held = list(values)


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return Values()

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_one_call_chains_all_travellers_of_a_share():
    chainer, grower = et.TripChainer(), et.DocumentGrower(10)
    for p in (chainer, grower):
        p.init(Handle())

    def frame(*rows):
        return pd.DataFrame(rows, columns=["user_id", "tsu", "event_id", "txn_type", "k", "hour"]).astype({"k": "Int32", "event_id": "Int64"})

    list(chainer.handleInputRows((0,), [frame((2, 5000, 1, "view", 7, 0), (1, 3000, 2, "click", 4, 0)), frame(
        (1, 1000, 3, None, 5, 0), (2, 9000, 4, "view", 8, 0), (1, 2000, None, "view", None, 0), (-1, 10 ** 9, -1, et.MARKER, None, 0))], Clock(-1)))
    (out,) = chainer.handleExpiredTimer((0,), Clock(5), Clock(5))
    assert out[["user_id", "origin", "dest", "tsu"]].astype(object).where(out.notna(), None).values.tolist() == [[1, None, 4, 2000]]
    list(grower.handleInputRows((0,), [out], Clock(5)))
    list(chainer.handleInputRows((0,), [frame((1, 8000, 5, "view", 6, 0), (2, 20000, 6, "view", 1, 0))], Clock(5)))
    (out,) = chainer.handleExpiredTimer((0,), Clock(9), Clock(9))
    assert out[["user_id", "event_id", "txn_type", "origin", "dest"]].values.tolist() == [[1, 2, "click", 4, 6], [2, 1, "view", 7, 8]]
    assert chainer.handle.timers == [1, 9, 8, 20]
    list(grower.handleInputRows((0,), [out], Clock(9)))
    assert list(grower.handleExpiredTimer((0,), Clock(16), Clock(15))) == []
    (done,) = grower.handleExpiredTimer((0,), Clock(19), Clock(19))
    assert done[["user_id", "subtype", "wordcount", "first_tsu"]].values.tolist() == [[1, "view", 2, 2000], [2, "view", 1, 5000]]
    assert not grower.documents.exists()
