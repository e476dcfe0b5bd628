"""The in-order streams keep state, and call Python, by share of the travellers."""

import tempfile

import pytest
from pyspark.sql import functions as F

from triptopics.session import shuffle_partitions
from triptopics.sources.fixtures import trips_from_events, used_trips
from triptopics.streaming import ops as so

TRAVELLERS = 300


@pytest.fixture(scope="module")
def files(spark):
    """Events of three files in time order, rows of a file in none: traveller 7 is in the first and last file only,
    8 in the last only, 9 begins with an error, every eleventh event has no station."""
    n = spark.range(12 * TRAVELLERS).withColumnsRenamed({"id": "event_id"})
    ev = n.select(
        "event_id", F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, cast(event_id * 601 as double))").alias("ts"),
        (F.col("event_id") % TRAVELLERS).alias("user_id"), F.expr("element_at(array('error', 'view', 'click', 'signup'), cast(1 + (event_id + event_id div 300) % 4 as int))").alias("event_type"),
        F.expr("cast(event_id as double)").alias("value"),
        F.expr("if(event_id % 11 = 0, '{}', concat('{\"k\": ', event_id * 7 % 50, '}'))").alias("props"))
    ev = ev.withColumn("part", F.expr(f"event_id div {4 * TRAVELLERS}")).filter("not (user_id = 7 and part = 1) and not (user_id = 8 and part < 2)").checkpoint()
    src = tempfile.mkdtemp(prefix="tt-shares-")
    for i in range(3):
        ev.filter(F.col("part") == i).drop("part").orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{src}/part{i}")
    return src, ev.drop("part")


def run(spark, files, stream, mode):
    """Sink and the state rows after the last batch of ``stream(events)``."""
    events = spark.readStream.schema(files[1].schema).option("maxFilesPerTrigger", 1).parquet(f"{files[0]}/part*")
    sink = tempfile.mkdtemp(prefix="tt-sink-")
    q = (stream(events).writeStream.outputMode(mode).foreachBatch(so.upsert_sink(sink))
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tt-ckpt-")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*"), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chained_trips_are_the_batch_forms_and_state_is_by_share(spark, files):
    got, state = run(spark, files, so.chain_trips, "append")
    columns = ["user_id", "event_id", "txn_type", "origin", "dest", "hour"]
    want = trips_from_events(files[1])
    assert rows(got.select(F.col("ts").cast("timestamp_ntz"), *columns)) == rows(want.select("ts", *columns))
    assert got.select("batch").distinct().count() == 3 and got.filter("origin is null").count() > 0
    assert 0 < state <= 4 * shuffle_partitions(spark) < TRAVELLERS


def test_documents_grow_over_batches_and_state_is_by_share(spark, files):
    got, state = run(spark, files, so.doc_stream, "update")
    used = used_trips(trips_from_events(files[1])).withColumn("part", F.expr(f"event_id div {4 * TRAVELLERS}"))
    last = got.groupBy("user_id").agg(F.max_by("subtype", "batch"), F.max("wordcount"))
    assert rows(last) == rows(used.groupBy("user_id").agg(F.min_by("txn_type", F.struct("ts", "event_id")), F.count("*")))
    assert sorted(r.batch for r in got.filter("user_id = 7").collect()) == [0, 2]       # given out with its own events only
    assert sorted(r.batch for r in got.filter("user_id = 8").collect()) == [2]
    assert got.groupBy("user_id").agg(F.count_distinct("subtype").alias("n")).filter("n > 1").count() == 0
    assert 0 < state <= 4 * shuffle_partitions(spark) < TRAVELLERS
