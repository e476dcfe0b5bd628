"""Stream = batch when events arrive as several files (several micro-batches)."""

import tempfile

from pyspark.sql import functions as F

from tables import SF_SMALL
from triptopics.operators import flow
from triptopics.session import table
from triptopics.sources.fixtures import trips_from_events, used_trips
from triptopics.streaming import ops as so


def test_od_flow_stream_equals_batch_over_daily_files(spark):
    src = tempfile.mkdtemp(prefix="tt-events-")
    ev = table(spark, SF_SMALL, "events")
    days = sorted(r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())
    for i, d in enumerate(days[:6]):
        ev.filter(F.to_date("ts") == d).coalesce(1).write.parquet(f"{src}/part{i:02d}")
    rest = ev.filter(F.to_date("ts") > days[5]).coalesce(1)
    rest.write.parquet(f"{src}/part99")
    schema = ev.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part*"))
    sink = tempfile.mkdtemp(prefix="tt-sink-")
    so.run_to_end(so.od_flow_stream(so.used(so.chain_trips(stream, "2 hours"))), sink, "update", "t")
    got = so.latest(spark, sink, ["bin_start", "origin", "dest"]).select(
        F.col("bin_start").cast("timestamp_ntz"), "origin", "dest", "amount")
    ref = flow.od_flow_hourly(used_trips(trips_from_events(ev)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_rebinned_stream_equals_batch_over_daily_files(spark):
    src = tempfile.mkdtemp(prefix="tt-events7-")
    ev = table(spark, SF_SMALL, "events")
    days = sorted(r[0] for r in ev.select(F.to_date("ts").alias("d")).distinct().collect())
    for i, d in enumerate(days[:5]):
        ev.filter(F.to_date("ts") == d).coalesce(1).write.parquet(f"{src}/part{i:02d}")
    ev.filter(F.to_date("ts") > days[4]).coalesce(1).write.parquet(f"{src}/part99")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part*")
    sink = tempfile.mkdtemp(prefix="tt-sink7-")
    so.run_to_end(so.od_flow_rebinned_stream(so.used(so.chain_trips(stream, "2 hours"))), sink, "update", "t7")
    got = so.latest(spark, sink, ["w", "bin", "origin", "dest"]).select("sday", "origin", "dest", "bin", "amount")
    ref = flow.od_flow_rebinned(used_trips(trips_from_events(ev)), 7).select("sday", "origin", "dest", "bin", "amount")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_empty_stream_gives_empty_table(spark):
    src = tempfile.mkdtemp(prefix="tt-empty-")
    ev = table(spark, SF_SMALL, "events")
    ev.limit(0).write.parquet(f"{src}/part00")
    stream = spark.readStream.schema(ev.schema).parquet(f"{src}/part*")
    sink = tempfile.mkdtemp(prefix="tt-sink-empty-")
    so.run_to_end(so.doc_stream(stream), sink, "update", "empty")
    out = so.latest(spark, sink, ["user_id"])
    assert out is not None and out.count() == 0 and "wordcount" in out.columns


def test_events_without_a_station_end_no_trip(spark):
    src = tempfile.mkdtemp(prefix="tt-null-")
    ev = table(spark, SF_SMALL, "events").filter("user_id < 6").withColumn(
        "props", F.when(F.col("event_id") % 5 == 0, F.lit("{}")).otherwise(F.col("props")))
    days = ev.withColumn("_half", F.dayofmonth("ts") > 15)
    days.filter("not _half").drop("_half").coalesce(1).write.parquet(f"{src}/part0")
    days.filter("_half").drop("_half").coalesce(1).write.parquet(f"{src}/part1")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part*")
    sink = tempfile.mkdtemp(prefix="tt-sink-null-")
    so.run_to_end(so.chain_trips(stream), sink, "append", "null")
    got = spark.read.parquet(f"{sink}/batch=*").select("user_id", "event_id", "origin", "dest")
    ref = trips_from_events(ev).select("user_id", "event_id", "origin", "dest")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, ref.collect()), key=key)
    assert got.filter("origin is null").count() > 0


def test_learner_counts_only_batches_with_trips_and_resumes(spark):
    from triptopics.operators.topics.fit import TensorLDAConfig, init_model
    from triptopics.operators.topics.model import corpus_from_trips
    from triptopics.sources.fixtures import trips
    from triptopics.streaming.online import stream_online_lda

    cfg = TensorLDAConfig(J=2, K=2, L=2, iter_inference=2)
    model = init_model(corpus_from_trips(trips(spark, SF_SMALL)), cfg)
    src = tempfile.mkdtemp(prefix="tt-first-")
    ev = table(spark, SF_SMALL, "events")
    first = ev.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    ev.join(first, ["user_id", "event_id"], "left_semi").coalesce(1).write.parquet(f"{src}/part0")
    ev.join(first, ["user_id", "event_id"], "left_anti").coalesce(1).write.parquet(f"{src}/part1")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part*")
    path, history = stream_online_lda(so.used(so.chain_trips(stream)), model, cfg)
    saved = spark.read.parquet(path).groupBy("v").agg(F.max("steps").alias("steps")).orderBy("v").collect()
    assert [r.steps for r in saved][:2] == [0, 1]            # a first batch of single events has no trip


def test_online_metrics_score_all_held_out_travellers(spark, monkeypatch):
    """Every test traveller is scored after each micro-batch, and none of them is in the stream."""
    from triptopics.plans import q_stream
    from triptopics.plans.q_fits import TRAIN_FRACTION
    from triptopics.sources.fixtures import trips

    seen, score = [], q_stream._holdout_metrics

    def spy(session, model, docs, cfg):
        seen.append({r.user_id for r in docs.select("user_id").distinct().collect()})
        return score(session, model, docs, cfg)

    monkeypatch.setattr(q_stream, "_holdout_metrics", spy)
    rows = q_stream.q_stream_online_metrics(spark, SF_SMALL).collect()
    users = sorted(r.user_id for r in trips(spark, SF_SMALL).select("user_id").distinct().collect())
    n_train = int(len(users) * TRAIN_FRACTION)
    assert seen and all(s == set(users[n_train:]) for s in seen)
    n_docs = {r.batch: r.n_docs for r in rows}
    assert len(seen) == len(n_docs) and 0 < max(n_docs.values()) <= n_train
    for b in n_docs:
        got = {r.name: r.value for r in rows if r.batch == b}
        assert set(got) == {"batch_elbo", "holdout_elbo", "perplexity_O", "perplexity_D", "perplexity_T"}
        assert got["holdout_elbo"] < 0 and all(v > 1 for k, v in got.items() if k.startswith("perplexity"))
