"""Queries of build step 10: streaming forms, run to the end of the available data.

Each builder starts a Structured Streaming query over the event files with
an ``availableNow`` trigger, waits for it, and returns the sink's current
table, which must equal the batch form (same SQL twin).
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import trips as tr
from ..operators.topics.fit import TensorLDAConfig, init_model
from ..operators.topics.model import corpus_from_trips
from ..session import table
from ..sources.fixtures import TRIPS_SQL, trips
from ..streaming import event_time as et
from ..streaming import ops as so
from ..streaming.online import latest_beta, stream_online_lda
from ..streaming.shares import share_count
from .catalog import query, with_views
from .q_fits import _holdout_metrics, _split_corpus
from .q_trips import COHORT_SEED, COHORT_SIZE, COHORT_SQL

T = {"trips": TRIPS_SQL}
WATERMARK = "2 hours"


def _shares(spark, sf) -> int:
    return share_count(spark, table(spark, sf, "events").count())


@query("stream_od_flow", with_views("""
SELECT date_trunc('hour', ts) AS bin_start, origin, dest, COUNT(*) AS amount
FROM trips GROUP BY 1, 2, 3""", **T), ("T-03", "A-03"))
def q_stream_od_flow(spark, sf):
    ev = so.read_event_stream(spark, sf)
    flow = so.od_flow_stream(so.used(so.chain_trips(ev, WATERMARK, _shares(spark, sf))))
    path = so.scratch_path(spark, "sink-od-flow")
    so.run_to_end(flow, path, "update", "od-flow")
    out = so.latest(spark, path, ["bin_start", "origin", "dest"])
    return out.select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), "origin", "dest", "amount")


@query("stream_od_flow_7h", with_views(f"""
SELECT strftime(CAST(ts - INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') AS sday, origin, dest,
       CAST(CAST(((HOUR(ts) - 5) % 24 + 24) % 24 AS INT) // 7 AS INT) AS bin, COUNT(*) AS amount
FROM trips WHERE ((HOUR(ts) - 5) % 24 + 24) % 24 < 21 GROUP BY 1, 2, 3, 4""", **T), ("T-03", "A-04"))
def q_stream_od_flow_7h(spark, sf):
    ev = so.read_event_stream(spark, sf)
    flow = so.od_flow_rebinned_stream(so.used(so.chain_trips(ev, WATERMARK, _shares(spark, sf))))
    path = so.scratch_path(spark, "sink-od-flow-7h")
    so.run_to_end(flow, path, "update", "od-flow-7h")
    out = so.latest(spark, path, ["w", "bin", "origin", "dest"])
    return out.select(F.date_format("sday", "yyyy-MM-dd").alias("sday"), "origin", "dest", "bin", "amount")


@query("stream_cohort_trips", with_views(
    "SELECT * FROM trips WHERE user_id IN (SELECT user_id FROM cohort)", **T, cohort=COHORT_SQL), ("T-04", "J-01"))
def q_stream_cohort_trips(spark, sf):
    cohort = tr.cohort(trips(spark, sf), COHORT_SIZE, COHORT_SEED).cache()
    cohort.count()
    ev = so.read_event_stream(spark, sf)
    s = so.cohort_stream(so.used(so.chain_trips(ev, shares=_shares(spark, sf))), cohort, COHORT_SIZE)
    path = so.scratch_path(spark, "sink-cohort")
    so.run_to_end(s, path, "append", "cohort")
    out = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    return out.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "txn_type",
                      "origin", "dest", "hour")


@query("stream_docs", with_views("""
SELECT user_id, arg_min(txn_type, (ts, event_id)) AS subtype, COUNT(*) AS wordcount FROM trips GROUP BY 1""", **T),
    ("T-05", "A-10"))
def q_stream_docs(spark, sf):
    ev = so.read_event_stream(spark, sf)
    path = so.scratch_path(spark, "sink-docs")
    so.run_to_end(so.doc_stream(ev, _shares(spark, sf)), path, "update", "docs")
    return so.latest(spark, path, ["user_id"]).select("user_id", "subtype", "wordcount")


@query("stream_online_lda", None, ("T-01", "T-02", "O-10"))
def q_stream_online_lda(spark, sf):
    cfg = TensorLDAConfig(iter_inference=10)
    corpus = corpus_from_trips(trips(spark, sf))      # fixed vocabulary of the network
    model = init_model(corpus, cfg)
    stream = so.used(so.chain_trips(so.read_event_stream(spark, sf), shares=_shares(spark, sf)))
    path, _ = stream_online_lda(stream, model, cfg)
    return latest_beta(spark, path)


@query("stream_online_metrics", None, ("T-02", "O-14"))
def q_stream_online_metrics(spark, sf):
    """The online learner with the hold-out ELBO and the three perplexities after every micro-batch: all test
    travellers are scored, and the stream holds the others only."""
    cfg = TensorLDAConfig(iter_inference=10)
    corpus, _, test_docs = _split_corpus(spark, trips(spark, sf))
    test_docs = test_docs.checkpoint()                # scored after each batch, split once
    held = test_docs.select("user_id").distinct().checkpoint()
    stream = so.used(so.chain_trips(so.read_event_stream(spark, sf), shares=_shares(spark, sf))).join(held, "user_id", "left_anti")
    _, history = stream_online_lda(stream, init_model(corpus, cfg), cfg,
                                   eval_fn=lambda m, _: _holdout_metrics(spark, m, test_docs, cfg))
    return spark.createDataFrame(history, "batch int, name string, value double, n_docs int")


# ---- event time through the chaining: files of overlapping days, rows in no order ---------------

EVENT_FILES = 4
DELAY = "8 hours"
IDLE = timedelta(days=3)


def _unordered_trips(spark, sf):
    """Used trips of the events dealt to files whose days overlap, chained in event time; and the shares of the travellers."""
    events = table(spark, sf, "events")
    shares = _shares(spark, sf)
    path = et.write_event_files(events, so.scratch_path(spark, "event-files"), EVENT_FILES)
    return so.used(et.chained_trips(et.read_event_files(spark, path, events.schema), DELAY, shares)), shares


@query("stream_flow_event_time", with_views("""
SELECT date_trunc('hour', ts) AS bin_start, origin, dest, COUNT(*) AS amount
FROM trips GROUP BY 1, 2, 3""", **T), ("T-03", "A-03"))
def q_stream_flow_event_time(spark, sf):
    path = so.scratch_path(spark, "sink-flow-event-time")
    et.run_appending(et.flow_increments(_unordered_trips(spark, sf)[0]), path, "flow-event-time")
    flow = et.appended(spark, path).groupBy("bin_start", "origin", "dest").agg(F.sum("n").alias("amount"))
    return flow.select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), "origin", "dest", "amount")


@query("stream_cohort_event_time", with_views(
    "SELECT * FROM trips WHERE user_id IN (SELECT user_id FROM cohort)", **T, cohort=COHORT_SQL), ("T-04", "J-01"))
def q_stream_cohort_event_time(spark, sf):
    cohort = tr.cohort(trips(spark, sf), COHORT_SIZE, COHORT_SEED).checkpoint()
    path = so.scratch_path(spark, "sink-cohort-event-time")
    et.run_appending(so.cohort_stream(_unordered_trips(spark, sf)[0], cohort, COHORT_SIZE), path, "cohort-event-time")
    return et.appended(spark, path).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "txn_type", "origin", "dest", "hour")


@query("stream_docs_event_time", with_views("""
SELECT user_id, arg_min(txn_type, (ts, event_id)) AS subtype, COUNT(*) AS wordcount FROM trips GROUP BY 1""", **T),
    ("T-05", "A-10"))
def q_stream_docs_event_time(spark, sf):
    path = so.scratch_path(spark, "sink-docs-event-time")
    trips, shares = _unordered_trips(spark, sf)
    et.run_appending(et.document_segments(trips, IDLE, shares), path, "docs-event-time")
    return et.documents(et.appended(spark, path))
