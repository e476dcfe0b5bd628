"""Replayed micro-batches must not change results (executor loss, restarts)."""

import tempfile

import numpy as np

from tables import SF_SMALL
from triptopics.operators.topics.fit import TensorLDAConfig, init_model
from triptopics.operators.topics.model import TopicModel, corpus_from_trips
from triptopics.sources.fixtures import trips
from triptopics.streaming import ops as so
from triptopics.streaming.online import _versions, latest_beta, stream_online_lda


def test_upsert_sink_replay_is_idempotent(spark):
    path = tempfile.mkdtemp(prefix="tt-upsert-")
    write = so.upsert_sink(path)
    df = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    write(df, 0)
    write(df, 0)                                   # replay of batch 0
    write(spark.createDataFrame([(2, 21)], "k int, v int"), 1)
    got = sorted(tuple(r) for r in so.latest(spark, path, ["k"]).select("k", "v").collect())
    assert got == [(1, 10), (2, 21)]


def test_online_learner_replay_keeps_one_version(spark):
    cfg = TensorLDAConfig(J=3, K=3, L=2, iter_inference=3)
    corpus = corpus_from_trips(trips(spark, SF_SMALL))
    model = init_model(corpus, cfg)
    stream = so.used(so.chain_trips(so.read_event_stream(spark, SF_SMALL)))
    path = tempfile.mkdtemp(prefix="tt-beta-") + "/beta"
    stream_online_lda(stream, model, cfg, model_path=path)
    first = latest_beta(spark, path).toPandas().sort_values(["dim", "topic", "word_id"])
    # a restart without the stream checkpoint replays batch 0 against the same β folder
    stream_online_lda(so.used(so.chain_trips(so.read_event_stream(spark, SF_SMALL))),
                      init_model(corpus, cfg), cfg, model_path=path)
    again = latest_beta(spark, path).toPandas().sort_values(["dim", "topic", "word_id"])
    assert _versions(spark, path) == [0]
    assert np.allclose(first["logp"].to_numpy(), again["logp"].to_numpy())
    m = TopicModel.from_beta_pandas(again, cfg.alpha)
    assert np.allclose(np.exp(m.log_bo).sum(axis=1), 1.0)
