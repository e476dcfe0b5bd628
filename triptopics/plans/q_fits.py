"""Queries of build step 6 and the model-based parts of 7-8: fitted models.

These run iterative fits (a driver loop of Spark jobs over model-sized
state), so they have no SQL twin; ``tests/`` checks their properties and
a brute-force NumPy re-computation on small fixtures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import docs as dc
from ..operators import flow
from ..operators import metrics as mt
from ..operators import trips as tr
from ..operators.graph import to_station_graph
from ..operators.infer import destination_accuracy, predict_destinations
from ..operators.topics.fit import TensorLDAConfig, fit_batch, fit_grid, fit_online, infer_docs
from ..operators.topics.flat import fit_flat_lda
from ..operators.topics.model import Corpus, corpus_from_trips
from ..sources.fixtures import TRIPS_SQL, trips, trips_od
from .catalog import query, with_views
from .fixtures_model import nation_graph

CFG = TensorLDAConfig()                 # J/K/L 10/10/4, α 5, λ 0.1, ≤ 11 EM passes, ≤ 21 sweeps
ONLINE_CFG = TensorLDAConfig(iter_inference=10)
MU = NU = 0.5
TRAIN_FRACTION = 0.8
FLAT_TOPICS = 5
ONLINE_BATCHES = 4          # mini-batches an epoch, whatever the number of travellers
LAMBDAS = (0.2, 0.1)


def _split_corpus(spark, t):
    corpus = corpus_from_trips(t)              # vocabulary from all documents (Q31), so no hold-out trip is lost
    users = corpus.users.checkpoint()
    n_train = int(users.count() * TRAIN_FRACTION)
    split = tr.train_test_split(users, n_train)
    sp = split.select("user_id", "split")
    tr_docs = corpus.docs.join(sp.filter(F.col("split") == "train"), "user_id", "left_semi")
    te_docs = corpus.docs.join(sp.filter(F.col("split") == "test"), "user_id", "left_semi").checkpoint()    # read by every metric
    return corpus, tr_docs, te_docs


def _graphs(spark, sf, corpus: Corpus):
    _, _, mixed = nation_graph(spark, sf, MU)
    g = to_station_graph(mixed.toPandas(), corpus.stations)
    return g


def _holdout_metrics(spark, model, test_docs, cfg):
    """Hold-out ELBO and per-dimension perplexity (O-14, O-17)."""
    inferred = infer_docs(test_docs, model, cfg).cache()
    out = [("holdout_elbo", float(inferred.agg(F.sum("elbo")).first()[0] or 0.0))]
    for dim, col, mat in (("O", "o", model.log_bo), ("D", "d", model.log_bd), ("T", "t", model.log_bt)):
        z, w = np.indices(mat.shape)
        beta = spark.createDataFrame(pd.DataFrame({"topic": z.ravel().astype(np.int32),
                                                   "word": w.ravel().astype(np.int32),
                                                   "p": np.exp(mat).ravel()}))
        counts = inferred.select("user_id", F.posexplode(f"cz_{col}").alias("topic", "count"))
        words = test_docs.groupBy("user_id", F.col(col).alias("word")).agg(F.sum("cnt").alias("cnt"))
        p = mt.perplexity(words, counts, beta, cfg.alpha, mat.shape[0]).first()[0]
        out.append((f"perplexity_{dim}", float(p)))
    inferred.unpersist()
    return out


@query("tensor_lda_fit", None, ("O-05", "O-06", "O-07", "O-09", "S-07"))
def q_tensor_lda_fit(spark, sf):
    corpus = corpus_from_trips(trips(spark, sf))
    return fit_batch(corpus, CFG).beta_frame(spark)


@query("tensor_lda_legacy_fit", None, ("O-05", "O-09", "Q7"))
def q_tensor_lda_legacy_fit(spark, sf):
    """The reference's own E-step update (stale last-trip buffers) instead of the mean-field one."""
    corpus = corpus_from_trips(trips(spark, sf), with_last=True)
    cfg = TensorLDAConfig(mode="legacy")
    return fit_batch(corpus, cfg).history_frame(spark)


@query("tensor_lda_graph_fit", None, ("O-08", "O-09", "G-02"))
def q_tensor_lda_graph_fit(spark, sf):
    corpus = corpus_from_trips(trips_od(spark, sf))
    g = _graphs(spark, sf, corpus)
    return fit_batch(corpus, CFG, graph_o=g, graph_d=g).beta_frame(spark)


@query("tensor_lda_history", None, ("O-14", "O-17"))
def q_tensor_lda_history(spark, sf):
    corpus, tr_docs, te_docs = _split_corpus(spark, trips(spark, sf))
    train = Corpus(tr_docs, corpus.stations, corpus.hours)
    model = fit_batch(train, CFG, metric_fn=lambda m, i: _holdout_metrics(spark, m, te_docs, CFG))
    return model.history_frame(spark)


@query("passenger_theta", None, ("O-13", "C-01"))
def q_passenger_theta(spark, sf):
    corpus = corpus_from_trips(trips(spark, sf))
    model = fit_batch(corpus, CFG)
    th = infer_docs(corpus.docs, model, CFG)
    return th.select("user_id", "wordcount", "elbo", "sweeps", "theta",
                     cl.flatten_theta_f_order("theta", CFG.J, CFG.K, CFG.L).alias("theta_f"))


@query("passenger_pattern", None, ("W-10", "O-13"))
def q_passenger_pattern(spark, sf):
    corpus = corpus_from_trips(trips(spark, sf))
    model = fit_batch(corpus, CFG)
    return mt.passenger_pattern(infer_docs(corpus.docs, model, CFG), CFG.J, CFG.K, CFG.L)


@query("new_doc_infer", None, ("O-12", "U-04"))
def q_new_doc_infer(spark, sf):
    corpus, tr_docs, te_docs = _split_corpus(spark, trips(spark, sf))
    model = fit_batch(Corpus(tr_docs, corpus.stations, corpus.hours), CFG)
    return infer_docs(te_docs, model, CFG).select("user_id", "wordcount", "elbo", "sweeps", "cz_o", "cz_d", "cz_t")


@query("online_lda", None, ("O-10", "O-11", "O-17", "T-02"))
def q_online_lda(spark, sf):
    corpus, tr_docs, te_docs = _split_corpus(spark, trips(spark, sf))
    train = Corpus(tr_docs, corpus.stations, corpus.hours)
    model = fit_online(train, ONLINE_CFG, batches=ONLINE_BATCHES, epochs=3, tau0=16.0, kappa=0.5,
                       metric_fn=lambda m, i: _holdout_metrics(spark, m, te_docs, ONLINE_CFG))
    return model.history_frame(spark)


@query("lambda_grid", None, ("O-16", "S-07"))
def q_lambda_grid(spark, sf):
    corpus, tr_docs, te_docs = _split_corpus(spark, trips_od(spark, sf))
    g = _graphs(spark, sf, corpus)
    train = Corpus(tr_docs, corpus.stations, corpus.hours)
    cfgs = [TensorLDAConfig(lam=lam) for lam in LAMBDAS]
    rows = []
    for cfg, model in zip(cfgs, fit_grid(train, cfgs, g, g), strict=True):      # one pass over the documents for all λ
        for name, value in _holdout_metrics(spark, model, te_docs, cfg):
            rows.append((float(cfg.lam), name, value))
    return spark.createDataFrame(rows, "lam double, metric string, value double")


@query("destination_accuracy_lda", None, ("I-01", "I-02", "I-03", "A-19"))
def q_destination_accuracy_lda(spark, sf):
    corpus = corpus_from_trips(trips(spark, sf))
    model = fit_batch(corpus, CFG)
    theta = infer_docs(corpus.docs, model, CFG).select("user_id", "theta")
    return destination_accuracy(predict_destinations(corpus.docs, theta, model.beta))


@query("passenger_clusters", None, ("C-06", "A-17", "A-18", "C-07", "S-08"))
def q_passenger_clusters(spark, sf):
    corpus = corpus_from_trips(trips(spark, sf))
    model = fit_batch(corpus, CFG)
    # the clustering rounds re-read the patterns: cut the lineage (E-step) with a reliable checkpoint
    pat = mt.passenger_pattern(infer_docs(corpus.docs, model, CFG), CFG.J, CFG.K, CFG.L).checkpoint()
    assign = cl.categorical_clusters(pat, "user_id", ["o_topic", "d_topic", "t_topic"], 10)
    return cl.cluster_topic_od(pat.join(assign, "user_id"), 10, CFG.J, CFG.K, CFG.L)


# ---- flat LDA on passenger tokens (O-01 ... O-04) ----------------------------

@F.udf(VectorUDT())
def _sparse(size, pairs):
    pairs = sorted(pairs, key=lambda p: p["id"])
    return SparseVector(size, [p["id"] for p in pairs], [float(p["tf"]) for p in pairs])


def _flat_corpus(spark, sf):
    """Flat O#_D#_T# tokens per passenger (7-hour bins), pruned vocabulary, BoW vectors.

    A document's vector is built from its (id, tf) pairs, at most one per
    vocabulary entry whatever the passenger's trip count.
    """
    tok = dc.flat_tokens(flow.user_od_tensor(trips(spark, sf), 7)).withColumnRenamed("cnt", "tf")
    n_docs = tok.select("user_id").distinct().count()
    vocab = dc.pruned_vocab(tok.withColumnRenamed("user_id", "doc_id"), n_docs).checkpoint()
    size = vocab.count()
    bow = dc.bag_of_words(tok.withColumnRenamed("user_id", "doc_id"), vocab)
    vec = bow.groupBy("doc_id").agg(F.collect_list(F.struct("id", "tf")).alias("pairs")).select(
        "doc_id", _sparse(F.lit(size), "pairs").alias("features"))
    return vec, vocab, n_docs


TOPICS_SCHEMA = "id int, topic int, rank int, weight double, token string"
TFIDF_SCHEMA = "k int, log_perplexity double, log_likelihood double"
DOC_TOPICS_SCHEMA = "doc_id bigint, topic int, score double, best int"


@query("flat_lda_topics", None, ("O-01", "V-02", "V-03"))
def q_flat_lda_topics(spark, sf):
    vec, vocab, _ = _flat_corpus(spark, sf)
    if vocab.limit(1).count() == 0:          # nothing survives pruning: no topics to learn
        return spark.createDataFrame([], TOPICS_SCHEMA)
    model = LDA(k=FLAT_TOPICS, maxIter=2, optimizer="online", subsamplingRate=1.0, seed=1).fit(vec)
    topics = model.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")))
    return topics.select("topic", F.col("pos").alias("rank"), F.col("col.termIndices").alias("id"),
                         F.col("col.termWeights").alias("weight")).join(vocab.select("id", "token"), "id")


@query("flat_lda_tfidf", None, ("O-02", "V-04"))
def q_flat_lda_tfidf(spark, sf):
    vec, vocab, n_docs = _flat_corpus(spark, sf)
    tok = dc.flat_tokens(flow.user_od_tensor(trips(spark, sf), 7)).withColumnRenamed("cnt", "tf")
    bow = dc.bag_of_words(tok.withColumnRenamed("user_id", "doc_id"), vocab)
    size = vocab.count()
    if size == 0:
        return spark.createDataFrame([], TFIDF_SCHEMA)
    w = dc.tfidf(bow, vocab, n_docs).withColumnRenamed("weight", "tf")
    tf_vec = w.groupBy("doc_id").agg(F.collect_list(F.struct("id", "tf")).alias("pairs")).select(
        "doc_id", _sparse(F.lit(size), "pairs").alias("features"))
    model = LDA(k=FLAT_TOPICS, maxIter=2, optimizer="online", subsamplingRate=1.0, seed=1).fit(tf_vec)
    lp = model.logPerplexity(vec)
    ll = model.logLikelihood(vec)
    return spark.createDataFrame([(FLAT_TOPICS, float(lp), float(ll))], "k int, log_perplexity double, log_likelihood double")


@query("flat_lda_doc_topics", None, ("O-03", "W-11", "V-05"))
def q_flat_lda_doc_topics(spark, sf):
    vec, _, _ = _flat_corpus(spark, sf)
    vec = vec.checkpoint()          # read by the count, the iterative fit and the transform
    n_train = int(vec.count() * TRAIN_FRACTION)
    if n_train == 0:
        return spark.createDataFrame([], DOC_TOPICS_SCHEMA)
    split = tr.train_test_split(vec.select(F.col("doc_id").alias("user_id")), n_train).withColumnRenamed(
        "user_id", "doc_id")
    v = vec.join(split, "doc_id")
    model = LDA(k=FLAT_TOPICS, maxIter=2, optimizer="online", subsamplingRate=1.0, seed=1).fit(
        v.filter(F.col("split") == "train"))
    dist = model.transform(v.filter(F.col("split") == "test")).select(
        "doc_id", vector_to_array("topicDistribution").alias("p"))
    ranked = dist.select("doc_id", F.posexplode("p").alias("topic", "score"))
    return ranked.withColumn("best", F.row_number().over(
        Window.partitionBy("doc_id").orderBy(F.desc("score"), "topic")))


@query("flat_vlda_fit", None, ("O-04", "A-12"))
def q_flat_vlda_fit(spark, sf):
    """Own variational flat LDA over all O#_D#_T# tokens (7-hour bins); β stays a table."""
    tok = dc.flat_tokens(flow.user_od_tensor(trips(spark, sf), 7))
    model = fit_flat_lda(tok, FLAT_TOPICS)
    return model.long().withColumn("converged", F.lit(model.converged))


@query("flat_vlda_one_sweep", with_views(f"""
SELECT topic, token, ROUND(SUM(cnt * b / s) / SUM(SUM(cnt * b / s)) OVER (PARTITION BY topic), 9) AS p
FROM words JOIN (SELECT token, topic, b, SUM(b) OVER (PARTITION BY token) AS s FROM started) USING (token) GROUP BY 1, 2""",
    trips=TRIPS_SQL,
    words="""SELECT 'O' || origin || '_D' || dest || '_T' || CAST(CAST(((HOUR(ts) - 5) % 24 + 24) % 24 AS INT) // 7 AS INT) AS token, COUNT(*) AS cnt
             FROM trips WHERE ((HOUR(ts) - 5) % 24 + 24) % 24 < 21 GROUP BY 1""",
    started=f"""SELECT token, CAST(topic AS INT) AS topic, n * 1.0 / SUM(n) OVER (PARTITION BY topic) AS b FROM (
                SELECT token, topic, 1 + (length(token) * 3 + ascii(right(token, 1)) + (topic + 1) * ascii(substr(token, 2, 1))) % 7 AS n
                FROM (SELECT DISTINCT token FROM words), range({FLAT_TOPICS}) t(topic))"""), ("O-04",))
def q_flat_vlda_one_sweep(spark, sf):
    """β after one sweep and one M-step from a start that SQL can state."""
    def start(token):
        last, second = F.ascii(F.right(token, F.lit(1))), F.ascii(F.substring(token, 2, 1))
        return F.array(*[(1 + (F.length(token) * 3 + last + (k + 1) * second) % 7).cast("double") for k in range(FLAT_TOPICS)])

    tok = dc.flat_tokens(flow.user_od_tensor(trips(spark, sf), 7))
    model = fit_flat_lda(tok, FLAT_TOPICS, max_iter=1, sweeps=1, start=start)
    return model.long().select("topic", "token", F.round(F.exp("logp"), 9).alias("p"))
