"""One pass of the tensor topic model from a deterministic start, with SQL twins.

The start is the empirical model: one topic per trip type, the same in every
dimension, β = the word's share of the type's trips.  On the first sweep of the
E-step every φ is flat and γ is constant, so the prior term of a word is the
same for all topics and φ is the word's β column, normalised over the topics.
Everything after it (θ, word statistics, the M-step, the online blend, patterns
and their clusters) follows by sums, which SQL can state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import stable_hash_sql
from ..operators import cluster as cl
from ..operators import metrics as mt
from ..operators.graph import to_station_graph
from ..operators.infer import destination_accuracy, predict_destinations
from ..operators.topics.elbo import elbo
from ..operators.topics.estep import collect_stats, estep_docs, estep_phi, estep_stats, prepare_docs
from ..operators.topics.fit import TensorLDAConfig, assign_minibatches, m_step, online_update
from ..operators.topics.laplacian import laplacian_m_step
from ..operators.topics.model import Corpus, TopicModel, corpus_from_trips
from ..sources.fixtures import TRIPS_OD_SQL, TRIPS_SQL, trips, trips_od
from .catalog import query, with_views
from .fixtures_model import POI_SQL, TYPED_SQL, empirical_beta_all, mixed_graph_sql, nation_graph, typed

ALPHA = 5.0
TAU0, KAPPA = 16.0, 0.5
CLUSTERS = 4
ONE = TensorLDAConfig(iter_inference=0, alpha=ALPHA)
LOG_ZERO = -100.0


def start_model(spark, corpus: Corpus, t: DataFrame) -> TopicModel:
    """The empirical model (types in alphabetical order as topics 0, 1, ...); model-sized."""
    beta = empirical_beta_all(typed(t)).toPandas()
    types = sorted(beta["topic"].unique())
    mats = []
    for dim, values in (("O", corpus.stations), ("D", corpus.stations), ("T", corpus.hours)):
        b = beta[beta["dim"] == dim]
        m = np.full((len(types), len(values)), LOG_ZERO)
        m[np.searchsorted(types, b["topic"]), np.searchsorted(values, b["word"])] = np.log(b["p"])
        mats.append(m)
    return TopicModel(*mats, ALPHA, corpus.stations, corpus.hours)


def _start(spark, sf):
    t = trips(spark, sf)
    corpus = corpus_from_trips(t)
    return corpus, start_model(spark, corpus, t)


def _one_sweep(corpus: Corpus, model: TopicModel) -> DataFrame:
    return estep_docs(prepare_docs(corpus.docs), model.beta, ALPHA, 1, ONE.var_tol)


_DIMS = (("O", "origin"), ("D", "dest"), ("T", "hour"))

#: phi_o / phi_d / phi_t: (word, topic, p) of the first sweep; triples: a traveller's distinct trips with counts.
_SWEEP = {
    "trips": TRIPS_SQL, **TYPED_SQL,
    "topics": "SELECT topic AS name, CAST(ROW_NUMBER() OVER (ORDER BY topic) - 1 AS INT) AS topic FROM types",
    **{f"beta_{d.lower()}": f"SELECT topics.topic, {c} AS word, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY topics.topic) AS p "
                            f"FROM tt JOIN topics ON tt.topic = topics.name GROUP BY 1, 2" for d, c in _DIMS},
    **{f"phi_{d.lower()}": f"SELECT word, topic, p / SUM(p) OVER (PARTITION BY word) AS p FROM beta_{d.lower()}" for d, _ in _DIMS},
    "triples": "SELECT user_id, origin, dest, hour, COUNT(*) AS cnt FROM trips GROUP BY 1, 2, 3, 4",
    "theta": """SELECT user_id, o.topic AS o_topic, d.topic AS d_topic, t.topic AS t_topic, SUM(cnt * o.p * d.p * t.p) AS mass
                FROM triples JOIN phi_o o ON origin = o.word JOIN phi_d d ON dest = d.word JOIN phi_t t ON hour = t.word
                GROUP BY 1, 2, 3, 4""",
    "best": """SELECT user_id, ARG_MAX(o_topic, (mass, -o_topic, -d_topic, -t_topic)) AS o_topic,
                      ARG_MAX(d_topic, (mass, -o_topic, -d_topic, -t_topic)) AS d_topic,
                      ARG_MAX(t_topic, (mass, -o_topic, -d_topic, -t_topic)) AS t_topic FROM theta GROUP BY user_id""",
    "stats": " UNION ALL ".join(
        f"SELECT '{d}' AS dim, f.topic, {c} AS word, SUM(cnt * f.p) AS value FROM triples JOIN phi_{d.lower()} f ON {c} = f.word GROUP BY 2, 3"
        for d, c in _DIMS),
    "fitted": "SELECT dim, topic, word, value / SUM(value) OVER (PARTITION BY dim, topic) AS p FROM stats",
    "started": " UNION ALL ".join(f"SELECT '{d}' AS dim, topic, word, p FROM beta_{d.lower()}" for d, _ in _DIMS),
}


def _twin(body: str) -> str:
    return with_views(body, **_SWEEP)


@query("estep_one_sweep", _twin("""
    SELECT user_id, o_topic, d_topic, t_topic, ROUND(mass / SUM(mass) OVER (PARTITION BY user_id), 9) AS theta
    FROM theta WHERE mass > 1e-12"""), ("O-05", "O-12", "O-13"))
def q_estep_one_sweep(spark, sf):
    corpus, model = _start(spark, sf)
    (J, _), (K, _), (L, _) = model.shape
    cells = _one_sweep(corpus, model).select("user_id", "wordcount", F.posexplode("theta").alias("c", "theta"))
    return cells.where(F.col("theta") * F.col("wordcount") > 1e-12).select(
        "user_id", F.expr(f"CAST(c DIV {K * L} AS INT)").alias("o_topic"), F.expr(f"CAST(c DIV {L} % {K} AS INT)").alias("d_topic"),
        F.expr(f"CAST(c % {L} AS INT)").alias("t_topic"), F.round("theta", 9).alias("theta"))


_BOUND_PARTS = " + ".join(
    f"(SELECT SUM(f.p * (LN(b.p) - LN(f.p))) FROM phi_{d.lower()} f JOIN beta_{d.lower()} b USING (word, topic) WHERE f.word = {c} AND f.p > 0)" for d, c in _DIMS)


@query("elbo_one_sweep", _twin(f"""
    , people AS (SELECT user_id, SUM(cnt) AS n FROM triples GROUP BY 1),
    cells AS (SELECT user_id, {ALPHA} + COALESCE(mass, 0) AS g FROM people CROSS JOIN (SELECT topic AS o_topic FROM topics) CROSS JOIN (SELECT topic AS d_topic FROM topics)
              CROSS JOIN (SELECT topic AS t_topic FROM topics) LEFT JOIN theta USING (user_id, o_topic, d_topic, t_topic)),
    bag AS (SELECT user_id, lgamma({ALPHA} * COUNT(*)) - COUNT(*) * lgamma({ALPHA}) - lgamma(SUM(g)) + SUM(lgamma(g)) AS v FROM cells GROUP BY 1),
    word AS (SELECT origin, dest, hour, {_BOUND_PARTS} AS v FROM (SELECT DISTINCT origin, dest, hour FROM triples)),
    fit AS (SELECT user_id, SUM(cnt * v) AS v FROM triples JOIN word USING (origin, dest, hour) GROUP BY 1)
    SELECT user_id, CAST(n AS DOUBLE) AS wordcount, ROUND(bag.v + fit.v, 4) AS elbo FROM bag JOIN fit USING (user_id) JOIN people USING (user_id)
    """.strip()).replace("\n, people", ",\npeople"), ("O-06",))
def q_elbo_one_sweep(spark, sf):
    """The bound of every traveller's document as native aggregates over the cells of γ and the words' φ."""
    corpus, model = _start(spark, sf)
    docs = prepare_docs(corpus.docs)
    phi = estep_phi(docs, model.beta, ALPHA, 1, ONE.var_tol)
    theta = estep_docs(docs, model.beta, ALPHA, 1, ONE.var_tol)
    return elbo(theta, phi, model.beta, ALPHA).select("user_id", "wordcount", F.round("elbo", 4).alias("elbo"))


def _model_rows(spark, mats, corpus: Corpus, name: str) -> DataFrame:
    parts = []
    for (dim, _), m, values in zip(_DIMS, mats, (corpus.stations, corpus.stations, corpus.hours)):
        z, w = np.indices(m.shape)
        parts.append(pd.DataFrame({"dim": dim, "topic": z.ravel().astype(np.int32), "word": values[w.ravel()].astype(np.int32), name: m.ravel()}))
    rows = pd.concat(parts, ignore_index=True)
    rows = rows[rows[name] > 1e-9]
    return spark.createDataFrame(rows, f"dim string, topic int, word int, {name} double").withColumn(name, F.round(name, 9))


def _one_pass_stats(corpus: Corpus, model: TopicModel):
    return collect_stats(estep_stats(prepare_docs(corpus.docs), model.beta, ALPHA, 1, ONE.var_tol), model.shape)


@query("estep_word_stats", _twin("SELECT dim, topic, word, ROUND(value, 9) AS value FROM stats WHERE value > 1e-9"), ("O-05", "O-07"))
def q_estep_word_stats(spark, sf):
    corpus, model = _start(spark, sf)
    return _model_rows(spark, _one_pass_stats(corpus, model)[:3], corpus, "value")


@query("mstep_one_pass", _twin("SELECT dim, topic, word, ROUND(p, 9) AS p FROM fitted WHERE p > 1e-9"), ("O-07", "O-09"))
def q_mstep_one_pass(spark, sf):
    corpus, model = _start(spark, sf)
    so, sd, st, _, _ = _one_pass_stats(corpus, model)
    fitted = m_step(so, sd, st, ONE, None, None, ONE.nt_tol)
    return _model_rows(spark, [np.exp(m) for m in fitted], corpus, "p")


def _blend_sql(od: str) -> str:
    """β after one mini-batch (all travellers): ρ = (τ0 + 1)^-κ; ``od``: share of the new O and D rows."""
    rho = f"POWER({TAU0} + 1, -{KAPPA})"
    share = f"CASE WHEN s.dim = 'T' THEN {rho} ELSE {od.format(rho=rho)} END"
    return _twin(f"""
    SELECT s.dim, s.topic, s.word, ROUND((1 - {share}) * s.p + {share} * f.p, 9) AS p
    FROM started s JOIN fitted f ON s.dim = f.dim AND s.topic = f.topic AND s.word = f.word
    WHERE (1 - {share}) * s.p + {share} * f.p > 1e-9""")


def _online(spark, sf, variant):
    corpus, model = _start(spark, sf)
    model, _, _ = online_update(model, corpus.docs, ONE, TAU0, KAPPA, variant=variant)
    return _model_rows(spark, [np.exp(m) for m in model.beta], corpus, "p")


@query("online_blend_one_batch", _blend_sql("{rho}"), ("O-10",))
def q_online_blend(spark, sf):
    return _online(spark, sf, "blend")


@query("online_no_od_blend_one_batch", _blend_sql("1"), ("O-11",))
def q_online_no_od_blend(spark, sf):
    return _online(spark, sf, "no_od_blend")


@query("online_rho_step_one_batch", _blend_sql("1"), ("O-11",))
def q_online_rho_step(spark, sf):
    """Without a graph the step size drops out: O and D are the batch estimate."""
    return _online(spark, sf, "rho_step")


def _two_batches_sql() -> str:
    """Two mini-batches (halves of the travellers in hash order), each an M-step on its own words blended into β."""
    views = {
        "placed": f"""SELECT user_id, CAST((ROW_NUMBER() OVER (ORDER BY {stable_hash_sql('user_id', ONE.seed)}, user_id) - 1) // CAST(CEIL(COUNT(*) OVER () / 2.0) AS BIGINT) AS INT) AS mb
                      FROM (SELECT DISTINCT user_id FROM trips)""",
        "seen": " UNION ALL ".join(f"SELECT mb, '{d}' AS dim, {c} AS word, SUM(cnt) AS n FROM triples JOIN placed USING (user_id) GROUP BY 1, 3" for d, c in _DIMS),
        "b0": "SELECT * FROM started",
    }
    for k in (0, 1):
        rho = f"POWER({TAU0} + 1 + {k}, -{KAPPA})"
        views[f"s{k}"] = f"""SELECT dim, topic, word, n * p / SUM(p) OVER (PARTITION BY dim, word) AS v
                             FROM b{k} JOIN (SELECT dim, word, n FROM seen WHERE mb = {k}) USING (dim, word)"""
        views[f"f{k}"] = f"SELECT dim, topic, word, v / SUM(v) OVER (PARTITION BY dim, topic) AS p FROM s{k}"
        views[f"b{k + 1}"] = f"""SELECT b.dim, b.topic, b.word, (1 - {rho}) * b.p + {rho} * COALESCE(f.p, 0) AS p
                                 FROM b{k} b LEFT JOIN f{k} f ON f.dim = b.dim AND f.topic = b.topic AND f.word = b.word"""
    return with_views("SELECT dim, topic, word, ROUND(p, 9) AS p FROM b2 WHERE p > 1e-9", **_SWEEP, **views)


@query("online_blend_two_batches", _two_batches_sql(), ("O-10",))
def q_online_two_batches(spark, sf):
    """β after two mini-batches; the second one's E-step uses what the first one left."""
    corpus, model = _start(spark, sf)
    n = corpus.docs.select("user_id").distinct().count()
    docs, batches = assign_minibatches(corpus.docs, max(1, -(-n // 2)), ONE.seed)
    docs = docs.checkpoint()
    for b in range(batches):
        model, _, _ = online_update(model, docs.where(F.col("mb") == b).drop("mb"), ONE, TAU0, KAPPA)
    return _model_rows(spark, [np.exp(m) for m in model.beta], corpus, "p")


MU, LAM = 0.5, 0.1
_RHO = f"POWER({TAU0} + 1, -{KAPPA})"


@query("online_rho_step_graph", with_views(f"""
    SELECT dim, topic, station AS word, ROUND(p / SUM(p) OVER (PARTITION BY dim, topic), 9) AS p FROM clamped
    UNION ALL
    SELECT s.dim, s.topic, s.word, ROUND((1 - {_RHO}) * s.p + {_RHO} * COALESCE(f.p, 0), 9) AS p
    FROM started s LEFT JOIN fitted f ON f.dim = s.dim AND f.topic = s.topic AND f.word = s.word WHERE s.dim = 'T'""",
    **{**_SWEEP, "trips": TRIPS_OD_SQL}, **POI_SQL, mixed=mixed_graph_sql(MU),
    begun="""SELECT d.dim, topics.topic, n_nationkey AS station, COALESCE(f.p, exp(-100)) AS p
          FROM (SELECT UNNEST(['O', 'D']) AS dim) d CROSS JOIN topics CROSS JOIN nation
          LEFT JOIN fitted f ON f.dim = d.dim AND f.topic = topics.topic AND f.word = n_nationkey""",
    slope=f"""SELECT q.dim, q.topic, q.station, q.p, {LAM} - {1 - LAM} * COALESCE(SUM(g.w * (q.p - r.p)), 0.0) AS grad
              FROM begun q LEFT JOIN mixed g ON g.s1 = q.station LEFT JOIN begun r ON r.station = g.s2 AND r.topic = q.topic AND r.dim = q.dim
              GROUP BY 1, 2, 3, 4""",
    stepped=f"SELECT dim, topic, station, p + {_RHO} * (grad - AVG(grad) OVER (PARTITION BY dim, topic)) AS p FROM slope",
    clamped="SELECT dim, topic, station, CASE WHEN p <= 0 THEN 0.01 ELSE p END AS p FROM stepped"), ("O-11", "O-08"))
def q_online_rho_step_graph(spark, sf):
    """One mini-batch of all travellers with a station graph: ρ is the size of the gradient step for O and D."""
    t = trips_od(spark, sf)
    corpus = corpus_from_trips(t)
    model = start_model(spark, corpus, t)
    _, _, mixed = nation_graph(spark, sf, MU)
    graph = to_station_graph(mixed.toPandas(), corpus.stations)
    cfg = TensorLDAConfig(iter_inference=0, alpha=ALPHA, lam=LAM, nt_max_iter=1)
    model, _, _ = online_update(model, corpus.docs, cfg, TAU0, KAPPA, graph, graph, variant="rho_step")
    return _model_rows(spark, [np.exp(m) for m in model.beta], corpus, "p")


def _flow_steps_sql(steps: int, g: float) -> str:
    """``steps`` gradient steps from the types' origin shares over the graph of all trips between two stations."""
    views = {
        "trips": TRIPS_SQL, **TYPED_SQL,
        "links": """SELECT w1, w2, SUM(w) AS w FROM (SELECT origin AS w1, dest AS w2, COUNT(*) / 1000.0 AS w FROM trips WHERE origin <> dest GROUP BY 1, 2
                    UNION ALL SELECT dest, origin, COUNT(*) / 1000.0 FROM trips WHERE origin <> dest GROUP BY 1, 2) GROUP BY 1, 2""",
        "stations": "SELECT DISTINCT w1 AS station FROM links",
        "shares": "SELECT topic, origin AS station, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY topic) AS p FROM tt GROUP BY 1, 2",
        "q0": "SELECT topic, station, COALESCE(p, exp(-100)) AS p FROM stations CROSS JOIN (SELECT DISTINCT topic FROM tt) LEFT JOIN shares USING (topic, station)",
    }
    for k in range(steps):
        views[f"s{k}"] = f"""SELECT a.topic, a.station, a.p, {LAM} * b.p / a.p - {1 - LAM} * COALESCE(SUM(l.w * (a.p - c.p)), 0.0) AS g
                             FROM q{k} a JOIN q0 b ON b.topic = a.topic AND b.station = a.station LEFT JOIN links l ON l.w1 = a.station
                             LEFT JOIN q{k} c ON c.station = l.w2 AND c.topic = a.topic GROUP BY a.topic, a.station, a.p, b.p"""
        views[f"m{k}"] = f"SELECT topic, station, p + {g} * (g - AVG(g) OVER (PARTITION BY topic)) AS p FROM s{k}"
        views[f"q{k + 1}"] = f"""SELECT topic, station, p / SUM(p) OVER (PARTITION BY topic) AS p
                                 FROM (SELECT topic, station, CASE WHEN p <= 0 THEN 0.01 ELSE p END AS p FROM m{k})"""
    return with_views(f"SELECT topic, station, ROUND(p, 9) AS p, {steps} AS steps, FALSE AS converged FROM q{steps}", **views)


FLOW_STEPS, FLOW_G = 3, 1e-3


@query("graph_m_step_table", _flow_steps_sql(FLOW_STEPS, FLOW_G), ("O-08", "S-05"))
def q_graph_m_step_table(spark, sf):
    """Gradient steps of the M-step over an edge table: trips between two stations link them."""
    t = trips(spark, sf).checkpoint()
    both = t.where("origin <> dest").select(F.explode(F.array(F.struct(F.col("origin").alias("w1"), F.col("dest").alias("w2")),
                                                             F.struct(F.col("dest").alias("w1"), F.col("origin").alias("w2")))).alias("x"))
    edges = both.groupBy("x.w1", "x.w2").agg((F.count(F.lit(1)) / 1000.0).alias("weight")).checkpoint()
    counts = typed(t).groupBy("topic", F.col("origin").alias("station")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    topics = {r.topic: r.n for r in counts.groupBy("topic").agg(F.sum("n").alias("n")).collect()}      # the model's topics: trip types
    names = sorted(topics)
    by = counts.groupBy("station").agg(*[F.sum(F.when(F.col("topic") == z, F.col("n"))).alias(f"n{k}") for k, z in enumerate(names)])
    shares = F.array(*[F.coalesce(F.col(f"n{k}") / F.lit(topics[z]), F.exp(F.lit(-100.0))) for k, z in enumerate(names)])
    p0 = edges.select(F.col("w1").alias("station")).distinct().join(by, "station", "left").select("station", shares.alias("p"))
    fit = laplacian_m_step(p0, edges, len(names), LAM, FLOW_G, tol=-1.0, max_iter=FLOW_STEPS)
    labels = F.array(*[F.lit(z) for z in names])
    return fit.p.select("station", F.posexplode("p").alias("k", "p")).select(
        labels[F.col("k")].alias("topic"), "station", F.round("p", 9).alias("p"), F.lit(fit.steps).alias("steps"), F.lit(fit.converged).alias("converged"))


@query("passenger_pattern_one_sweep", _twin("SELECT user_id, o_topic, d_topic, t_topic FROM best"), ("W-10", "O-13"))
def q_pattern_one_sweep(spark, sf):
    corpus, model = _start(spark, sf)
    (J, _), (K, _), (L, _) = model.shape
    theta = _one_sweep(corpus, model).withColumn("theta", F.transform("theta", lambda x: F.round(x, 12)))
    return mt.passenger_pattern(theta, J, K, L)


#: Round 0 of the categorical clustering: travellers 0..m-1 (by id) seed clusters 0..m-1; every other one goes where
#: the utility of the seeds plus itself is best.  S and N are the seeds' sum of squares (three attributes) and size.
_ROUND = {
    **_SWEEP,
    "rolled": f"SELECT *, ROW_NUMBER() OVER (ORDER BY user_id) - 1 AS r FROM best",
    "long": """SELECT user_id, r, 0 AS a, o_topic AS v FROM rolled UNION ALL SELECT user_id, r, 1, d_topic FROM rolled
               UNION ALL SELECT user_id, r, 2, t_topic FROM rolled""",
    "u": "SELECT SUM(POWER(c * 1.0 / n, 2)) AS u FROM (SELECT a, v, COUNT(*) AS c FROM long GROUP BY 1, 2), (SELECT COUNT(*) AS n FROM rolled)",
    "held": f"""SELECT x.user_id, CAST(s.r AS INT) AS cluster, SUM(CASE WHEN x.v = s.v THEN 1 ELSE 0 END) AS same
                FROM long x JOIN long s ON x.a = s.a WHERE s.r < {CLUSTERS} AND x.r >= {CLUSTERS} GROUP BY 1, 2""",
    "gain": "SELECT user_id, cluster, ROUND((3 + 2 * same + 3) / 2.0 - 2 * u - (3 - u), 9) AS g FROM held, u",
}


@query("cluster_round_one", with_views(f"""
    SELECT user_id, ARG_MAX(cluster, (g, -cluster)) AS cluster FROM gain GROUP BY user_id
    UNION ALL SELECT user_id, CAST(r AS INT) AS cluster FROM rolled WHERE r < {CLUSTERS}""", **_ROUND), ("C-06", "A-17"))
def q_cluster_round_one(spark, sf):
    pattern = q_pattern_one_sweep(spark, sf).checkpoint()
    return cl.categorical_clusters(pattern, "user_id", ["o_topic", "d_topic", "t_topic"], CLUSTERS, max_rounds=1).select("user_id", "cluster")


@query("cluster_topic_od_one_sweep", with_views(f"""
    , placed AS (SELECT user_id, ARG_MAX(cluster, (g, -cluster)) AS cluster FROM gain GROUP BY user_id
                 UNION ALL SELECT user_id, CAST(r AS INT) FROM rolled WHERE r < {CLUSTERS}),
    m AS (SELECT topic FROM topics)
    SELECT CAST(c.cluster AS INT) AS cluster, t.topic AS t_topic, o.topic AS o_topic, d.topic AS d_topic, COUNT(b.user_id) AS n
    FROM (SELECT UNNEST(GENERATE_SERIES(0, {CLUSTERS - 1})) AS cluster) c, m t, m o, m d
    LEFT JOIN (SELECT * FROM best JOIN placed USING (user_id)) b
      ON b.cluster = c.cluster AND b.t_topic = t.topic AND b.o_topic = o.topic AND b.d_topic = d.topic
    GROUP BY 1, 2, 3, 4""".strip(), **_ROUND).replace("\n, placed", ",\nplaced"), ("A-18", "C-07"))
def q_cluster_topic_od(spark, sf):
    pattern = q_pattern_one_sweep(spark, sf).checkpoint()
    placed = cl.categorical_clusters(pattern, "user_id", ["o_topic", "d_topic", "t_topic"], CLUSTERS, max_rounds=1)
    (J, _), (K, _), (L, _) = _start(spark, sf)[1].shape
    return cl.cluster_topic_od(pattern.join(placed, "user_id"), CLUSTERS, J, K, L)


@query("destination_accuracy_one_sweep", _twin("""
    , share AS (SELECT user_id, o_topic, d_topic, t_topic, mass / SUM(mass) OVER (PARTITION BY user_id) AS theta FROM theta),
    weight AS (SELECT k.user_id, k.origin, k.hour, d_topic, SUM(o.p * t.p * theta) AS w
               FROM (SELECT DISTINCT user_id, origin, hour FROM triples) k JOIN share USING (user_id)
               JOIN beta_o o ON o.word = k.origin AND o.topic = o_topic JOIN beta_t t ON t.word = k.hour AND t.topic = t_topic
               GROUP BY 1, 2, 3, 4),
    score AS (SELECT user_id, origin, hour, b.word AS dest, SUM(w * b.p) AS s FROM weight JOIN beta_d b ON b.topic = d_topic GROUP BY 1, 2, 3, 4),
    normal AS (SELECT user_id, origin, hour, dest, ROUND(s / SUM(s) OVER (PARTITION BY user_id, origin, hour), 12) AS s FROM score),
    top AS (SELECT user_id, origin, hour, ARG_MAX(dest, (s, -dest)) AS pred FROM normal GROUP BY 1, 2, 3),
    hits AS (SELECT user_id, SUM(CASE WHEN pred = dest THEN cnt ELSE 0 END) AS correct, SUM(cnt) AS trips
             FROM triples JOIN top USING (user_id, origin, hour) GROUP BY 1),
    both_ AS (SELECT user_id, correct, trips FROM hits UNION ALL SELECT -1, SUM(correct), SUM(trips) FROM hits)
    SELECT user_id, CAST(correct AS BIGINT) AS correct, CAST(trips AS BIGINT) AS trips, correct * 1.0 / trips AS accuracy FROM both_
    """.strip()).replace("\n, share", ",\nshare"), ("I-01", "I-03", "A-19"))
def q_destination_accuracy_one_sweep(spark, sf):
    """Per-trip accuracy from distinct triples weighted by how often each was made."""
    corpus, model = _start(spark, sf)
    theta = _one_sweep(corpus, model).select("user_id", "theta")
    return destination_accuracy(predict_destinations(corpus.docs, theta, model.beta))
