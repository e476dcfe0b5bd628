"""Queries of build steps 4, 5, 7, 8 with SQL twins: graphs, model metrics,
destination inference and clustering on deterministic models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import token_digits
from ..functions.indexing import guarded_broadcast
from ..operators import cluster as cl
from ..operators import graph as gr
from ..operators import metrics as mt
from ..operators.infer import destination_accuracy, predict_destinations
from ..session import table
from ..sources.fixtures import TRIPS_OD_SQL, TRIPS_SQL, trips, trips_od
from .catalog import query, with_views
from .fixtures_model import (POI_SQL, TYPED_SQL, beta_sql, dim_long, dim_words_all, empirical_beta,
                             empirical_beta_all, mixed_graph_sql, nation_graph, type_counts, typed)

T = {"trips": TRIPS_SQL, **TYPED_SQL}
TOD = {"trips": TRIPS_OD_SQL, **TYPED_SQL}
MU = 0.5
LAM = 0.1
G_STEP = 1e-3
ALPHA = 5.0
TOP_R = 10
R9 = 9
MAX_TOPICS = 1000


def _r(c, d=R9):
    return F.round(F.col(c), d).alias(c)


# ---- step 4: graphs ---------------------------------------------------------

@query("poi_factors", with_views("SELECT station, factor, ROUND(weight, 9) AS weight FROM pf", **POI_SQL),
       ("S-04", "G-01", "P-13"))
def q_poi_factors(spark, sf):
    _, pf, _ = nation_graph(spark, sf, MU)
    return pf.select("station", "factor", _r("weight"))


@query("graph_degree", with_views(f"""
SELECT s1 AS station, ROUND(SUM(w), 9) AS degree FROM mixed GROUP BY 1""", **POI_SQL, mixed=mixed_graph_sql(MU)),
    ("G-02", "G-03", "J-06"))
def q_graph_degree(spark, sf):
    _, _, mf = nation_graph(spark, sf, MU)
    return gr.degree(mf).select("station", _r("degree"))


@query("graph_smoothness", with_views(f"""
SELECT p1.topic, ROUND(0.5 * SUM(g.w * (p1.p - p2.p) * (p1.p - p2.p)), 9) AS smoothness
FROM mixed g JOIN pf2 p1 ON g.s1 = p1.station JOIN pf2 p2 ON g.s2 = p2.station AND p1.topic = p2.topic
GROUP BY 1""", **TOD, **POI_SQL, mixed=mixed_graph_sql(MU),
    b=beta_sql("O"),
    grid="""SELECT n_nationkey AS station, UNNEST((SELECT list(topic ORDER BY topic) FROM types)) AS topic
            FROM nation""",
    pf2="""SELECT g.topic, g.station, COALESCE(b.p, 0.0) AS p
           FROM grid g LEFT JOIN b ON b.topic = g.topic AND b.word = g.station"""),
    ("G-03", "G-04"))
def q_graph_smoothness(spark, sf):
    _, _, mf = nation_graph(spark, sf, MU)
    b = empirical_beta(typed(trips_od(spark, sf)), "O").withColumnRenamed("word", "station")
    return gr.smoothness(b, mf).select("topic", _r("smoothness"))


@query("poi_profile", with_views("""
SELECT b.topic, poi.category, ROUND(SUM(b.p * poi.value) / SUM(SUM(b.p * poi.value)) OVER (PARTITION BY b.topic), 9)
       AS share
FROM b JOIN poi ON b.word = poi.station GROUP BY 1, 2""", **TOD, **POI_SQL, b=beta_sql("O")), ("G-07",))
def q_poi_profile(spark, sf):
    poi, _, _ = nation_graph(spark, sf, MU)
    b = empirical_beta(typed(trips_od(spark, sf)), "O").withColumnRenamed("word", "station")
    return gr.poi_profile(b, poi).select("topic", "category", _r("share"))


@query("graph_step", with_views(f"""
SELECT topic, station, ROUND(p1 / SUM(p1) OVER (PARTITION BY topic), 9) AS p FROM (
  SELECT topic, station, CASE WHEN p + {G_STEP} * grad <= 0 THEN 0.01 ELSE p + {G_STEP} * grad END AS p1 FROM (
    SELECT q.topic, q.station, q.p,
           {LAM} - {1 - LAM} * COALESCE(SUM(g.w * (q.p - q2.p)), 0.0) AS grad
    FROM p0 q LEFT JOIN mixed g ON g.s1 = q.station
    LEFT JOIN p0 q2 ON q2.station = g.s2 AND q2.topic = q.topic
    GROUP BY 1, 2, 3))""", **TOD, **POI_SQL, mixed=mixed_graph_sql(MU), b=beta_sql("O"),
    grid="""SELECT n_nationkey AS station, UNNEST((SELECT list(topic ORDER BY topic) FROM types)) AS topic
            FROM nation""",
    p0="""SELECT g.topic, g.station, COALESCE(b.p, exp(-100)) AS p
          FROM grid g LEFT JOIN b ON b.topic = g.topic AND b.word = g.station"""),
    ("O-08", "P-12", "P-13"))
def q_graph_step(spark, sf):
    _, _, mf = nation_graph(spark, sf, MU)
    tt = typed(trips_od(spark, sf))
    b = empirical_beta(tt, "O").withColumnRenamed("word", "station")
    stations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("station"))
    topics = sorted(r[0] for r in tt.select("topic").distinct().limit(MAX_TOPICS + 1).collect())
    if len(topics) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} trip types: not a topic model of types")
    grid = stations.withColumn("topic", F.explode(F.array(*[F.lit(t) for t in topics])))
    p0 = grid.join(b, ["topic", "station"], "left").select(
        "topic", "station", F.coalesce("p", F.exp(F.lit(-100.0))).alias("p"))
    return gr.gradient_step(p0, mf, LAM, G_STEP).select("topic", "station", _r("p"))


# ---- step 5: metrics on the empirical model ------------------------------------

@query("beta_from_counts", with_views("""
SELECT dim, topic, word, ROUND(LN(n) - LN(SUM(n) OVER (PARTITION BY dim, topic)), 9) AS logp FROM (
  SELECT 'O' AS dim, topic, origin AS word, COUNT(*) AS n FROM tt GROUP BY 2, 3
  UNION ALL SELECT 'D', topic, dest, COUNT(*) FROM tt GROUP BY 2, 3
  UNION ALL SELECT 'T', topic, hour, COUNT(*) FROM tt GROUP BY 2, 3)""", **T), ("O-07", "P-12"))
def q_beta_from_counts(spark, sf):
    c = dim_long(typed(trips(spark, sf))).groupBy("dim", "topic", "word").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("dt", F.struct("dim", "topic"))
    out = mt.beta_from_counts(c, "dt", "word").select(
        F.col("topic.dim").alias("dim"), F.col("topic.topic").alias("topic"), "word", "logp")
    return out.select("dim", "topic", "word", _r("logp"))


def _top_sql(dim):
    return f"""SELECT '{dim}' AS dim, topic, CAST(rank AS INT) AS rank, word, ROUND(p, 12) AS p FROM (
      SELECT topic, word, p, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY p DESC, word DESC) AS rank
      FROM ({beta_sql(dim)})) WHERE rank <= {TOP_R}"""


@query("topic_top_words", with_views(" UNION ALL ".join(_top_sql(d) for d in "ODT"), **T), ("W-07",))
def q_topic_top_words(spark, sf):
    out = mt.top_words(empirical_beta_all(typed(trips(spark, sf))), TOP_R, ["dim"])
    return out.select("dim", "topic", F.col("rank").cast("int"), "word", F.round("p", 12).alias("p"))


@query("topic_decode", with_views(" UNION ALL ".join(
    f"""SELECT dim, topic, rank, '{d}' || word AS token, CAST(regexp_extract('{d}' || word, '(\\d+)', 1) AS INT) AS value
        FROM ({_top_sql(d)})""" for d in "ODT"), **T), ("G-08", "P-05", "P-07", "J-04"))
def q_topic_decode(spark, sf):
    top = mt.top_words(empirical_beta_all(typed(trips(spark, sf))), TOP_R, ["dim"])
    out = top.select("dim", "topic", F.col("rank").cast("int"),
                     F.concat(F.col("dim"), F.col("word").cast("string")).alias("token"))
    return out.withColumn("value", token_digits("token"))


def _coherence_sql(dim):
    col = {"O": "origin", "D": "dest", "T": "hour"}[dim]
    return f"""SELECT '{dim}' AS dim, ty.topic, ROUND(COALESCE(s.coh, 0.0), 9) AS coherence FROM types ty LEFT JOIN (
      SELECT p.topic, SUM(LN((COALESCE(co.cofreq, 0) + 1.0) / f.freq)) AS coh
      FROM (SELECT a.topic, a.word AS w1, b.word AS w2 FROM top_{dim} a JOIN top_{dim} b
            ON a.topic = b.topic AND b.pos < a.pos) p
      JOIN (SELECT word, SUM(cnt) AS freq FROM uw_{dim} GROUP BY 1) f ON f.word = p.w2
      LEFT JOIN (SELECT a.topic, a.word AS w1, b.word AS w2, SUM(a.cnt * b.cnt) AS cofreq
                 FROM (SELECT u.user_id, u.word, u.cnt, t.topic, t.pos FROM uw_{dim} u JOIN top_{dim} t ON u.word = t.word) a
                 JOIN (SELECT u.user_id, u.word, u.cnt, t.topic, t.pos FROM uw_{dim} u JOIN top_{dim} t ON u.word = t.word) b
                 ON a.user_id = b.user_id AND a.topic = b.topic AND b.pos < a.pos GROUP BY 1, 2, 3) co
        ON co.topic = p.topic AND co.w1 = p.w1 AND co.w2 = p.w2
      WHERE f.freq > 0 GROUP BY 1) s ON s.topic = ty.topic"""


def _coh_views():
    v = {}
    for d, col in (("O", "origin"), ("D", "dest"), ("T", "hour")):
        v[f"uw_{d}"] = f"SELECT user_id, {col} AS word, COUNT(*) AS cnt FROM tt GROUP BY 1, 2"
        v[f"top_{d}"] = f"""SELECT topic, word, {TOP_R} + 1 - rank AS pos FROM (
            SELECT topic, word, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY p DESC, word DESC) AS rank
            FROM ({beta_sql(d)})) WHERE rank <= {TOP_R}"""
    return v


@query("topic_coherence", with_views(" UNION ALL ".join(_coherence_sql(d) for d in "ODT"), **T, **_coh_views()),
       ("O-15", "J-08", "A-15", "W-07"))
def q_topic_coherence(spark, sf):
    tt = typed(trips(spark, sf).checkpoint())
    out = mt.topic_coherence(empirical_beta_all(tt), dim_words_all(tt), TOP_R, by=["dim"])
    return out.select("dim", "topic", _r("coherence"))


def _perp_sql(dim):
    col = {"O": "origin", "D": "dest", "T": "hour"}[dim]
    return f"""SELECT '{dim}' AS dim, ROUND(EXP(-SUM(w.cnt * LN(COALESCE(s.s, 0.0) + 1e-6)) / SUM(w.cnt)), 9) AS perplexity,
                      CAST(SUM(w.cnt) AS BIGINT) AS n_words
    FROM (SELECT user_id, {col} AS word, COUNT(*) AS cnt FROM tt GROUP BY 1, 2) w
    LEFT JOIN (
      SELECT w2.user_id, w2.word, SUM(b.p * th.count / (ws.W + (SELECT COUNT(*) FROM types) * {ALPHA})) AS s
      FROM (SELECT user_id, {col} AS word FROM tt GROUP BY 1, 2) w2
      JOIN (SELECT user_id, COUNT(*) AS W FROM tt GROUP BY 1) ws ON ws.user_id = w2.user_id
      JOIN (SELECT user_id, topic, COUNT(*) AS count FROM tt GROUP BY 1, 2) th ON th.user_id = w2.user_id
      JOIN ({beta_sql(dim)}) b ON b.topic = th.topic AND b.word = w2.word
      GROUP BY 1, 2) s ON s.user_id = w.user_id AND s.word = w.word"""


@query("perplexity", with_views(" UNION ALL ".join(_perp_sql(d) for d in "ODT"), **T), ("O-14",))
def q_perplexity(spark, sf):
    tt = typed(trips(spark, sf).checkpoint())
    z = tt.select("txn_type").distinct().count()
    out = mt.perplexity(dim_words_all(tt), type_counts(tt), empirical_beta_all(tt), ALPHA, z, by=["dim"])
    return out.select("dim", _r("perplexity"), "n_words")


@query("topic_match", with_views("""
SELECT topic_a, arg_min(topic_b, (-sim, topic_b)) AS match, ROUND(MAX(sim), 9) AS sim FROM (
  SELECT a.topic AS topic_a, b.topic AS topic_b,
         SUM(a.p * b.p) / (SQRT(MAX(na.n)) * SQRT(MAX(nb.n))) AS sim
  FROM ba a JOIN bb b ON a.word = b.word
  JOIN (SELECT topic, SUM(p * p) AS n FROM ba GROUP BY 1) na ON na.topic = a.topic
  JOIN (SELECT topic, SUM(p * p) AS n FROM bb GROUP BY 1) nb ON nb.topic = b.topic
  GROUP BY 1, 2)
GROUP BY 1""", **T, ba=beta_sql("O"), bb=beta_sql("D")), ("G-05", "J-05", "W-09"))
def q_topic_match(spark, sf):
    tt = typed(trips(spark, sf))
    sim = mt.topic_similarity(empirical_beta(tt, "O"), empirical_beta(tt, "D"))
    return mt.topic_match(sim).select("topic_a", "match", _r("sim"))


@query("reordered_topics", with_views("""
SELECT m.topic_a AS topic, b.word, ROUND(b.p, 12) AS p FROM bb b JOIN (
  SELECT topic_a, arg_min(topic_b, (-sim, topic_b)) AS match FROM (
    SELECT a.topic AS topic_a, b.topic AS topic_b,
           SUM(a.p * b.p) / (SQRT(MAX(na.n)) * SQRT(MAX(nb.n))) AS sim
    FROM ba a JOIN bb b ON a.word = b.word
    JOIN (SELECT topic, SUM(p * p) AS n FROM ba GROUP BY 1) na ON na.topic = a.topic
    JOIN (SELECT topic, SUM(p * p) AS n FROM bb GROUP BY 1) nb ON nb.topic = b.topic
    GROUP BY 1, 2) GROUP BY 1) m ON b.topic = m.match""", **T, ba=beta_sql("O"), bb=beta_sql("D")), ("G-06",))
def q_reordered_topics(spark, sf):
    tt = typed(trips(spark, sf))
    bd = empirical_beta(tt, "D")
    match = mt.topic_match(mt.topic_similarity(empirical_beta(tt, "O"), bd))
    return mt.reorder_topics(bd, match).select("topic", "word", F.round("p", 12).alias("p"))


# ---- step 7: destination inference on the empirical model ----------------------

def _empirical_model(spark, sf):
    """Empirical model as arrays: β over stations/hours, θ diagonal in (j, k, l).

    One model-sized collect (β of the three dimensions) gives the topics,
    the station and hour vocabularies and the β matrices.
    """
    tt = typed(trips(spark, sf))
    b = empirical_beta_all(tt).toPandas()
    names = sorted(set(b["topic"]))
    z = len(names)
    tix = {n: i for i, n in enumerate(names)}
    st = sorted(set(b.loc[b["dim"].isin(["O", "D"]), "word"].astype(int)))
    hr = sorted(set(b.loc[b["dim"] == "T", "word"].astype(int)))
    pos = {"O": {s: i for i, s in enumerate(st)}, "D": {s: i for i, s in enumerate(st)},
           "T": {h: i for i, h in enumerate(hr)}}
    mats = []
    for dim in "ODT":
        m = np.zeros((z, len(pos[dim])))
        part = b[b["dim"] == dim]
        m[[tix[n] for n in part["topic"]], [pos[dim][int(w)] for w in part["word"]]] = part["p"].to_numpy()
        with np.errstate(divide="ignore"):
            mats.append(np.where(m > 0, np.log(np.where(m > 0, m, 1.0)), -np.inf))
    diag = [i * z * z + i * z + i for i in range(z)]
    shares = type_counts(tt).withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("user_id")))
    theta = shares.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "share"))).alias("m"))
    theta = theta.select("user_id", F.array(*[
        (F.coalesce(F.col("m")[F.lit(names[diag.index(c)])], F.lit(0.0)) if c in diag else F.lit(0.0))
        for c in range(z ** 3)]).alias("theta"))
    st_df = spark.createDataFrame([(int(s), i) for s, i in pos["O"].items()], "station int, sid int")
    hr_df = spark.createDataFrame([(int(h), i) for h, i in pos["T"].items()], "hour int, hid int")
    ids = (tt.join(guarded_broadcast(st_df.withColumnRenamed("station", "origin").withColumnRenamed("sid", "o"), len(pos["O"])), "origin")
             .join(guarded_broadcast(st_df.withColumnRenamed("station", "dest").withColumnRenamed("sid", "d"), len(pos["O"])), "dest")
             .join(guarded_broadcast(hr_df.withColumnRenamed("hid", "t"), len(pos["T"])), "hour"))
    return ids, theta, tuple(mats), st_df


DEST_SQL = {
    **T,
    "bo": beta_sql("O"), "bd": beta_sql("D"), "bt": beta_sql("T"),
    "th": """SELECT user_id, topic, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY user_id) AS share
             FROM tt GROUP BY 1, 2""",
    "keys": "SELECT DISTINCT user_id, origin, hour FROM tt",
    # candidates = destinations with a non-zero score (equi-joins on the user's topics);
    # a zero-score destination can never be the argmax, since the trip's own one scores > 0
    "sc": """SELECT k.user_id, k.origin, k.hour, bd.word AS station, SUM(bo.p * bd.p * bt.p * th.share) AS s
             FROM keys k
             JOIN th ON th.user_id = k.user_id
             JOIN bo ON bo.topic = th.topic AND bo.word = k.origin
             JOIN bt ON bt.topic = th.topic AND bt.word = k.hour
             JOIN bd ON bd.topic = th.topic
             GROUP BY 1, 2, 3, 4""",
    "pred": """SELECT user_id, origin, hour, arg_min(station, (-ROUND(s / tot, 12), station)) AS pred FROM (
                 SELECT *, SUM(s) OVER (PARTITION BY user_id, origin, hour) AS tot FROM sc)
               GROUP BY 1, 2, 3""",
}


@query("destination_top1", with_views("SELECT user_id, origin, hour, pred FROM pred", **DEST_SQL),
       ("I-01", "I-02", "W-09"))
def q_destination_top1(spark, sf):
    ids, theta, beta, st_df = _empirical_model(spark, sf)
    p = predict_destinations(ids, theta, beta)
    names = st_df.select(F.col("sid").alias("pred"), F.col("station").alias("pred_station"))
    return (p.join(guarded_broadcast(names, beta[1].shape[1]), "pred")
            .select("user_id", "origin", "hour", F.col("pred_station").alias("pred")).distinct())


@query("destination_accuracy", with_views("""
SELECT user_id, CAST(correct AS BIGINT) AS correct, trips, correct * 1.0 / trips AS accuracy FROM (
  SELECT t.user_id, SUM(CASE WHEN p.pred = t.dest THEN 1 ELSE 0 END) AS correct, COUNT(*) AS trips
  FROM tt t JOIN pred p ON p.user_id = t.user_id AND p.origin = t.origin AND p.hour = t.hour GROUP BY 1
  UNION ALL
  SELECT -1, SUM(CASE WHEN p.pred = t.dest THEN 1 ELSE 0 END), COUNT(*)
  FROM tt t JOIN pred p ON p.user_id = t.user_id AND p.origin = t.origin AND p.hour = t.hour)""", **DEST_SQL),
    ("I-03", "A-19"))
def q_destination_accuracy(spark, sf):
    ids, theta, beta, _ = _empirical_model(spark, sf)
    acc = destination_accuracy(predict_destinations(ids, theta, beta))
    return acc.select("user_id", "correct", "trips", "accuracy")


# ---- step 8: distances and clustering ------------------------------------------

EMB_SQL = {
    "e": """SELECT vec_id, label, i, CAST(ABS(x) AS DOUBLE) AS a FROM (
              SELECT vec_id, label, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
    "dd": "SELECT vec_id, label, i, a / SUM(a) OVER (PARTITION BY vec_id) AS p FROM e",
    "cc": "SELECT label, i, AVG(p) AS q FROM dd GROUP BY 1, 2",
}


@query("js_to_centroid", with_views("""
SELECT vec_id, label, ROUND(SQRT(GREATEST(SUM(
         CASE WHEN p > 0 THEN p * LN(p / ((p + q) / 2)) ELSE 0 END +
         CASE WHEN q > 0 THEN q * LN(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 9) AS js
FROM dd JOIN cc USING (label, i) GROUP BY 1, 2""", **EMB_SQL), ("C-02", "P-13"))
def q_js_to_centroid(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", cl.abs_l1("embedding").alias("dist"))
    return cl.js_to_centroid(e, "vec_id", "label", "dist").select("vec_id", "label", _r("js"))


CU_SQL = {
    "items": "SELECT c_custkey, c_custkey % 5 AS c, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "lng": "SELECT c, 'seg' AS a, c_mktsegment AS v FROM items UNION ALL SELECT c, 'nat', nation FROM items",
}


@query("category_utility", with_views("""
SELECT CASE WHEN (SELECT COUNT(DISTINCT c) FROM items WHERE c BETWEEN 0 AND 4) < 5 THEN 0.0 ELSE
  ROUND((SUM(s_c / nc) - SUM(nc) * (SELECT SUM(cnt * cnt) FROM (SELECT a, v, COUNT(*) AS cnt FROM lng GROUP BY 1, 2))
        / POWER((SELECT COUNT(*) FROM items), 2)) / ((SELECT COUNT(*) FROM items) * 5), 9) END AS category_utility
FROM (SELECT c, SUM(cnt * cnt) AS s_c FROM (SELECT c, a, v, COUNT(*) AS cnt FROM lng GROUP BY 1, 2, 3) GROUP BY 1) x
JOIN (SELECT c, COUNT(*) AS nc FROM items GROUP BY 1) y USING (c)""", **CU_SQL), ("C-05",))
def q_category_utility(spark, sf):
    items = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 5).alias("cluster"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    return cl.category_utility(items, "cluster", ["c_mktsegment", "nation"], 5).select(_r("category_utility"))


@query("cluster_sizes", with_views("SELECT c AS cluster, COUNT(*) AS size FROM items GROUP BY 1", **CU_SQL),
       ("A-17",))
def q_cluster_sizes(spark, sf):
    items = table(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("cluster"))
    return cl.cluster_sizes(items)


@query("cluster_members", with_views("SELECT c_custkey FROM items WHERE c = 0", **CU_SQL), ("C-04",))
def q_cluster_members(spark, sf):
    items = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("cluster"))
    return items.filter(F.col("cluster") == 0).select("c_custkey")
