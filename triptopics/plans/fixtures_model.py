"""Deterministic models over the driver tables, so model metrics have SQL twins.

* empirical β: topic = trip type, p(word | topic) = share of the word among
  the type's trips (per dimension: origin, destination, hour);
* empirical θ: share of each type among a user's trips;
* stations of the line-item fixture are nations, which carry the POI
  stand-in (customers per nation × market segment) and the network
  stand-in (nations of one region are linked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..session import table

DIM_COLUMNS = {"O": "origin", "D": "dest", "T": "hour"}


def typed(trips: DataFrame) -> DataFrame:
    """Trips with ``topic`` = the trip type itself: a column expression, so no
    join (and no shuffle on a low-cardinality key) is needed."""
    return trips.withColumn("topic", F.col("txn_type"))


def empirical_beta(tt: DataFrame, dim: str) -> DataFrame:
    """``(topic, word, p)``: share of the word within the topic (model-sized)."""
    c = tt.groupBy("topic", F.col(DIM_COLUMNS[dim]).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("topic", "word", (F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).alias("p"))


def dim_long(tt: DataFrame) -> DataFrame:
    """One row per (trip, dimension): ``(user_id, topic, dim, word)``."""
    arr = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("word")) for d, c in DIM_COLUMNS.items()])
    return tt.select("user_id", "topic", F.explode(arr).alias("x")).select("user_id", "topic", "x.dim", "x.word")


def empirical_beta_all(tt: DataFrame) -> DataFrame:
    """``(dim, topic, word, p)`` for the three dimensions in one aggregate."""
    c = dim_long(tt).groupBy("dim", "topic", "word").agg(F.count(F.lit(1)).alias("n"))
    return c.select("dim", "topic", "word",
                    (F.col("n") / F.sum("n").over(Window.partitionBy("dim", "topic"))).alias("p"))


def dim_words_all(tt: DataFrame) -> DataFrame:
    return dim_long(tt).groupBy("user_id", "dim", "word").agg(F.count(F.lit(1)).alias("cnt"))


def type_counts(tt: DataFrame) -> DataFrame:
    """``(user_id, topic, count)``: the per-user topic counts of the empirical model."""
    return tt.groupBy("user_id", "topic").agg(F.count(F.lit(1)).cast("double").alias("count"))


def dim_words(tt: DataFrame, dim: str) -> DataFrame:
    return tt.groupBy("user_id", F.col(DIM_COLUMNS[dim]).alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def nation_graph(spark, sf: str, mu: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(poi long table, poi factors, mixed factors) on nations."""
    poi = gr.poi_table(table(spark, sf, "customer"))
    pf = gr.poi_factors(poi)
    nf = gr.region_factors(table(spark, sf, "nation"), "n_nationkey", "n_regionkey")
    return poi, pf, gr.mixed_factors(nf, pf, mu)


# SQL twins ------------------------------------------------------------------
TYPED_SQL = {
    "types": "SELECT DISTINCT txn_type AS topic FROM trips",
    "tt": "SELECT *, txn_type AS topic FROM trips",
}


def beta_sql(dim: str, src: str = "tt") -> str:
    col = DIM_COLUMNS[dim]
    return (f"SELECT topic, {col} AS word, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY topic) AS p "
            f"FROM {src} GROUP BY 1, 2")


POI_SQL = {
    "poi": """SELECT c_nationkey AS station, c_mktsegment AS category, CAST(COUNT(*) AS DOUBLE) AS value
              FROM customer GROUP BY 1, 2""",
    "pf": """SELECT station, category AS factor,
                    value / SQRT(SUM(value * value) OVER (PARTITION BY station)) AS weight FROM poi""",
    # explicit pair forms (the oracle may enumerate pairs; the engine never does)
    "cosg": """SELECT a.station AS s1, b.station AS s2, SUM(a.weight * b.weight) AS w
               FROM pf a JOIN pf b ON a.factor = b.factor WHERE a.station <> b.station GROUP BY 1, 2""",
    "netg": """SELECT a.n_nationkey AS s1, b.n_nationkey AS s2, 1.0 AS w FROM nation a JOIN nation b
               ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
}


def mixed_graph_sql(mu: float) -> str:
    return f"""SELECT s1, s2, SUM(w) AS w FROM (
        SELECT s1, s2, {mu} * w AS w FROM netg UNION ALL SELECT s1, s2, {1.0 - mu} * w FROM cosg)
        GROUP BY 1, 2"""
