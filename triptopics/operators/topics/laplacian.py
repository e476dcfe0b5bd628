"""The graph-regularised M-step over an edge table of any size (O-08, S-05).

Topic rows are a table by station, one array of topics each; the graph is a table of weighted edges kept
partitioned by the station they read from.  A gradient step sends p along the edges (a join), adds it up
by the station it reaches (a grouped sum) and moves every station's row; what concerns a whole topic (the mean
of the gradient, the row sum for normalising, the squares of the norm) is one aggregate of a few
numbers per topic.  Nothing of the graph or of p comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import ensure_checkpoint_dir
from .mstep import CLAMP


@dataclass
class GraphFit:
    p: DataFrame            # station, p: array of topic probabilities of the station
    steps: int
    converged: bool


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """S-05: an edge table (w1, w2, weight) as it lies."""
    return spark.read.parquet(path).select("w1", "w2", "weight")


def _each(topics: int, of) -> Column:
    return F.array(*[of(k) for k in range(topics)])


def laplacian_m_step(p0: DataFrame, edges: DataFrame, topics: int, lam: float, g_step: float = 1e-3, tol: float = 1e-3,
                     max_iter: int = 200, centered: bool = True) -> GraphFit:
    """Projected gradient ascent of ``mstep.graph_m_step`` on tables.

    ``p0(station, p)`` has positive probabilities, one row a station; ``edges(w1, w2, weight)`` lists both
    directions of an edge; edges of unknown stations and without weight are left out.  Ends when the norm of p changes
    by at most ``tol`` of itself (``converged``), or after ``max_iter`` steps."""
    ensure_checkpoint_dir(p0.sparkSession)
    start = p0.select("station", F.col("p").alias("p0"), "p").checkpoint()
    known = start.select(F.col("station").alias("w1"))
    links = edges.where("weight <> 0").join(known, "w1", "left_semi").select(
        F.col("w1").alias("station"), F.col("w2").alias("source"), F.col("weight").cast("double").alias("w")).join(
        known.withColumnRenamed("w1", "source"), "source", "left_semi").repartition("source").persist(StorageLevel.MEMORY_AND_DISK)
    degree = links.groupBy("station").agg(F.sum("w").alias("deg"))
    now = start.join(degree, "station", "left").select("station", "p0", "p", F.coalesce("deg", F.lit(0.0)).alias("deg")).checkpoint()
    norm, converged, it = 0.1, False, 0
    while it < max_iter and not converged:
        it += 1
        sent = links.join(now.select(F.col("station").alias("source"), F.col("p").alias("q")), "source")
        got = sent.groupBy("station").agg(*[F.sum(F.col("w") * F.col("q")[k]).alias(f"g{k}") for k in range(topics)])
        slope = _each(topics, lambda k: F.lit(lam) * F.col("p0")[k] / F.col("p")[k] - F.lit(1.0 - lam) * (
            F.col("deg") * F.col("p")[k] - F.coalesce(f"g{k}", F.lit(0.0))))
        moved = now.join(got, "station", "left").select("station", "p0", "p", "deg", slope.alias("slope")).checkpoint()
        means = moved.agg(*[F.avg(F.col("slope")[k]) for k in range(topics)]).first() if centered else [0.0] * topics
        if means[0] is None:
            break
        stepped = moved.select("station", "p0", "deg", _each(topics, lambda k: F.col("p")[k] + F.lit(g_step) * (F.col("slope")[k] - F.lit(float(means[k])))).alias("p"))
        stepped = stepped.withColumn("p", F.transform("p", lambda x: F.when(x <= 0, F.lit(CLAMP)).otherwise(x)))
        sums = stepped.agg(*[F.sum(F.col("p")[k]) for k in range(topics)], *[F.sum(F.col("p")[k] * F.col("p")[k]) for k in range(topics)]).first()
        total, square = np.array(sums[:topics], float), np.array(sums[topics:], float)
        now = stepped.select("station", "p0", _each(topics, lambda k: F.col("p")[k] / F.lit(float(total[k]))).alias("p"), "deg")
        last, norm = norm, float(np.sqrt((square / total ** 2).sum()))
        converged = abs(norm - last) / last <= tol
    out = now.select("station", "p").checkpoint()
    links.unpersist()
    return GraphFit(out, it, converged)
