"""Station graphs in factored form (G-01 ... G-04, G-07, G-08).

A station graph is stored as a factor table ``(station, factor, weight)``
meaning G = F Fᵀ (plus optional weighted blocks for mixtures):

* POI cosine graph: F = row-normalised POI vectors (factor = category),
  so G_ij = cos(poi_i, poi_j); a zero POI vector gives a zero row (Q25);
* network graph "same region, different station": F = region membership
  (factor = region); its diagonal is irrelevant because every use below
  (Laplacian quadratic form, gradient deg∘p − Gp) cancels it.

Every graph quantity is then a join on ``factor`` plus grouped sums, in
O(stations × factors) rows: no station × station product is ever formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indexing import guarded_broadcast
from .topics.mstep import StationGraph


def poi_table(customer: DataFrame) -> DataFrame:
    """Stand-in POI table: customers per (nation, market segment)."""
    return customer.groupBy(F.col("c_nationkey").alias("station"), F.col("c_mktsegment").alias("category")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))


def poi_factors(poi: DataFrame) -> DataFrame:
    """G-01: cosine graph factors: value / ||poi vector of the station||."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("station")))
    return poi.select("station", F.col("category").cast("string").alias("factor"),
                      F.when(norm > 0, F.col("value") / norm).otherwise(F.lit(0.0)).alias("weight"))


def region_factors(stations: DataFrame, station: str, group: str) -> DataFrame:
    """Network graph factors: stations sharing ``group`` are linked."""
    return stations.select(F.col(station).alias("station"), F.col(group).cast("string").alias("factor"),
                           F.lit(1.0).alias("weight"))


def mixed_factors(net: DataFrame, poi: DataFrame, mu: float) -> DataFrame:
    """G-02: μ·G_net + (1−μ)·G_poi as one factor table (weights scaled by √μ, √(1−μ))."""
    a = net.select("station", F.concat(F.lit("net:"), "factor").alias("factor"),
                   (F.col("weight") * F.lit(float(np.sqrt(mu)))).alias("weight"))
    b = poi.select("station", F.concat(F.lit("poi:"), "factor").alias("factor"),
                   (F.col("weight") * F.lit(float(np.sqrt(1.0 - mu)))).alias("weight"))
    return a.unionByName(b)


def degree(factors: DataFrame) -> DataFrame:
    """G-03 diagonal: deg_i = Σ_{j≠i} G_ij = F_i · (Σ_j F_j) − F_i · F_i."""
    col_sum = factors.groupBy("factor").agg(F.sum("weight").alias("fs"))
    d = factors.join(col_sum, "factor").groupBy("station").agg(
        F.sum(F.col("weight") * F.col("fs")).alias("a"), F.sum(F.col("weight") * F.col("weight")).alias("self"))
    return d.select("station", (F.col("a") - F.col("self")).alias("degree"))


def smoothness(p: DataFrame, factors: DataFrame) -> DataFrame:
    """G-04: p L pᵀ per topic for p(topic, station, p), L the Laplacian of G
    (diagonal of G ignored): Σ_i deg_i p_i² − Σ_{i≠j} G_ij p_i p_j
    = Σ_i (F_i·ΣF) p_i² − Σ_f (Σ_i F_if p_i)² + ... the self terms cancel."""
    col_sum = factors.groupBy("factor").agg(F.sum("weight").alias("fs"))
    full_deg = factors.join(col_sum, "factor").groupBy("station").agg(
        F.sum(F.col("weight") * F.col("fs")).alias("fdeg"))
    term1 = p.join(full_deg, "station").groupBy("topic").agg(
        F.sum(F.col("fdeg") * F.col("p") * F.col("p")).alias("t1"))
    proj = p.join(factors, "station").groupBy("topic", "factor").agg(
        F.sum(F.col("weight") * F.col("p")).alias("s"))
    term2 = proj.groupBy("topic").agg(F.sum(F.col("s") * F.col("s")).alias("t2"))
    return term1.join(term2, "topic", "left").select(
        "topic", (F.col("t1") - F.coalesce("t2", F.lit(0.0))).alias("smoothness"))


def gradient_step(p0: DataFrame, factors: DataFrame, lam: float, g_step: float,
                  centered: bool = False) -> DataFrame:
    """O-08, one step from p = p0 as DataFrame algebra.

    grad_i = λ p0_i/p_i − (1−λ)(deg_i p_i − (G p)_i) with G p = F (Fᵀ p); then
    p + g·grad, non-positive → 1e-2, L1 per topic.  ``p0(topic, station, p)``
    must list every (topic, station) of the model (zeros included).
    """
    col_sum = factors.groupBy("factor").agg(F.sum("weight").alias("fs"))
    fdeg = factors.join(col_sum, "factor").groupBy("station").agg(
        F.sum(F.col("weight") * F.col("fs")).alias("fdeg"))
    proj = p0.join(factors, "station").groupBy("topic", "factor").agg(F.sum(F.col("weight") * F.col("p")).alias("s"))
    gp = factors.join(proj, "factor").groupBy("topic", "station").agg(F.sum(F.col("weight") * F.col("s")).alias("gp"))
    g = (p0.join(fdeg, "station", "left").join(gp, ["topic", "station"], "left")
         .withColumn("grad", F.lit(lam) - F.lit(1.0 - lam) * (
             F.coalesce("fdeg", F.lit(0.0)) * F.col("p") - F.coalesce("gp", F.lit(0.0)))))
    if centered:
        g = g.withColumn("grad", F.col("grad") - F.avg("grad").over(Window.partitionBy("topic")))
    stepped = g.withColumn("p1", F.col("p") + F.lit(g_step) * F.col("grad"))
    stepped = stepped.withColumn("p1", F.when(F.col("p1") <= 0, F.lit(1e-2)).otherwise(F.col("p1")))
    total = F.sum("p1").over(Window.partitionBy("topic"))
    return stepped.select("topic", "station", (F.col("p1") / total).alias("p"))


def poi_profile(beta: DataFrame, poi: DataFrame) -> DataFrame:
    """G-07: Σ_w p(w | topic) · poi(w, category), L1-normalised per topic."""
    prof = beta.join(guarded_broadcast(poi), "station").groupBy("topic", "category").agg(
        F.sum(F.col("p") * F.col("value")).alias("v"))
    return prof.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("topic"))).drop("v")


def to_station_graph(factors_pdf, station_ids: np.ndarray) -> StationGraph:
    """Factor table (collected: stations × factors, model-sized) -> M-step graph."""
    pos = {int(s): i for i, s in enumerate(station_ids)}
    names = sorted(set(factors_pdf["factor"]))
    col = {f: i for i, f in enumerate(names)}
    fm = np.zeros((len(station_ids), len(names)))
    for s, f, w in zip(factors_pdf["station"], factors_pdf["factor"], factors_pdf["weight"]):
        if int(s) in pos:
            fm[pos[int(s)], col[f]] = w
    return StationGraph(len(station_ids), [(1.0, fm)])


def edge_graph(edges_pdf, station_ids: np.ndarray) -> StationGraph:
    """S-05: a sparse station graph from an edge table ``(w1, w2, weight)`` keyed
    by station number (collected: one row per edge of the network)."""
    pos = {int(s): i for i, s in enumerate(station_ids)}
    keep = [k for k in range(len(edges_pdf)) if int(edges_pdf["w1"].iloc[k]) in pos
            and int(edges_pdf["w2"].iloc[k]) in pos]
    i = np.array([pos[int(edges_pdf["w1"].iloc[k])] for k in keep], dtype=np.int64)
    j = np.array([pos[int(edges_pdf["w2"].iloc[k])] for k in keep], dtype=np.int64)
    v = edges_pdf["weight"].to_numpy(np.float64)[keep]
    return StationGraph(len(station_ids), edges=[(1.0, i, j, v)])


def read_edge_graph(spark, path: str, station_ids: np.ndarray) -> StationGraph:
    """S-05: load an edge-table parquet into the M-step graph form."""
    return edge_graph(spark.read.parquet(path).select("w1", "w2", "weight").toPandas(), station_ids)
