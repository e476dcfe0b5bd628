"""Passenger mining: JS distances, category utility, categorical clustering (C-01 ... C-08).

All-pairs operations of the reference (the user × user Jensen-Shannon
matrix and complete-linkage clustering over it) are quadratic in the
number of passengers; here distances are taken to cluster or group
centroids (linear), and clustering is the category-utility method, run
as synchronous rounds over broadcast count tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import guarded_broadcast


# ---- distributions ----------------------------------------------------------

def abs_l1(col: str | Column) -> Column:
    """``abs(x) / sum(abs(x))`` over an array (P-13 on arrays)."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.aggregate(F.transform(c, lambda x: F.abs(x)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(c, lambda x: F.abs(x).cast("double") / s)


def js_distance(p: str | Column, q: str | Column) -> Column:
    """C-02: Jensen-Shannon distance sqrt((KL(p||m) + KL(q||m)) / 2), natural log."""
    pc = F.col(p) if isinstance(p, str) else p
    qc = F.col(q) if isinstance(q, str) else q

    def kl_half(a, b):
        return F.when(a > 0, a * F.log(a / ((a + b) / 2))).otherwise(F.lit(0.0))

    terms = F.zip_with(pc, qc, lambda a, b: kl_half(a, b) + kl_half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def group_centroids(df: DataFrame, group: str, dist: str) -> DataFrame:
    """Element-wise mean distribution of each group (bounded arrays)."""
    long = df.select(group, F.posexplode(dist).alias("i", "v"))
    mean = long.groupBy(group, "i").agg(F.avg("v").alias("v"))
    return mean.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_c")).select(
        group, F.transform("_c", lambda s: s["v"]).alias("centroid"))


def js_to_centroid(df: DataFrame, key: str, group: str, dist: str) -> DataFrame:
    """C-02 (re-aimed): JS distance of every distribution to its group centroid."""
    c = group_centroids(df, group, dist)
    return df.join(c, group).select(key, group, js_distance(dist, "centroid").alias("js"))


def flatten_theta_f_order(theta: str | Column, J: int, K: int, L: int) -> Column:
    """C-01: θ cells in column-major (j fastest) order from a j-major array."""
    c = F.col(theta) if isinstance(theta, str) else theta
    order = [j * K * L + k * L + l for l in range(L) for k in range(K) for j in range(J)]
    return F.array(*[c[i] for i in order])


# ---- category utility ---------------------------------------------------------

def category_utility(items: DataFrame, cluster: str, attrs: list[str], m: int) -> DataFrame:
    """C-05: CU = 1/m Σ_c P(c) [Σ_a Σ_v P(a=v|c)² − Σ_a Σ_v P(a=v)²]; 0 if a cluster
    of 0..m-1 is empty.

    Grouped counts only; the per-cluster and per-value terms are unioned
    into one final aggregate (no join of scalars).
    """
    long = items.select(F.col(cluster).alias("c"),
                        F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("string").alias("v"))
                                            for a in attrs])).alias("av"))
    cav = long.groupBy("c", "av").agg(F.count(F.lit(1)).alias("cnt"))
    per_c = (cav.groupBy("c").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("s_c"))
             .join(items.groupBy(F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("nc")), "c")
             .filter(F.col("c").between(0, m - 1))
             .select((F.col("s_c") / F.col("nc")).alias("a"), F.col("nc").cast("double").alias("nsum"),
                     F.lit(1.0).alias("k"), F.lit(0.0).alias("s_un"), F.lit(0.0).alias("n")))
    per_v = long.groupBy("av").agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit(0.0).alias("a"), F.lit(0.0).alias("nsum"), F.lit(0.0).alias("k"),
        (F.col("cnt") * F.col("cnt")).cast("double").alias("s_un"), F.lit(0.0).alias("n"))
    n = items.select(F.lit(0.0).alias("a"), F.lit(0.0).alias("nsum"), F.lit(0.0).alias("k"),
                     F.lit(0.0).alias("s_un"), F.lit(1.0).alias("n"))
    tot = per_c.unionByName(per_v).unionByName(n).agg(*[F.sum(c).alias(c) for c in ("a", "nsum", "k", "s_un", "n")])
    cu = (F.col("a") - F.col("nsum") * F.col("s_un") / (F.col("n") * F.col("n"))) / (F.col("n") * F.lit(m))
    return tot.select(F.when(F.col("k") < m, F.lit(0.0)).otherwise(cu).alias("category_utility"))


def assign_by_utility(codes: np.ndarray, kv: np.ndarray, nc: np.ndarray, U: float,
                      own: np.ndarray | None = None) -> np.ndarray:
    """Cluster whose category utility is best with each item in it (vectorised).

    ``kv[c, a, v]`` counts value v of attribute a in cluster c, ``nc[c]`` the
    cluster sizes, ``U = Σ_av P(a=v)²``.  With S_c = Σ_av kv[c,a,v]², CU is
    proportional to Σ_c (S_c/N_c − N_c U), and adding item x to cluster b
    changes only cluster b's term; an empty cluster makes CU 0 (Q29).
    ``own`` names the cluster that already counts the item (-1: none); the
    item is taken out of it before the moves are compared, so it is never
    counted twice.  Ties go to the item's own cluster, then to the lowest.
    """
    m, n_attr = kv.shape[0], codes.shape[1]
    n = len(codes)
    own = np.full(n, -1) if own is None else np.asarray(own)
    held = sum(kv[:, a, codes[:, a]] for a in range(n_attr)).T        # (n, m): Σ_a kv[c, a, x_a]
    inside = own[:, None] == np.arange(m)[None, :]
    # without the item: S_c − 2 Σ_a kv + A and N_c − 1 in its own cluster
    S = (kv ** 2).sum(axis=(1, 2))[None, :] - np.where(inside, 2.0 * held - n_attr, 0.0)
    N = nc.astype(np.float64)[None, :] - inside
    kv_of = held - np.where(inside, n_attr, 0)

    def term(s, size):
        return np.where(size > 0, s / np.where(size > 0, size, 1.0) - size * U, 0.0)

    base = term(S, N)
    score = base.sum(axis=1, keepdims=True) - base + term(S + 2.0 * kv_of + n_attr, N + 1.0)
    empty = N == 0
    others_empty = (empty.sum(axis=1, keepdims=True) - empty) > 0
    score = np.where(others_empty, 0.0, score)
    best = np.argmax(score, axis=1)
    stay = (own >= 0) & (score[np.arange(n), np.maximum(own, 0)] >= score[np.arange(n), best] - 1e-12)
    return np.where(stay, own, best)


def categorical_clusters(items: DataFrame, key: str, attrs: list[str], m: int, max_rounds: int = 100) -> DataFrame:
    """C-06 (re-aimed): cluster items with integer-coded attributes by category utility.

    The first ``m`` items by ``key`` seed clusters 0..m-1 (as in the
    reference's greedy pass) and stay there.  Round 0 places every other
    item where the utility of the seed clustering plus that item is best
    (the reference's decision for a next item); each later round takes every
    item out of its cluster and puts it where the previous round's counts
    make the utility best.  All items move at once, which can overshoot, so
    in odd rounds only items of odd ``key`` move and in even rounds those of
    even ``key``.  Rounds end when no item of either half moves; the column
    ``converged`` says whether that happened within ``max_rounds``.

    A round is one pass over the previous round's checkpointed table, which
    carries the attributes, and one grouped count (clusters × attribute values).
    """
    spark = items.sparkSession
    codes_of = [F.col(a).cast("int").alias(a) for a in attrs]
    seed_rows = items.select(key, *codes_of).orderBy(key).limit(m).collect()
    seeds = guarded_broadcast(spark.createDataFrame(
        pd.DataFrame({key: [r[0] for r in seed_rows], "_seed": np.arange(len(seed_rows), dtype=np.int32)})), m)
    fields = ", ".join(f"{a} int" for a in attrs)
    schema = f"{key} long, {fields}, _seed int, cluster int, changed int"
    now = items.select(F.col(key).cast("long").alias(key), *codes_of).join(seeds, key, "left").select(
        key, *attrs, F.coalesce("_seed", F.lit(-1)).alias("_seed"),
        F.coalesce("_seed", F.lit(-1)).alias("cluster"), F.lit(0).alias("changed")).checkpoint()

    def counts(df):
        long = df.select("cluster", F.explode(F.array(*[
            F.struct(F.lit(i).alias("ai"), F.col(a).alias("v")) for i, a in enumerate(attrs)])).alias("x"))
        return long.groupBy("cluster", "x.ai", "x.v").agg(F.count(F.lit(1)).alias("n")).toPandas()

    first = counts(now)
    total = first.groupby(["ai", "v"])["n"].sum()
    n_items = float(total[0].sum())
    U = float(((total / n_items) ** 2).sum())
    vmax = int(first["v"].max()) + 1

    def tables(pdf):
        kv = np.zeros((m, len(attrs), vmax))
        placed = pdf[pdf["cluster"] >= 0]
        kv[placed["cluster"].to_numpy(), placed["ai"].to_numpy(), placed["v"].to_numpy()] = placed["n"].to_numpy()
        return kv, kv[:, 0, :].sum(axis=1)

    def make_fn(kv, nc, half):
        def fn(batches):
            for pdf in batches:
                old, seed = pdf["cluster"].to_numpy(np.int64), pdf["_seed"].to_numpy(np.int64)
                moves = (seed < 0) & ((half is None) | (pdf[key].to_numpy() % 2 == half))
                best = assign_by_utility(pdf[attrs].to_numpy(np.int64), kv, nc, U, old)
                new = np.where(moves, best, old)
                yield pdf.assign(cluster=new.astype(np.int32), changed=(new != old).astype(np.int32))
        return fn

    kv, nc = tables(first)
    quiet = 0
    for rnd in range(max_rounds):
        now = now.mapInPandas(make_fn(kv, nc, None if rnd == 0 else rnd % 2), schema).checkpoint()
        moved = now.agg(F.sum("changed")).first()[0]
        quiet = quiet + 1 if rnd and not moved else 0
        if quiet == 2:
            break
        if moved:
            kv, nc = tables(counts(now))
    return now.select(key, "cluster").withColumn("converged", F.lit(quiet == 2))


def cluster_sizes(assign: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A-17: members per cluster."""
    return assign.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def cluster_topic_od(patterns: DataFrame, m: int, J: int, K: int, L: int) -> DataFrame:
    """A-18/C-07: per (cluster, time topic) the count of passengers in each
    (origin topic, destination topic) cell, zero cells included.  The cell
    grid is m·L·J·K (model-sized), generated with ``sequence`` + ``explode``."""
    counts = patterns.groupBy("cluster", "t_topic", "o_topic", "d_topic").agg(F.count(F.lit(1)).alias("n"))
    spark = patterns.sparkSession
    grid = (spark.range(m).select(F.col("id").cast("int").alias("cluster"))
            .withColumn("t_topic", F.explode(F.sequence(F.lit(0), F.lit(L - 1))))
            .withColumn("o_topic", F.explode(F.sequence(F.lit(0), F.lit(J - 1))))
            .withColumn("d_topic", F.explode(F.sequence(F.lit(0), F.lit(K - 1)))))
    return grid.join(counts, ["cluster", "t_topic", "o_topic", "d_topic"], "left").select(
        "cluster", "t_topic", "o_topic", "d_topic", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
