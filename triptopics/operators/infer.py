"""Destination inference (I-01 ... I-03, A-19).

For a trip with origin o at hour t by passenger u, every destination d of
the vocabulary is scored exactly:

    p(d | o, t, u) ∝ Σ_jkl βO[j,o] βD[k,d] βT[l,t] θ_u[j,k,l]
                   = Σ_k βD[k,d] · w_k,   w_k = Σ_jl βO[j,o] βT[l,t] θ_u[j,k,l]

Scores are computed once per distinct (user, o, t) in Arrow batches of whole
travellers (β in the closure: topics × vocabulary) and joined back to the
trips.  The argmax takes the lowest destination id among equal scores;
scores are normalised and rounded to 12 decimals first so that equal
candidates compare equal whatever the summation order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORE_DECIMALS = 12


def destination_scores(theta: np.ndarray, o: np.ndarray, t: np.ndarray, lo, ld, lt) -> np.ndarray:
    """(n, V) normalised destination distribution for n (θ, o, t) rows."""
    J, K, L = lo.shape[0], ld.shape[0], lt.shape[0]
    th = theta.reshape(-1, J, K, L)
    w = np.einsum("njkl,nj,nl->nk", th, np.exp(lo[:, o]).T, np.exp(lt[:, t]).T)
    s = w @ np.exp(ld)
    return s / s.sum(axis=1, keepdims=True)


KEY_ROWS = 2_048            # (user, origin, time) keys scored at once
SCORED = "user_id bigint, o int, t int, pred int"


def predict_destinations(trips_ids: DataFrame, theta: DataFrame, beta) -> DataFrame:
    """I-01/I-02: most likely destination id for each trip.

    ``trips_ids(user_id, o, d, t, ...)`` with word ids; ``theta(user_id, theta)``.  A traveller's distinct
    (o, t) keys, at most stations x hours, are gathered into one row, so θ goes to the scoring once a
    traveller and not once a key.
    """
    lo, ld, lt = beta

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mixtures = batch.column("theta").flatten().to_numpy().reshape(batch.num_rows, -1)
            keys = batch.column("keys")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(keys).to_numpy())
            o, t = (pc.struct_field(keys.flatten(), k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("o", "t"))
            users = batch.column("user_id").to_numpy()
            for s in range(0, len(owner), KEY_ROWS):
                z = slice(s, s + KEY_ROWS)
                p = destination_scores(mixtures[owner[z]], o[z], t[z], lo, ld, lt)
                best = np.argmax(np.round(p, SCORE_DECIMALS), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(users[owner[z]], pa.int64()), *(pa.array(x, pa.int32()) for x in (o[z], t[z], best))], names=["user_id", "o", "t", "pred"])

    keys = trips_ids.groupBy("user_id").agg(F.collect_set(F.struct(F.col("o").cast("int").alias("o"), F.col("t").cast("int").alias("t"))).alias("keys"))
    scored = keys.join(theta.select("user_id", "theta"), "user_id").select(F.col("user_id").cast("long"), "keys", "theta").mapInArrow(run, SCORED)
    return trips_ids.join(scored, ["user_id", "o", "t"])


def destination_accuracy(predicted: DataFrame) -> DataFrame:
    """I-03/A-19: share of correctly predicted trips per user; the row with ``user_id`` = -1 holds the
    overall ratio.  A row with a ``cnt`` column stands for that many equal trips."""
    trips = F.col("cnt") if "cnt" in predicted.columns else F.lit(1)
    hit = predicted.select("user_id", trips.cast("bigint").alias("n"),
                           F.when(F.col("pred") == F.col("d"), trips).otherwise(0).cast("bigint").alias("hit"))
    per_user = hit.groupBy("user_id").agg(F.sum("hit").alias("correct"), F.sum("n").alias("trips"))
    overall = per_user.agg(F.sum("correct").alias("correct"), F.sum("trips").alias("trips")).select(
        F.lit(-1).cast("bigint").alias("user_id"), "correct", "trips")
    out = per_user.unionByName(overall)
    return out.withColumn("accuracy", F.col("correct") / F.col("trips"))
