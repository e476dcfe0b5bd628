"""Model state of the three-way topic model and its table forms."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.indexing import guarded_broadcast
from ...session import ensure_checkpoint_dir
from ..docs import doc_triples, station_vocab

BETA_SCHEMA = "dim string, topic int, word_id int, value int, logp double"


@dataclass
class TopicModel:
    log_bo: np.ndarray               # J × V  (origin topics over stations)
    log_bd: np.ndarray               # K × V  (destination topics over stations)
    log_bt: np.ndarray               # L × T  (time topics over hours)
    alpha: float
    stations: np.ndarray             # word id -> station number
    hours: np.ndarray                # word id -> hour
    steps: int = 0                   # mini-batches absorbed (online)
    history: list[dict] = field(default_factory=list)
    elbo_old: float = 0.1            # ELBO baseline kept across mini-batches (Q10)

    @property
    def beta(self):
        return self.log_bo, self.log_bd, self.log_bt

    @property
    def shape(self):
        return self.log_bo.shape, self.log_bd.shape, self.log_bt.shape

    def beta_pandas(self) -> pd.DataFrame:
        parts = []
        for dim, m, values in (("O", self.log_bo, self.stations), ("D", self.log_bd, self.stations),
                               ("T", self.log_bt, self.hours)):
            z, w = np.indices(m.shape)
            parts.append(pd.DataFrame({"dim": dim, "topic": z.ravel().astype(np.int32),
                                       "word_id": w.ravel().astype(np.int32),
                                       "value": values[w.ravel()].astype(np.int32),
                                       "logp": m.ravel()}))
        return pd.concat(parts, ignore_index=True)

    def beta_frame(self, spark: SparkSession) -> DataFrame:
        """``beta(dim, topic, word_id, value, logp)``; model-sized."""
        return spark.createDataFrame(self.beta_pandas(), BETA_SCHEMA)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """O-17: metric rows ``(step, name, value, elapsed_s, elapsed_min)`` (P-16: whole minutes)."""
        rows = [(int(h["step"]), str(h["name"]), float(h["value"]), float(h["elapsed_s"]))
                for h in self.history]
        df = spark.createDataFrame(rows, "step int, name string, value double, elapsed_s double")
        return df.withColumn("elapsed_min", (F.col("elapsed_s") / 60).cast("int"))

    def save(self, spark: SparkSession, path: str, run_id: str, lam: float) -> None:
        """S-07: β as one table partitioned by run and λ (overwrites that partition only)."""
        (self.beta_frame(spark).withColumn("run_id", F.lit(run_id)).withColumn("lam", F.lit(float(lam)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "lam").parquet(path))

    def save_docs(self, inferred: DataFrame, path: str, run_id: str, lam: float) -> None:
        """S-07: θ and γ of every document (``infer_docs``), partitioned like β; γ = α + wordcount · θ."""
        gamma = F.transform("theta", lambda x: F.lit(float(self.alpha)) + F.col("wordcount") * x)
        (inferred.select("user_id", "wordcount", "theta", gamma.alias("gamma"), F.lit(run_id).alias("run_id"),
                         F.lit(float(lam)).alias("lam"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "lam").parquet(path))

    @classmethod
    def from_beta_pandas(cls, pdf: pd.DataFrame, alpha: float) -> TopicModel:
        mats, values = {}, {}
        for dim in ("O", "D", "T"):
            p = pdf[pdf["dim"] == dim]
            m = np.full((p["topic"].max() + 1, p["word_id"].max() + 1), -100.0)
            m[p["topic"].to_numpy(), p["word_id"].to_numpy()] = p["logp"].to_numpy()
            mats[dim] = m
            v = np.zeros(m.shape[1], dtype=np.int64)
            v[p["word_id"].to_numpy()] = p["value"].to_numpy()
            values[dim] = v
        return cls(mats["O"], mats["D"], mats["T"], alpha, values["O"], values["T"])


@dataclass
class Corpus:
    """Documents with word ids plus the vocabulary that maps them back."""
    docs: DataFrame                  # user_id, o, d, t, cnt (ids)
    stations: np.ndarray
    hours: np.ndarray
    users: DataFrame | None = None   # user_id of every trip's traveller

    @property
    def n_stations(self) -> int:
        return int(self.stations.size)

    @property
    def n_hours(self) -> int:
        return int(self.hours.size)


def vocab_arrays(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Collect the station and hour vocabularies (bounded by the network size)."""
    v = vocab.toPandas()
    st = v[v["dim"] == "S"].sort_values("id")["value"].to_numpy(np.int64)
    hr = v[v["dim"] == "T"].sort_values("id")["value"].to_numpy(np.int64)
    return st, hr


def corpus_from_trips(trips: DataFrame, vocab_trips: DataFrame | None = None, with_last: bool = False,
                      order: tuple[str, ...] = ("ts", "event_id")) -> Corpus:
    """Bag-of-triples documents with dense word ids.

    The vocabulary comes from ``vocab_trips`` (e.g. training users only,
    Q31) or from all trips; triples with an unknown word are dropped.
    ``with_last`` flags the triple of each user's last trip (legacy E-step),
    from one per-user ``max_by`` aggregate.
    """
    spark = trips.sparkSession
    ensure_checkpoint_dir(spark)
    # the triples hold every station, hour and traveller: the trips are derived once, for all that reads the corpus
    tri = doc_triples(trips).checkpoint()
    words = tri.select(F.col("o").alias("origin"), F.col("d").alias("dest"), F.col("t").alias("hour"))
    stations, hours = vocab_arrays(station_vocab(vocab_trips if vocab_trips is not None else words))
    # the collected vocabulary (exact size known) goes back as small broadcast tables,
    # so the join does not recompute the vocabulary from the trips
    st = guarded_broadcast(spark.createDataFrame(pd.DataFrame(
        {"value": stations.astype(np.int32), "id": np.arange(stations.size, dtype=np.int32)})), stations.size)
    hr = guarded_broadcast(spark.createDataFrame(pd.DataFrame(
        {"value": hours.astype(np.int32), "id": np.arange(hours.size, dtype=np.int32)})), hours.size)
    users = tri.select("user_id").distinct()
    if with_last:
        last = trips.groupBy("user_id").agg(F.max_by(F.struct(
            F.col("origin").alias("lo"), F.col("dest").alias("ld"), F.col("hour").alias("lt")),
            F.struct(*[F.col(c) for c in order])).alias("_l"))
        tri = tri.join(last, "user_id").withColumn(
            "last", (F.col("o") == F.col("_l.lo")) & (F.col("d") == F.col("_l.ld")) & (F.col("t") == F.col("_l.lt"))
        ).drop("_l")
    ids = (tri.join(st.select(F.col("value").alias("o"), F.col("id").alias("o_id")), "o")
              .join(st.select(F.col("value").alias("d"), F.col("id").alias("d_id")), "d")
              .join(hr.select(F.col("value").alias("t"), F.col("id").alias("t_id")), "t")
              .select("user_id", F.col("o_id").alias("o"), F.col("d_id").alias("d"),
                      F.col("t_id").alias("t"), "cnt", *(["last"] if with_last else [])))
    return Corpus(ids, stations, hours, users)
