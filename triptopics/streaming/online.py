"""T-01/T-02: online tensor topic model fed by a trip stream.

Each micro-batch's trips become bag-of-triple documents (word ids from a
fixed vocabulary), one online update runs (E-step job + driver M-step +
ρ blend), and β is written as version ``v=<batch id>``.  A replayed
micro-batch finds its version already written and only reloads it, so
the model advances exactly once per batch.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import guarded_broadcast
from ..operators.topics.fit import TensorLDAConfig, online_update
from ..operators.topics.model import TopicModel
from .ops import scratch_path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed β versions: folders ``v=<batch id>`` under ``path`` whose write finished (``_SUCCESS``)."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getParent().getName().removeprefix("v=")) for f in fs.globStatus(done) or [])


def stream_online_lda(trips_stream: DataFrame, model: TopicModel, cfg: TensorLDAConfig,
                      tau0: float = 16.0, kappa: float = 0.5, model_path: str | None = None,
                      eval_fn=None, eval_every: int = 1) -> tuple[str, list]:
    """Run the online learner over the stream until no data is left.

    ``model`` supplies the initial β and the vocabularies; ``eval_fn(model,
    batch_id)`` (e.g. hold-out perplexity) runs when ``batch_id % eval_every
    == eval_every - 1`` (T-02).  Returns the β version folder and the metric rows.
    """
    spark = trips_stream.sparkSession
    path = model_path or scratch_path(spark, "online-beta")
    st = spark.createDataFrame(pd.DataFrame({"value": model.stations.astype(np.int32),
                                             "id": np.arange(model.stations.size, dtype=np.int32)}))
    hr = spark.createDataFrame(pd.DataFrame({"value": model.hours.astype(np.int32),
                                             "id": np.arange(model.hours.size, dtype=np.int32)}))
    state = {"model": model, "version": -1}
    history: list = []

    def load(version: int) -> TopicModel:
        pdf = spark.read.parquet(f"{path}/v={version}").toPandas()
        m = TopicModel.from_beta_pandas(pdf, model.alpha)
        m.stations, m.hours = model.stations, model.hours
        m.steps, m.elbo_old = int(pdf["steps"].iloc[0]), float(pdf["elbo_old"].iloc[0])
        return m

    def process(batch_df: DataFrame, batch_id: int) -> None:
        done = _versions(spark, path)
        if batch_id in done:
            # replay: the model already absorbed this batch; still consume every partition,
            # so the upstream stateful operator commits its state for this batch
            batch_df.write.format("noop").mode("overwrite").save()
            state.update(model=load(batch_id), version=batch_id)
            return
        if done and state["version"] < max(done):
            state["model"] = load(max(done))          # a restart goes on from the last committed version
        tri = batch_df.groupBy("user_id", "origin", "dest", "hour").agg(F.count(F.lit(1)).alias("cnt"))
        docs = (tri.join(guarded_broadcast(st.withColumnRenamed("value", "origin").withColumnRenamed("id", "o"), model.stations.size), "origin")
                   .join(guarded_broadcast(st.withColumnRenamed("value", "dest").withColumnRenamed("id", "d"), model.stations.size), "dest")
                   .join(guarded_broadcast(hr.withColumnRenamed("value", "hour").withColumnRenamed("id", "t"), model.hours.size), "hour")
                   .select("user_id", "o", "d", "t", "cnt"))
        m, ll, n_docs = online_update(state["model"], docs, cfg, tau0, kappa)
        # steps and the ELBO baseline go with β: an empty batch absorbs nothing, a restart forgets nothing
        (m.beta_frame(spark).withColumn("steps", F.lit(m.steps)).withColumn("elbo_old", F.lit(float(m.elbo_old)))
         .write.mode("overwrite").parquet(f"{path}/v={batch_id}"))
        state.update(model=m, version=batch_id)
        history.append((int(batch_id), "batch_elbo", float(ll), int(n_docs)))
        if eval_fn is not None and batch_id % eval_every == eval_every - 1:
            for name, value in eval_fn(m, batch_id):
                history.append((int(batch_id), name, float(value), int(n_docs)))

    q = (trips_stream.writeStream.foreachBatch(process)
         .option("checkpointLocation", scratch_path(spark, "ckpt-online"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return path, history


def latest_beta(spark: SparkSession, path: str) -> DataFrame | None:
    v = _versions(spark, path)
    return spark.read.parquet(os.path.join(path, f"v={v[-1]}")).drop("steps", "elbo_old") if v else None
