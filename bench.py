"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf", ...}.
Each query is executed in full with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trips_clean", "od_flow_hourly", "od_day_hour_tensor", "user_od_tensor", "home_work_users",
    "ranked_trips", "passenger_docs", "vocab", "tfidf", "topic_coherence", "perplexity",
    "destination_accuracy", "graph_step", "js_to_centroid", "category_utility",
    "tensor_lda_fit", "stream_od_flow", "tucker_factors", "flat_lda_topics", "stream_online_lda",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from triptopics import plans
    from triptopics.operators.topics.fit import TensorLDAConfig, infer_docs
    from triptopics.operators.topics.fit import init_model
    from triptopics.operators.topics.model import corpus_from_trips
    from triptopics.session import get_spark
    from triptopics.sources.fixtures import trips

    spark = get_spark()
    # untimed warm-up: JVM start, code generation, Python workers
    spark.range(200_000).selectExpr("id % 97 AS k").groupBy("k").count().write.format("noop").mode(
        "overwrite").save()
    spark.range(1_000).mapInPandas(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    qs = plans.queries()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    times: dict[str, float] = {}
    for name in only:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)

    # E-step throughput: one full pass over all passenger documents
    cfg = TensorLDAConfig()
    corpus = corpus_from_trips(trips(spark, sf_dir))
    docs = corpus.docs.cache()
    n_docs = docs.select("user_id").distinct().count()
    model = init_model(corpus, cfg)
    t0 = time.time()
    infer_docs(docs, model, cfg).write.format("noop").mode("overwrite").save()
    estep = time.time() - t0
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "estep_docs_per_sec": round(n_docs / estep, 1),
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }))


if __name__ == "__main__":
    main()
