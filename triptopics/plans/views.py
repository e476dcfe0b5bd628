"""Spark SQL temp views over the derived tables, for users who prefer SQL.

``register_views(spark, sf_dir)`` defines lazy views; nothing is computed
until a query reads them, and Catalyst optimises across view boundaries.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import docs as dc
from ..operators import flow
from ..sources.fixtures import trips, trips_od

VIEWS = ("trips", "trips_od", "doc_triples", "od_flow_hourly", "od_tensor", "user_od_tensor")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    t = trips(spark, sf_dir)
    frames = {
        "trips": t,
        "trips_od": trips_od(spark, sf_dir),
        "doc_triples": dc.doc_triples(t),
        "od_flow_hourly": flow.od_flow_hourly(t),
        "od_tensor": flow.od_tensor(t, 1),
        "user_od_tensor": flow.user_od_tensor(t, 7),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)
