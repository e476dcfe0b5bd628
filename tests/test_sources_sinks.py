"""Sources and sinks: fare CSVs (day files, bad timestamps), edge graphs, model and OD-matrix sinks."""

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from triptopics.operators.graph import edge_graph, read_edge_graph
from triptopics.operators.topics.model import TopicModel
from triptopics.operators.docs import passenger_docs
from triptopics.sources.files import (bad_timestamps, read_docs, read_fare_csv, read_fare_days, read_poi, write_docs,
                                      write_fare_days, write_table)
from triptopics.sources.fixtures import trips



def test_fare_csv_days_filter_and_bad_timestamps(spark):
    root = tempfile.mkdtemp(prefix="tt-fare-")
    rows = {
        "20170227": [(1, "27/02/2017 08:00:00", "USE", "A", 3, 5), (1, "27/02/2017 18:30:00", "USE", "A", 5, 3),
                     (2, "27/02/2017 09:00:00", "ENT", "B", 1, 2)],
        "20170228": [(1, "28/02/2017 10:00:00", "USE", "A", 3, 7), (3, "31/02/2017 10:00:00", "USE", "C", 4, 4)],
    }
    cols = ["CSC_PHY_ID", "TXN_DT", "TXN_TYPE_CO", "TXN_SUBTYPE_CO", "TRAIN_ENTRY_STN", "TXN_LOC"]
    for day, r in rows.items():
        pd.DataFrame(r, columns=cols).to_csv(f"{root}/DW_FARE_TXN_ENTRY_TXN_{day}.csv", index=False)
    t = read_fare_csv(spark, f"{root}/DW_FARE_TXN_ENTRY_TXN_*.csv").toPandas()
    assert len(t) == 3                                   # ENT dropped, 31/02 -> NULL dropped
    assert sorted(t["hour"]) == [8, 10, 18]
    bad = bad_timestamps(spark, f"{root}/DW_FARE_TXN_ENTRY_TXN_*.csv").orderBy("file_day").collect()
    assert [(r.rows, r.dropped) for r in bad] == [(2, 0), (2, 1)]
    assert set(t["file_day"].astype(str)) == {"2017-02-27", "2017-02-28"}


def test_poi_reader_long_form(spark):
    p = tempfile.mkdtemp(prefix="tt-poi-") + "/poi.csv"
    pd.DataFrame({"stn": [1, 2], "name": ["a", "b"], "c1": [1.0, 0.0], "c2": [2.0, 0.0]}).to_csv(p, index=False)
    poi = read_poi(spark, p, "stn", ["c1", "c2"]).toPandas()
    assert len(poi) == 4 and poi["value"].sum() == 3.0


def test_edge_graph_matches_dense(spark):
    edges = pd.DataFrame({"w1": [10, 11, 12, 10], "w2": [11, 10, 10, 12], "weight": [1.0, 1.0, 0.5, 0.5]})
    g = edge_graph(edges, np.array([10, 11, 12]))
    dense = np.array([[0, 1, 0.5], [1, 0, 0], [0.5, 0, 0]])
    assert np.allclose(g.dense(), dense)
    path = tempfile.mkdtemp(prefix="tt-edges-") + "/g.parquet"
    spark.createDataFrame(edges).write.parquet(path)
    assert np.allclose(read_edge_graph(spark, path, np.array([10, 11, 12])).dense(), dense)


def test_model_and_matrix_sinks(spark):
    rng = np.random.default_rng(0)
    m = TopicModel(np.log(rng.dirichlet(np.ones(4), 2)), np.log(rng.dirichlet(np.ones(4), 3)),
                   np.log(rng.dirichlet(np.ones(3), 2)), 5.0, np.array([3, 5, 7, 9]), np.array([6, 7, 8]))
    path = tempfile.mkdtemp(prefix="tt-model-")
    m.save(spark, path, "run1", 0.1)
    m.save(spark, path, "run1", 0.2)
    back = spark.read.parquet(path)
    assert back.select("lam").distinct().count() == 2
    again = TopicModel.from_beta_pandas(back.filter(F.col("lam") == 0.1).toPandas(), 5.0)
    assert np.allclose(again.log_bd, m.log_bd) and list(again.stations) == [3, 5, 7, 9]
    od = spark.createDataFrame(pd.DataFrame({"cluster": [0, 0, 1], "t_topic": [0, 1, 0], "o_topic": [1, 2, 3],
                                             "d_topic": [0, 0, 1], "n": [5, 1, 2]}))
    out = tempfile.mkdtemp(prefix="tt-odm-")
    write_table(od, out, ["cluster", "t_topic"])
    assert spark.read.parquet(out).filter("cluster = 0 AND t_topic = 1").count() == 1
    write_table(od.select("o_topic", "n"), out + "-csv", fmt="csv")
    assert spark.read.option("header", "true").csv(out + "-csv").count() == 3


def test_day_partitioned_trips_prune(spark):
    import contextlib
    import io

    from tables import SF_SMALL
    from triptopics.sources.fixtures import trips
    root = tempfile.mkdtemp(prefix="tt-days-") + "/trips"
    t = trips(spark, SF_SMALL)
    write_fare_days(t, root)
    got = read_fare_days(spark, root, "2024-01-03", "2024-01-04")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain(mode="formatted")
    assert "PartitionFilters: [isnotnull(day" in buf.getvalue()
    ref = t.filter(F.to_date("ts").between("2024-01-03", "2024-01-04")).count()
    assert got.count() == ref > 0


def test_sql_views(spark):
    from tables import SF_SMALL
    from triptopics.plans.views import register_views
    names = register_views(spark, SF_SMALL)
    assert "trips" in names
    a = spark.sql("SELECT COUNT(*) FROM trips").first()[0]
    b = spark.sql("SELECT SUM(amount) FROM od_flow_hourly").first()[0]
    assert a == b > 0


def test_documents_round_trip(spark):
    path = tempfile.mkdtemp(prefix="tt-docs-") + "/docs"
    docs = passenger_docs(trips(spark, "/root/testdata/sf0.001"), ["ts", "event_id"])
    write_docs(docs, path)
    back = read_docs(spark, path)
    assert back.exceptAll(docs.select(back.columns)).count() == 0 and back.count() == docs.count()
    words = sorted(r.wordcount for r in back.collect())
    assert read_docs(spark, path, words[-1]).count() == words.count(words[-1])


def test_document_posteriors_are_saved(spark):
    path = tempfile.mkdtemp(prefix="tt-theta-") + "/theta"
    m = TopicModel(np.zeros((1, 1)), np.zeros((1, 1)), np.zeros((1, 1)), 5.0, np.array([1]), np.array([0]))
    inferred = spark.createDataFrame([(7, 4.0, [0.25, 0.75])], "user_id long, wordcount double, theta array<double>")
    m.save_docs(inferred, path, "run", 0.1)
    r = spark.read.parquet(path).first()
    assert r.gamma == [6.0, 8.0] and r.run_id == "run" and r.lam == 0.1
