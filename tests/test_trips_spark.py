"""Skew-safe operators equal their textbook forms; repartition invariance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tables import SF_SMALL
from triptopics.functions.indexing import dense_index
from triptopics.operators import flow
from triptopics.session import table
from triptopics.sources.fixtures import event_stations, trips_from_events


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_chained_lead_equals_plain_window(spark):
    ev = table(spark, SF_SMALL, "events")
    e = event_stations(ev)
    plain = (e.withColumn("dest", F.lead("origin").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
             .filter(F.col("dest").isNotNull()).select("event_id", "origin", "dest"))
    for chunk in (3600, 86_400, 10 ** 7):                 # many small chunks ... one chunk
        ours = trips_from_events(ev, chunk).select("event_id", "origin", "dest")
        assert _rows(ours) == _rows(plain)


def test_dense_index_equals_row_number(spark):
    df = table(spark, SF_SMALL, "events").select("user_id").distinct()
    ours = dense_index(df, [F.desc("user_id")], "i")
    ref = df.withColumn("i", F.row_number().over(Window.orderBy(F.desc("user_id"))) - 1)
    assert _rows(ours.select("user_id", "i")) == _rows(ref.select("user_id", "i"))


def test_flow_repartition_invariance(spark):
    t = trips_from_events(table(spark, SF_SMALL, "events"))
    one = flow.od_flow_rebinned(t.repartition(1), 7)
    many = flow.od_flow_rebinned(t.repartition(8, "origin"), 7)
    assert _rows(one) == _rows(many)
    assert t.count() == flow.od_tensor(t, 24).agg(F.sum("value")).first()[0] + \
        t.filter(F.pmod(F.hour("ts") - 5, F.lit(24)) >= 21).count()


def test_chained_position_equals_row_number(spark):
    from triptopics.sources.fixtures import chained_position
    e = event_stations(table(spark, SF_SMALL, "events"))
    ref = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    for chunk in (3600, 86_400, 10 ** 7):
        ours = chained_position(e, "user_id", ["ts", "event_id"], "pos", "ts", chunk)
        assert _rows(ours.select("event_id", "pos")) == _rows(ref.select("event_id", "pos"))


def test_hot_traveller_is_spread_and_exact(spark):
    """One traveller owning about a third of all events: same trips as the plain
    window, and that traveller's rows are processed by several tasks."""
    ev = table(spark, SF_SMALL, "events")
    users = sorted(r[0] for r in ev.select("user_id").distinct().collect())
    hot = users[: max(1, len(users) // 3)]
    skewed = ev.withColumn("user_id", F.when(F.col("user_id").isin(hot), F.lit(10 ** 9)).otherwise(F.col("user_id")))
    share = skewed.filter(F.col("user_id") == 10 ** 9).count() / skewed.count()
    assert share > 0.25
    e = event_stations(skewed)
    plain = (e.withColumn("dest", F.lead("origin").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
             .filter(F.col("dest").isNotNull()).select("event_id", "origin", "dest"))
    ours = trips_from_events(skewed)
    assert _rows(ours.select("event_id", "origin", "dest")) == _rows(plain)
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = (ours.filter(F.col("user_id") == 10 ** 9).select(F.spark_partition_id().alias("p"))
                 .distinct().count())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    assert tasks >= 3
