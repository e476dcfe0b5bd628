"""Property tests (Hypothesis): skew-safe chaining/positions equal the plain windows
for arbitrary event sets, including ties in time and travellers spanning many chunks."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from triptopics.sources.fixtures import chained_lead, chained_position

EVENT = st.tuples(st.integers(0, 3), st.integers(0, 72 * 3600), st.integers(0, 9))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=st.lists(EVENT, min_size=1, max_size=60), chunk=st.sampled_from([600, 3600, 86_400, 10 ** 6]))
def test_chained_forms_equal_plain_windows(spark, events, chunk):
    base = dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({"user_id": [e[0] for e in events], "event_id": range(len(events)),
                        "ts": [base + dt.timedelta(seconds=e[1]) for e in events], "k": [e[2] for e in events]})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ref = df.select("event_id", F.lead("k").over(w).alias("nxt"), (F.row_number().over(w) - 1).alias("pos"))
    got_lead = chained_lead(df, "user_id", ["ts", "event_id"], "k", "nxt", "ts", chunk).select("event_id", "nxt")
    got_pos = chained_position(df, "user_id", ["ts", "event_id"], "pos", "ts", chunk).select("event_id", "pos")
    expect = {r["event_id"]: (r["nxt"], r["pos"]) for r in ref.collect()}
    lead = {r["event_id"]: r["nxt"] for r in got_lead.collect()}
    pos = {r["event_id"]: r["pos"] for r in got_pos.collect()}
    assert {k: (lead[k], pos[k]) for k in expect} == expect
