"""Trip tables derived from the driver's parquet tables.

``events`` becomes chained trips: a traveller's consecutive events (by
``ts, event_id``) form one trip whose origin is the station ``k`` of the
first event and whose destination is the ``k`` of the next one.

The chaining is a LEAD over each traveller's timeline.  A plain
``lead() OVER (PARTITION BY user_id ...)`` would put a traveller who owns
a third of all events into one task, so the timeline is cut into
(user, time-chunk) windows first; only the last event of each chunk
needs the first event of the traveller's next non-empty chunk, which is
looked up in a one-row-per-chunk summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import table

# Length of one timeline chunk used to split hot travellers (seconds).
CHUNK_SECONDS = 86_400

TRIP_COLUMNS = ["user_id", "event_id", "ts", "txn_type", "origin", "dest", "hour"]


def chained_lead(df: DataFrame, key: str, order: list[str], value: str, out: str,
                 ts_col: str, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``lead(value) over (partition by key order by order...)`` that stays
    parallel when one key holds a large share of the rows."""
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    chunk = F.floor(micros / F.lit(chunk_seconds * 1_000_000)).alias("_chunk")
    base = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    val = F.struct(F.col(value).alias("v"))
    inner = base.withColumn("_nxt", F.lead(val, 1).over(w)).withColumn("_rn", F.row_number().over(w))
    # first event of every (key, chunk) comes out of the same window (no second scan),
    # then each chunk learns the first event of the key's next non-empty chunk
    first = inner.filter(F.col("_rn") == 1).select(key, "_chunk", val.alias("_first"))
    follow = first.withColumn(
        "_follow", F.lead("_first", 1).over(Window.partitionBy(key).orderBy("_chunk"))
    ).select(key, "_chunk", "_follow")
    joined = inner.join(follow, [key, "_chunk"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_nxt"), F.col("_follow")).getField("v")).drop(
        "_chunk", "_nxt", "_follow", "_rn")


def chained_position(df: DataFrame, key: str, order: list[str], out: str, ts_col: str,
                     chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """0-based position of each row in its key's ``order`` without a per-key window:
    row number inside the (key, time-chunk) window plus the number of the key's
    rows in earlier chunks (a prefix sum over one row per chunk)."""
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    base = df.withColumn("_chunk", F.floor(micros / F.lit(chunk_seconds * 1_000_000)))
    inner = base.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order)))
    sizes = base.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (inner.join(before.select(key, "_chunk", "_before"), [key, "_chunk"])
            .withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_chunk", "_rn", "_before"))


def event_stations(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id", "event_id", "ts", F.col("event_type").alias("txn_type"),
        F.get_json_object("props", "$.k").cast("int").alias("origin"))


def trips_from_events(events: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """All chained trips (no type filter yet) with ``hour``."""
    e = event_stations(events)
    chained = chained_lead(e, "user_id", ["ts", "event_id"], "origin", "dest", "ts", chunk_seconds)
    has_next = chained.filter(F.col("dest").isNotNull())
    return has_next.withColumn("hour", F.hour("ts")).select(*TRIP_COLUMNS)


def used_trips(trips: DataFrame) -> DataFrame:
    """Type filter applied after chaining: every type but ``error`` counts as used."""
    return trips.filter(F.col("txn_type") != "error")


def trips(spark, sf_dir: str, used: bool = True) -> DataFrame:
    t = trips_from_events(table(spark, sf_dir, "events"))
    return used_trips(t) if used else t


def trips_od(spark, sf_dir: str) -> DataFrame:
    """Second fixture: every finished line item is a trip of its customer.

    lineitem joins orders on the order key (both large: shuffle join that
    AQE may re-plan) and supplier (a dimension; Catalyst broadcasts it only
    when its statistics are under the broadcast threshold).
    """
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    ts = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_partkey") % 24).cast("int"))
    return j.select(
        F.col("o_custkey").alias("user_id"), "l_orderkey", "l_linenumber",
        ts.alias("ts"), F.col("l_returnflag").alias("txn_type"),
        F.col("s_nationkey").cast("int").alias("origin"),
        (F.col("l_partkey") % 25).cast("int").alias("dest"),
    ).withColumn("hour", F.hour("ts"))


# ---------------------------------------------------------------------------
# Oracle SQL for the same views (DuckDB dialect), shared by plans/oracle.py
TRIPS_ALL_SQL = """
WITH e AS (
  SELECT user_id, event_id, ts, event_type,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)
SELECT * FROM (
  SELECT user_id, event_id, ts, event_type AS txn_type, k AS origin,
         LEAD(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dest,
         CAST(HOUR(ts) AS INT) AS hour
  FROM e)
WHERE dest IS NOT NULL
"""

TRIPS_SQL = f"SELECT * FROM ({TRIPS_ALL_SQL}) WHERE txn_type <> 'error'"

TRIPS_OD_SQL = """
SELECT o.o_custkey AS user_id, l.l_orderkey, l.l_linenumber,
       l.l_shipdate + to_hours(CAST(l.l_partkey % 24 AS INT)) AS ts,
       l.l_returnflag AS txn_type, CAST(s.s_nationkey AS INT) AS origin,
       CAST(l.l_partkey % 25 AS INT) AS dest,
       CAST(HOUR(l.l_shipdate + to_hours(CAST(l.l_partkey % 24 AS INT))) AS INT) AS hour
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE l.l_linestatus = 'F'
"""
