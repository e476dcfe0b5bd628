"""Queries of build steps 1-2: trips, patterns, ranks, flows, tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import DAY_FIRST_FORMAT, hour_bucket, parse_day_first
from ..functions.indexing import stable_hash_sql
from ..operators import flow
from ..operators import trips as tr
from ..session import table
from ..sources.fixtures import TRIPS_OD_SQL, TRIPS_SQL, trips, trips_od
from .catalog import query, with_views

T = {"trips": TRIPS_SQL}
ORDER = ["ts", "event_id"]
COHORT_SIZE = 100
COHORT_SEED = 7
TRAIN_FRACTION = 0.8


def _trips_day(spark, sf):
    return tr.with_day(trips(spark, sf))


def _iso(df, *cols):
    """Dates leave the query as ISO text so every engine prints them alike."""
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return df


@query("trips_clean", with_views("SELECT * FROM trips", **T), ("P-01", "J-chain"))
def q_trips_clean(spark, sf):
    return trips(spark, sf)


@query("parsed_timestamps", """
SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS txn_dt,
       try_strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S') AS parsed,
       CAST(HOUR(try_strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S')) AS INT) AS hour
FROM events""", ("P-02", "P-03"))
def q_parsed_timestamps(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", DAY_FIRST_FORMAT).alias("txn_dt"))
    p = e.withColumn("parsed", parse_day_first("txn_dt"))
    return p.withColumn("hour", F.hour("parsed"))


@query("hour_of_trip", with_views(
    "SELECT event_id, hour, hour + 1 AS hour_x, date_trunc('hour', ts) AS bin_start FROM trips", **T),
    ("P-03", "P-04"))
def q_hour_of_trip(spark, sf):
    t = trips(spark, sf)
    return t.select("event_id", "hour", (F.col("hour") + 1).alias("hour_x"),
                    hour_bucket("ts").alias("bin_start"))


@query("od_flow_hourly", with_views("""
SELECT date_trunc('hour', ts) AS bin_start, origin, dest, COUNT(*) AS amount
FROM trips GROUP BY 1, 2, 3""", **T), ("A-03",))
def q_od_flow_hourly(spark, sf):
    return flow.od_flow_hourly(trips(spark, sf))


@query("trips_per_user", with_views(
    "SELECT user_id, COUNT(*) AS n_trips FROM trips GROUP BY user_id", **T), ("A-01",))
def q_trips_per_user(spark, sf):
    return tr.trips_per_user(trips(spark, sf))


@query("trip_count_histogram", with_views("""
SELECT n_trips, COUNT(*) AS n_users, COUNT(*) / SUM(COUNT(*)) OVER () AS share
FROM (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n_trips FROM trips GROUP BY 1, 2)
GROUP BY n_trips""", **T), ("A-02",))
def q_trip_count_histogram(spark, sf):
    return tr.trip_count_histogram(_trips_day(spark, sf), ["user_id", "day"])


@query("users_with_2_trips", with_views("""
SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS n_trips FROM trips
GROUP BY 1, 2 HAVING COUNT(*) = 2""", **T), ("W-04",))
def q_users_with_2_trips(spark, sf):
    return _iso(tr.users_with_n_trips(_trips_day(spark, sf), 2), "day")


@query("home_work_users", with_views("""
SELECT user_id, day, first_origin, second_dest FROM (
  SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS n,
         arg_min(origin, (ts, event_id)) AS first_origin,
         arg_max(dest, (ts, event_id)) AS second_dest
  FROM trips GROUP BY 1, 2)
WHERE n = 2 AND first_origin = second_dest""", **T), ("W-03", "W-05"))
def q_home_work_users(spark, sf):
    return _iso(tr.home_work_users(_trips_day(spark, sf), ORDER), "day")


@query("first_two_trips", with_views("""
SELECT user_id, day, event_id, origin, dest, trip_no FROM (
  SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_id, origin, dest,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS trip_no
  FROM trips)
WHERE trip_no <= 2""", **T), ("W-03",))
def q_first_two_trips(spark, sf):
    f = tr.first_trips(_trips_day(spark, sf), ORDER)
    f = f.select("user_id", "day", "event_id", "origin", "dest", F.col("trip_no").cast("int"))
    return _iso(f, "day")


@query("station_rank", with_views("""
SELECT role, station, n, CAST(DENSE_RANK() OVER (PARTITION BY role ORDER BY n DESC) AS INT) AS rank FROM (
  SELECT 'origin' AS role, origin AS station, COUNT(*) AS n FROM trips GROUP BY 2
  UNION ALL
  SELECT 'dest' AS role, dest AS station, COUNT(*) AS n FROM trips GROUP BY 2)""", **T), ("W-01", "J-02"))
def q_station_rank(spark, sf):
    t = trips(spark, sf)
    o = tr.station_rank(t, "origin").withColumn("role", F.lit("origin"))
    d = tr.station_rank(t, "dest").withColumn("role", F.lit("dest"))
    return o.unionByName(d).select("role", "station", "n", F.col("rank").cast("int"))


@query("ranked_trips", with_views("""
SELECT t.event_id, CAST(u.id_re AS BIGINT) AS id_re, t.hour + 1 AS hour_x,
       CAST(rx.r AS INT) AS xy_rankx, CAST(ry.r AS INT) AS xy_ranky
FROM trips t
JOIN (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS c FROM trips GROUP BY 1, 2) c
  ON t.user_id = c.user_id AND CAST(t.ts AS DATE) = c.day
JOIN (SELECT origin, DENSE_RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM trips GROUP BY origin) rx
  ON t.origin = rx.origin
JOIN (SELECT dest, DENSE_RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM trips GROUP BY dest) ry
  ON t.dest = ry.dest
JOIN (SELECT user_id, DENSE_RANK() OVER (ORDER BY user_id DESC) AS id_re FROM (
        SELECT DISTINCT t2.user_id FROM trips t2 JOIN
          (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS c FROM trips GROUP BY 1, 2) c2
          ON t2.user_id = c2.user_id AND CAST(t2.ts AS DATE) = c2.day
        WHERE c2.c BETWEEN 2 AND 6)) u
  ON t.user_id = u.user_id
WHERE c.c BETWEEN 2 AND 6""", **T), ("S-06", "W-01", "W-02", "J-02", "P-08"))
def q_ranked_trips(spark, sf):
    r = tr.ranked_trips(_trips_day(spark, sf))
    return r.select("event_id", F.col("id_re").cast("bigint"), "hour_x",
                    F.col("xy_rankx").cast("int"), F.col("xy_ranky").cast("int"))


@query("user_reindex", with_views("""
SELECT user_id, CAST(DENSE_RANK() OVER (ORDER BY user_id DESC) AS BIGINT) AS id_re
FROM (SELECT DISTINCT user_id FROM trips)""", **T), ("W-02",))
def q_user_reindex(spark, sf):
    return tr.user_reindex(trips(spark, sf)).select("user_id", F.col("id_re").cast("bigint"))


@query("frequent_users", with_views("""
SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS n_trips FROM trips
GROUP BY 1, 2 HAVING COUNT(*) >= 4""", **T), ("P-08",))
def q_frequent_users(spark, sf):
    f = tr.trips_per_user(_trips_day(spark, sf), ["user_id", "day"]).filter(F.col("n_trips") >= 4)
    return _iso(f, "day")


@query("station_universe", with_views("""
SELECT origin AS station FROM trips UNION SELECT dest FROM trips""", **T), ("U-02",))
def q_station_universe(spark, sf):
    return tr.station_universe(trips(spark, sf))


@query("station_intersection", with_views("""
SELECT origin AS station FROM trips INTERSECT SELECT dest FROM trips""", **T), ("U-03",))
def q_station_intersection(spark, sf):
    return tr.station_intersection(trips(spark, sf))


COHORT_SQL = f"""SELECT user_id FROM (SELECT DISTINCT user_id FROM trips)
ORDER BY {stable_hash_sql('user_id', COHORT_SEED)}, user_id LIMIT {COHORT_SIZE}"""


@query("cohort_trips", with_views(
    "SELECT * FROM trips WHERE user_id IN (SELECT user_id FROM cohort)", **T, cohort=COHORT_SQL),
    ("P-09", "P-14", "J-01", "U-01"))
def q_cohort_trips(spark, sf):
    t = trips(spark, sf)
    return tr.cohort_trips(t, tr.cohort(t, COHORT_SIZE, COHORT_SEED), COHORT_SIZE)


@query("train_test_split", with_views("""
SELECT user_id, CASE WHEN ROW_NUMBER() OVER (ORDER BY user_id) <= FLOOR(0.8 * COUNT(*) OVER ())
            THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT user_id FROM trips)""", **T), ("U-04", "P-14"))
def q_train_test_split(spark, sf):
    users = trips(spark, sf).select("user_id").distinct()
    n_train = int(users.count() * TRAIN_FRACTION)
    return tr.train_test_split(users, n_train)


# ---- step 2: flows and tensors ---------------------------------------------
SBIN = "CAST(((HOUR(ts) - 5) % 24 + 24) % 24 AS INT)"


@query("od_flow_rebinned_7h", with_views(f"""
SELECT strftime(CAST(ts - INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') AS sday, origin, dest, CAST({SBIN} // 7 AS INT) AS bin,
       COUNT(*) AS amount
FROM trips WHERE {SBIN} < 21 GROUP BY 1, 2, 3, 4""", **T), ("A-04",))
def q_od_flow_rebinned(spark, sf):
    return _iso(flow.od_flow_rebinned(trips(spark, sf), 7), "sday")


@query("od_flow_rebinned_7h_filled", with_views(f"""
SELECT strftime(g.sday, '%Y-%m-%d') AS sday, g.origin, g.dest, g.bin, COALESCE(f.amount, 0) AS amount
FROM (SELECT origin, dest, CAST(sday AS DATE) AS sday, CAST(bin AS INT) AS bin
      FROM (SELECT DISTINCT origin, dest FROM flow) p,
           (SELECT UNNEST(GENERATE_SERIES(MIN(sday), MAX(sday), INTERVAL 1 DAY)) AS sday FROM flow) d,
           (SELECT UNNEST([0, 1, 2]) AS bin) b) g
LEFT JOIN flow f ON f.sday = g.sday AND f.origin = g.origin AND f.dest = g.dest AND f.bin = g.bin""", **T, flow=f"""
SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS sday, origin, dest, CAST({SBIN} // 7 AS INT) AS bin, COUNT(*) AS amount
FROM trips WHERE {SBIN} < 21 GROUP BY 1, 2, 3, 4"""), ("A-04",))
def q_od_flow_rebinned_filled(spark, sf):
    return _iso(flow.od_flow_rebinned(trips(spark, sf), 7, zero_fill=True), "sday")


@query("od_tensor_coo", with_views(f"""
SELECT origin, dest, {SBIN} AS bin, COUNT(*) AS value
FROM trips WHERE {SBIN} < 21 GROUP BY 1, 2, 3""", **T), ("A-05",))
def q_od_tensor(spark, sf):
    return flow.od_tensor(trips(spark, sf), 1)


@query("od_day_hour_tensor", with_views(f"""
SELECT origin, dest, strftime(CAST(ts - INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') AS sday, {SBIN} AS bin, COUNT(*) AS value
FROM trips WHERE {SBIN} < 21 GROUP BY 1, 2, 3, 4""", **T), ("A-06",))
def q_od_day_tensor(spark, sf):
    return _iso(flow.od_day_tensor(trips(spark, sf), 1), "sday")


@query("user_od_tensor", with_views(f"""
SELECT user_id, origin, dest, CAST({SBIN} // 7 AS INT) AS bin, COUNT(*) AS value
FROM trips WHERE {SBIN} < 21 GROUP BY 1, 2, 3, 4""", **T), ("A-07",))
def q_user_od_tensor(spark, sf):
    return flow.user_od_tensor(trips(spark, sf), 7)


@query("tensor_sparsity", with_views(f"""
SELECT c.nnz, s.n_stations, 1.0 - c.nnz / (s.n_stations * s.n_stations * 21) AS sparsity
FROM (SELECT COUNT(*) AS nnz FROM (SELECT DISTINCT origin, dest, {SBIN} FROM trips WHERE {SBIN} < 21)) c,
     (SELECT COUNT(*) AS n_stations FROM (SELECT origin FROM trips UNION SELECT dest FROM trips)) s""", **T),
    ("A-08",))
def q_tensor_sparsity(spark, sf):
    t = trips(spark, sf)
    return flow.tensor_sparsity(flow.od_tensor(t, 1), t, 21)


@query("observed_cells", with_views(f"""
SELECT DISTINCT origin, dest, {SBIN} AS bin FROM trips WHERE {SBIN} < 21""", **T), ("A-09",))
def q_observed_cells(spark, sf):
    return flow.observed_mask(flow.od_tensor(trips(spark, sf), 1), ["origin", "dest", "bin"])


@query("od_matrix", with_views(
    "SELECT origin, dest, COUNT(*) AS n FROM trips GROUP BY 1, 2", **T), ("A-16",))
def q_od_matrix(spark, sf):
    return flow.od_matrix(trips(spark, sf))


@query("top_od_pairs", with_views("""
SELECT * FROM (SELECT origin, dest, COUNT(*) AS n FROM trips GROUP BY 1, 2
               ORDER BY n DESC, origin, dest LIMIT 10) ORDER BY origin, dest""", **T), ("W-08",))
def q_top_od_pairs(spark, sf):
    return flow.top_od_pairs(trips(spark, sf), 10)


@query("od_flow_lineitem", with_views("""
SELECT date_trunc('hour', ts) AS bin_start, origin, dest, COUNT(*) AS amount
FROM trips_od GROUP BY 1, 2, 3""", trips_od=TRIPS_OD_SQL), ("A-03", "J-fixture"))
def q_od_flow_lineitem(spark, sf):
    return flow.od_flow_hourly(trips_od(spark, sf))
