"""Trip-level operators: per-user counts, patterns, ranks, cohorts, splits.

Every operator takes a ``trips`` DataFrame with at least
``user_id, ts, origin, dest, hour`` (plus a tie-break column such as
``event_id``) and returns a DataFrame.  Group statistics are computed
with ``groupBy`` (partial aggregation before the shuffle) and joined back
rather than with unbounded per-user windows, so a traveller owning a
large share of the rows never lands in a single task; AQE splits skewed
join partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indexing import dense_index, guarded_broadcast, stable_hash
from ..session import ensure_checkpoint_dir


def with_day(trips: DataFrame) -> DataFrame:
    return trips.withColumn("day", F.to_date("ts"))


def trips_per_user(trips: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A-01: number of trips of each user (or of each ``by`` group)."""
    keys = by or ["user_id"]
    return trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trips"))


def trip_count_histogram(trips: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A-02: how many users made n trips, and their share of all users."""
    per_user = trips_per_user(trips, by)
    hist = per_user.groupBy("n_trips").agg(F.count(F.lit(1)).alias("n_users"))
    # the histogram has one row per distinct count: a global window over it is tiny
    return hist.withColumn("share", F.col("n_users") / F.sum("n_users").over(Window.partitionBy()))


def users_with_n_trips(trips: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """W-04: users (per ``by`` group, default per day) with exactly ``n`` trips."""
    keys = by or ["user_id", "day"]
    return trips_per_user(trips, keys).filter(F.col("n_trips") == n)


def home_work_users(trips: DataFrame, order: list[str], strict: bool = False,
                    by: list[str] | None = None) -> DataFrame:
    """W-05: exactly two trips and the first origin equals the second destination.

    One aggregate per (user, day): count, first origin and last destination
    (``min_by``/``max_by`` on the time order), so no group is ever
    materialised.  ``strict`` also asks first destination = second origin.
    """
    keys = by or ["user_id", "day"]
    o = F.struct(*[F.col(c) for c in order])
    agg = trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trips"),
        F.min_by("origin", o).alias("first_origin"),
        F.min_by("dest", o).alias("first_dest"),
        F.max_by("origin", o).alias("second_origin"),
        F.max_by("dest", o).alias("second_dest"),
    )
    cond = (F.col("n_trips") == 2) & (F.col("first_origin") == F.col("second_dest"))
    if strict:
        cond = cond & (F.col("first_dest") == F.col("second_origin"))
    return agg.filter(cond).select(*keys, "first_origin", "second_dest")


def station_counts(trips: DataFrame, col: str) -> DataFrame:
    return trips.groupBy(F.col(col).alias("station")).agg(F.count(F.lit(1)).alias("n"))


def station_rank(trips: DataFrame, col: str) -> DataFrame:
    """W-01: popularity rank of stations, equally busy stations share a rank.

    The station table has one row per station (bounded by the network), so
    the ranking window over it is small.
    """
    counts = station_counts(trips, col)
    return counts.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("n"))))


def ranked_trips(trips: DataFrame, min_trips: int = 2, max_trips: int = 6,
                 by: list[str] | None = None) -> DataFrame:
    """Feeder of the ranked-trip sink (S-06): trips of users with ``min..max``
    trips in their group, hour shifted to 1-based, stations replaced by
    popularity rank (J-02, W-01) and users re-indexed densely by descending
    id (W-02)."""
    keys = by or ["user_id", "day"]
    ensure_checkpoint_dir(trips.sparkSession)
    trips = trips.checkpoint()                  # ranks, counts and index read it: the trips are chained once
    rx = guarded_broadcast(station_rank(trips, "origin").select(
        F.col("station").alias("origin"), F.col("rank").alias("xy_rankx")))
    ry = guarded_broadcast(station_rank(trips, "dest").select(
        F.col("station").alias("dest"), F.col("rank").alias("xy_ranky")))
    counts = trips_per_user(trips, keys).withColumnRenamed("n_trips", "id_count")
    kept = (trips.join(counts, keys)
            .filter(F.col("id_count").between(min_trips, max_trips)))
    users = dense_index(kept.select("user_id").distinct(), [F.desc("user_id")], "id_re", start=1)
    return (kept.join(rx, "origin").join(ry, "dest").join(users, "user_id")
            .withColumn("hour_x", F.col("hour") + 1))


def user_reindex(trips: DataFrame) -> DataFrame:
    """W-02: dense 1-based index of users by descending id (no single-task window)."""
    return dense_index(trips.select("user_id").distinct(), [F.desc("user_id")], "id_re", start=1)


def station_universe(trips: DataFrame) -> DataFrame:
    """U-02: stations seen as origin or destination."""
    return (trips.select(F.col("origin").alias("station"))
            .union(trips.select(F.col("dest").alias("station"))).distinct())


def station_intersection(trips: DataFrame) -> DataFrame:
    """U-03: stations seen both as origin and as destination."""
    return (trips.select(F.col("origin").alias("station"))
            .intersect(trips.select(F.col("dest").alias("station"))))


def cohort(trips: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """P-14: deterministic sample of ``size`` users: smallest stable hash, ties by id.

    A sample is a bounded top-k by definition, so Spark plans it as a
    TakeOrderedAndProject of ``size`` rows.
    """
    users = trips.select("user_id").distinct().withColumn("h", stable_hash("user_id", seed))
    return users.orderBy("h", "user_id").limit(size).select("user_id")


def cohort_trips(trips: DataFrame, cohort_users: DataFrame, size: int | None = None) -> DataFrame:
    """J-01: trips of the cohort (left-semi join; broadcast when the cohort size is bounded)."""
    return trips.join(guarded_broadcast(cohort_users, size), "user_id", "left_semi")


def train_test_split(users: DataFrame, train_size: int, order: list[Column] | None = None) -> DataFrame:
    """U-04: the first ``train_size`` users in ``order`` are ``train``, the rest ``test``."""
    idx = dense_index(users, order or [F.col("user_id")], "_pos")
    return idx.withColumn("split", F.when(F.col("_pos") < train_size, "train").otherwise("test")).drop("_pos")


def first_trips(trips: DataFrame, order: list[str], by: list[str] | None = None, n: int = 2) -> DataFrame:
    """W-03: the first ``n`` trips of each group in time order.

    A per-group top-n: Spark plans ``row_number() <= n`` as a group limit
    applied map-side before the shuffle, so each task ships at most ``n``
    rows per group even when one traveller owns most of a day's trips.
    """
    keys = by or ["user_id", "day"]
    w = Window.partitionBy(*keys).orderBy(*order)
    return trips.withColumn("trip_no", F.row_number().over(w)).filter(F.col("trip_no") <= n)
