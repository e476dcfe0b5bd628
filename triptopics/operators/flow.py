"""Flows and sparse OD tensors (A-03 ... A-09, A-16, W-08).

Tensors are COO long tables ``(origin, dest, [day,] bin, value)``; zero
cells are implicit (the reference's dense arrays are mostly zeros and
grow as stations² × bins × days).  All operators are one hash aggregate
with map-side partial aggregation, so the shuffle carries at most one row
per (partition, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hour_bucket
from .trips import station_universe

# Service calendar of the reference (fixed values): each service day starts at
# 05:00 and the hourly calendar runs 21 hours, to 01:00 the next day.
SERVICE_START_HOUR = 5
SERVICE_HOURS = 21


def service_offset(ts: str | Column, start_hour: int = SERVICE_START_HOUR) -> Column:
    """Hours since the start of the service day (0..23)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.pmod(F.hour(c) - F.lit(start_hour), F.lit(24))


def service_day(ts: str | Column, start_hour: int = SERVICE_START_HOUR) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c - F.make_dt_interval(F.lit(0), F.lit(start_hour)))


def with_service_bin(trips: DataFrame, bin_hours: int, start_hour: int = SERVICE_START_HOUR,
                     service_hours: int = SERVICE_HOURS) -> DataFrame:
    """Bin anchored at the service-day start (Q20): bin = offset // bin_hours.

    Hours outside the service calendar (02:00-04:59 by default) have no bin
    and are dropped, as the reference's re-indexing drops them.
    """
    off = service_offset("ts", start_hour)
    return (trips.withColumn("_off", off).filter(F.col("_off") < service_hours)
            .withColumn("bin", F.floor(F.col("_off") / bin_hours).cast("int"))
            .withColumn("sday", service_day("ts", start_hour)).drop("_off"))


def od_flow_hourly(trips: DataFrame) -> DataFrame:
    """A-03: trips per (hour, origin, destination)."""
    return (trips.groupBy(hour_bucket("ts").alias("bin_start"), "origin", "dest")
            .agg(F.count(F.lit(1)).alias("amount")))


def od_flow_rebinned(trips: DataFrame, bin_hours: int = 7, zero_fill: bool = False) -> DataFrame:
    """A-04: flow per (service day, origin, destination, n-hour bin from 05:00).

    ``zero_fill`` adds the calendar's missing cells with amount 0 for every
    OD pair that occurs: all bins of all days between the first and the last
    service day of the data.  Pairs, days and bins are unfolded per pair, no
    pair of stations is made up."""
    b = with_service_bin(trips, bin_hours)
    seen = b.groupBy("sday", "origin", "dest", "bin").agg(F.count(F.lit(1)).alias("amount"))
    if not zero_fill:
        return seen
    first, last = b.agg(F.min("sday"), F.max("sday")).first()
    if first is None:
        return seen
    days = F.sequence(F.lit(first), F.lit(last))
    bins = F.sequence(F.lit(0), F.lit((SERVICE_HOURS - 1) // bin_hours))
    zeros = (seen.select("origin", "dest").distinct().withColumn("sday", F.explode(days))
             .select("sday", "origin", "dest", F.explode(bins).alias("bin"), F.lit(0).cast("bigint").alias("amount")))
    return seen.union(zeros).groupBy("sday", "origin", "dest", "bin").agg(F.sum("amount").alias("amount"))


def od_tensor(trips: DataFrame, bin_hours: int = 1) -> DataFrame:
    """A-05: O × D × T tensor over all service days, COO."""
    b = with_service_bin(trips, bin_hours)
    return b.groupBy("origin", "dest", "bin").agg(F.count(F.lit(1)).alias("value"))


def od_day_tensor(trips: DataFrame, bin_hours: int = 1) -> DataFrame:
    """A-06: O × D × day × T tensor, COO."""
    b = with_service_bin(trips, bin_hours)
    return b.groupBy("origin", "dest", "sday", "bin").agg(F.count(F.lit(1)).alias("value"))


def user_od_tensor(trips: DataFrame, bin_hours: int = 7) -> DataFrame:
    """A-07: user × O × D × T tensor (7-hour bins by default), COO."""
    b = with_service_bin(trips, bin_hours)
    return b.groupBy("user_id", "origin", "dest", "bin").agg(F.count(F.lit(1)).alias("value"))


def tensor_sparsity(coo: DataFrame, trips: DataFrame, n_bins: int) -> DataFrame:
    """A-08: 1 - non-zero cells / (stations × stations × bins).

    The station axis is the universe of origins ∪ destinations (U-02).
    """
    cells = coo.filter(F.col("value") > 0).select(
        F.lit(1).cast("bigint").alias("is_cell"), F.lit(None).cast("int").alias("station"))
    stations = station_universe(trips).select(
        F.lit(0).cast("bigint").alias("is_cell"), F.col("station").cast("int"))
    both = cells.unionByName(stations).agg(
        F.sum("is_cell").alias("nnz"), F.count("station").alias("n_stations"))
    return both.select(
        "nnz", "n_stations",
        (F.lit(1.0) - F.col("nnz") / (F.col("n_stations") * F.col("n_stations") * F.lit(n_bins)))
        .alias("sparsity"))


def observed_mask(coo: DataFrame, keys: list[str]) -> DataFrame:
    """A-09: the observation mask is the COO support (cells with value > 0)."""
    return coo.filter(F.col("value") > 0).select(*keys)


def od_matrix(trips: DataFrame) -> DataFrame:
    """A-16: trips per (origin, destination) over all travellers."""
    return trips.groupBy("origin", "dest").agg(F.count(F.lit(1)).alias("n"))


def top_od_pairs(trips: DataFrame, n: int = 10) -> DataFrame:
    """W-08: the ``n`` busiest OD cells (ties by origin, dest), listed by origin.

    ``orderBy(...).limit(n)`` plans a TakeOrderedAndProject: each task keeps
    its own top n and only those reach the final merge.
    """
    m = od_matrix(trips)
    top = m.orderBy(F.desc("n"), "origin", "dest").limit(n)
    return top.orderBy("origin", "dest")
