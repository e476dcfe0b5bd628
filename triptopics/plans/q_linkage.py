"""Queries of passenger distances: Jensen-Shannon pairs within a radius and complete linkage (J-07, C-02, C-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metric_join as mj
from ..sources.fixtures import TRIPS_SQL, trips
from .catalog import query, with_views

#: Pairs of passengers further apart than this are not reported; clusters reach no further.
RADIUS = 0.25
HOURS = 24

SHARES_SQL = f"""
SELECT user_id, list(coalesce(n, 0) / total ORDER BY h) AS dist
FROM (SELECT user_id, h, total FROM (SELECT user_id, COUNT(*) AS total FROM trips WHERE user_id IS NOT NULL GROUP BY 1), range({HOURS}) r(h))
LEFT JOIN (SELECT user_id, hour AS h, COUNT(*) AS n FROM trips GROUP BY 1, 2) USING (user_id, h) GROUP BY 1"""


def hour_shares(t: DataFrame) -> DataFrame:
    """user_id, dist: the share of each hour of the day among a passenger's trips, one grouped aggregate."""
    counts = t.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(HOURS)])
    return counts.select("user_id", F.array(*[F.col(f"h{h}") / F.col("total") for h in range(HOURS)]).alias("dist"))


@query("js_pairs", with_views(f"""
SELECT a, b, ROUND(js, 9) AS js FROM (
  SELECT x.user_id AS a, y.user_id AS b, SQRT(GREATEST(list_sum(list_transform(list_zip(x.dist, y.dist), lambda t:
           CASE WHEN t[1] > 0 THEN t[1] * LN(t[1] / ((t[1] + t[2]) / 2)) ELSE 0 END +
           CASE WHEN t[2] > 0 THEN t[2] * LN(t[2] / ((t[1] + t[2]) / 2)) ELSE 0 END)) / 2, 0)) AS js
  FROM heads x JOIN heads y ON x.user_id < y.user_id)
WHERE js <= {RADIUS}""", trips=TRIPS_SQL, shares=SHARES_SQL, heads="SELECT MIN(user_id) AS user_id, dist FROM shares GROUP BY dist"),
    ("J-07", "C-02"))
def q_js_pairs(spark, sf):
    pairs, _ = mj.js_pairs(hour_shares(trips(spark, sf)), "user_id", "dist", RADIUS)
    return pairs.select("a", "b", F.round("js", 9).alias("js"))


@query("js_links", with_views(f"""
SELECT s.user_id, h.user_id AS class, COUNT(y.user_id) AS n_links
FROM shares s JOIN heads h ON s.dist = h.dist LEFT JOIN heads y ON y.user_id <> h.user_id AND
  SQRT(GREATEST(list_sum(list_transform(list_zip(h.dist, y.dist), lambda t:
           CASE WHEN t[1] > 0 THEN t[1] * LN(t[1] / ((t[1] + t[2]) / 2)) ELSE 0 END +
           CASE WHEN t[2] > 0 THEN t[2] * LN(t[2] / ((t[1] + t[2]) / 2)) ELSE 0 END)) / 2, 0)) <= {RADIUS}
GROUP BY 1, 2""", trips=TRIPS_SQL, shares=SHARES_SQL, heads="SELECT MIN(user_id) AS user_id, dist FROM shares GROUP BY dist"),
    ("J-07", "C-02"))
def q_js_links(spark, sf):
    """Every passenger with the class of equal distributions and the number of other classes within the radius."""
    links, members = mj.js_link_counts(hour_shares(trips(spark, sf)), "user_id", "dist", RADIUS)
    return members.join(links, "class", "left").select(F.col("key").alias("user_id"), "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@query("passenger_linkage", None, ("C-03", "J-07"))
def q_passenger_linkage(spark, sf):
    """Complete-linkage clusters of all passengers cut at ``RADIUS``, with their number and the rounds it took."""
    pairs, members = mj.js_pairs(hour_shares(trips(spark, sf)), "user_id", "dist", RADIUS, nearest=mj.NEAREST)
    labels, rounds = mj.complete_linkage(pairs, members, RADIUS)
    n = labels.select("cluster").distinct().count()
    return labels.select(F.col("key").alias("user_id"), "cluster", F.lit(n).cast("long").alias("n_clusters"), F.lit(rounds).alias("rounds"))
