"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROWS_A_TASK = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (smallest reachable id) for every id of ``edges`` (a, b; long, undirected).

    Each round hangs every larger neighbour on the smallest one known (large star), then every
    smaller neighbour (small star); rounds grow with the logarithm of a component's size.  A star's
    centre meets its neighbours in a join that Spark may split, never in one group, and each round
    is a written table."""
    tasks = 1 + 2 * edges.count() // ROWS_A_TASK        # rounds never have more rows than twice the edges

    def kept(df: DataFrame) -> DataFrame:
        return written(df.coalesce(tasks), "cc")

    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = kept(_small_star(kept(_large_star(now))))
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    member = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return kept(member.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
