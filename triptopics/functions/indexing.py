"""Distribution-safe helpers: dense indexes, size-checked broadcasts, deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

# Default ceiling for a broadcast side, in rows. Dimension tables of the
# trip domain (stations, hours, topics, cohorts) stay far below it.
BROADCAST_MAX_ROWS = 2_000_000

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1


def guarded_broadcast(df: DataFrame, bound: int | None = None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint for a side of a checked size; a larger side is returned as
    it is and joins by shuffle.

    ``bound`` is a row count known by construction (a ``limit``, a cohort
    size, ``keep_n``...).  Without one the side (a station, hour or topic
    table) is written to the checkpoint folder once and counted there, so
    the fact side never has to be shuffled on a few hot keys before the
    size of the other side is known, and the side is not computed twice.
    """
    if bound is None:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint()
        bound = df.count()
    return F.broadcast(df) if bound <= max_rows else df


def dense_index(df: DataFrame, order: list[Column], name: str = "idx", start: int = 0) -> DataFrame:
    """Attach a dense 0-based (or ``start``-based) position in ``order``.

    A global ``row_number()`` runs in one task; instead the rows are range
    partitioned and sorted, written to the shared checkpoint folder (so a
    lost executor cannot re-sample different range bounds), and each row's
    position is its partition offset plus its place inside the partition.
    Only one count per partition reaches the offset table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = shuffle_partitions(spark)
    ranked = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    with_id = ranked.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright(F.col("_mid"), _POS_BITS))
    offsets = (with_id.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(
                   Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .select("_pid", "_off"))
    return (with_id.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_POS_MASK)) + F.lit(start))
            .drop("_pid", "_off", "_mid"))


def stable_hash(col: str | Column, seed: int = 0) -> Column:
    """A small arithmetic hash in [0, 2^31-1) that SQL engines reproduce exactly.

    ``pmod((x mod 2147483647) * 48271 + seed, 2147483647)`` (Lehmer step);
    used for deterministic cohort sampling and mini-batch assignment.
    """
    c = F.col(col) if isinstance(col, str) else col
    m = F.lit(2147483647).cast("bigint")
    return F.pmod(F.pmod(c.cast("bigint"), m) * F.lit(48271).cast("bigint") + F.lit(seed).cast("bigint"), m)


def stable_hash_sql(col: str, seed: int = 0) -> str:
    return f"(((({col} % 2147483647) + 2147483647) % 2147483647) * 48271 + {seed}) % 2147483647"
