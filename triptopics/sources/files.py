"""File sources and sinks of the trip domain (S-01 ... S-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_day_first

# Columns of a daily fare-transaction CSV (fixed values of the input format).
FARE_SCHEMA = T.StructType([
    T.StructField("CSC_PHY_ID", T.LongType()),
    T.StructField("TXN_DT", T.StringType()),
    T.StructField("TXN_TYPE_CO", T.StringType()),
    T.StructField("TXN_SUBTYPE_CO", T.StringType()),
    T.StructField("TRAIN_ENTRY_STN", T.IntegerType()),
    T.StructField("TXN_LOC", T.IntegerType()),
])


def read_fare_csv(spark: SparkSession, path_glob: str, used_type: str = "USE",
                  day_pattern: str = r"(\d{8})\.csv$") -> DataFrame:
    """Daily fare CSVs -> trips (S-01, S-02, P-01, P-02).

    Explicit schema (no inference pass), type filter then drop, day-first
    timestamp parse with impossible dates -> NULL (rows kept out, Q2), and
    the file day taken from the file name so a day folder layout prunes.
    """
    parsed = _used_rows(spark, path_glob, used_type, day_pattern).filter(F.col("ts").isNotNull())
    return parsed.select(
        F.col("CSC_PHY_ID").alias("user_id"), "ts", F.col("TXN_SUBTYPE_CO").alias("txn_type"),
        F.col("TRAIN_ENTRY_STN").alias("origin"), F.col("TXN_LOC").alias("dest"),
        F.hour("ts").alias("hour"), "file_day")


def _used_rows(spark: SparkSession, path_glob: str, used_type: str, day_pattern: str) -> DataFrame:
    raw = (spark.read.schema(FARE_SCHEMA).option("header", "true").csv(path_glob)
           .withColumn("file_day", F.to_date(
               F.regexp_extract(F.col("_metadata.file_path"), day_pattern, 1), "yyyyMMdd")))
    used = raw.filter(F.col("TXN_TYPE_CO") == used_type).drop("TXN_TYPE_CO")
    return used.withColumn("ts", parse_day_first("TXN_DT"))


def bad_timestamps(spark: SparkSession, path_glob: str, used_type: str = "USE",
                   day_pattern: str = r"(\d{8})\.csv$") -> DataFrame:
    """Rows per file day, and how many of them ``read_fare_csv`` leaves out for a bad timestamp (Q2)."""
    return _used_rows(spark, path_glob, used_type, day_pattern).groupBy("file_day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts").isNull()).alias("dropped"))


DOCS_SCHEMA = ("user_id long, chunk int, o array<string>, d array<string>, t array<string>, chunk_words int, "
               "subtype string, wordcount long")


def write_docs(docs: DataFrame, path: str) -> None:
    """Passenger documents (``operators.docs.passenger_docs``) as a table (S-03)."""
    fields = [c.split()[0] for c in DOCS_SCHEMA.split(", ")]
    docs.select(*fields).write.mode("overwrite").parquet(path)


def read_docs(spark: SparkSession, path: str, min_words: int = 0) -> DataFrame:
    """Stored passenger documents (S-03); ``min_words`` reaches the scan as a filter (P-08)."""
    df = spark.read.schema(DOCS_SCHEMA).parquet(path)
    return df.filter(F.col("wordcount") >= min_words) if min_words else df


def write_fare_days(trips: DataFrame, root: str) -> None:
    """Trips laid out one folder per service day (``day=YYYY-MM-DD``), parquet."""
    trips.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(root)


def read_fare_days(spark: SparkSession, root: str, first_day: str | None = None,
                   last_day: str | None = None) -> DataFrame:
    """S-02 with partition pruning: only the folders of the requested days are
    listed and read (the day filter becomes a ``PartitionFilters`` entry)."""
    df = spark.read.parquet(root)
    if first_day is not None:
        df = df.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        df = df.filter(F.col("day") <= F.lit(last_day).cast("date"))
    return df


def read_poi(spark: SparkSession, path: str, station_col: str, category_cols: list[str]) -> DataFrame:
    """POI CSV/parquet with one column per category -> long ``poi(station, category, value)`` (S-04)."""
    reader = spark.read.parquet(path) if path.endswith(".parquet") else (
        spark.read.option("header", "true").option("inferSchema", "false").csv(path))
    wide = reader.select(F.col(station_col).cast("int").alias("station"),
                         *[F.col(c).cast("double").alias(c) for c in category_cols])
    return wide.unpivot("station", category_cols, "category", "value")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet", sort_within: list[str] | None = None) -> None:
    """Sinks S-06/S-07/S-08: one table, optionally partitioned (e.g. by run, lambda, cluster).

    ``sort_within`` (W-06) orders rows inside each output file (e.g. by time)
    without a global sort: ordering is only needed where a file is read."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).option("header", "true").save(path)
