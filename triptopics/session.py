"""Spark session and cluster-wide helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "triptopics") -> SparkSession:
    """Session with the settings every operator assumes: UTC clock, AQE, Arrow, no UI.

    Whatever the launcher has set stays: on a cluster master, memory, shuffle
    partitions and checkpoint folder come from there; only without a master
    (tests, bench) do they default to ``local[N]``.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    if "PYSPARK_GATEWAY_PORT" in os.environ:    # started by spark-submit: its settings are in the running JVM
        SparkContext._ensure_initialized()
    given = SparkConf()
    launched = given.get("spark.master", None)
    local = (master or launched or "local").startswith("local")
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # shuffle partitions are sized at run time: AQE coalesces small ones to ~64 MB
        # and splits skewed join partitions; on a cluster set spark.sql.shuffle.partitions
        # (or coalescePartitions.initialPartitionNum) to input size / 64 MB and let AQE shrink it
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        # checkpoint files (dense indexes, iterative fits) go away with their DataFrames
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if local:
        settings["spark.sql.shuffle.partitions"] = os.environ.get("TT_SHUFFLE_PARTITIONS", cpus)
        settings["spark.driver.memory"] = os.environ.get("TT_DRIVER_MEMORY", _default_driver_memory())
    builder = SparkSession.builder.appName(app).config(map={k: v for k, v in settings.items() if not given.contains(k)})
    if master or not launched:
        builder = builder.master(master or f"local[{cpus}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _default_driver_memory() -> str:
    """Local mode only: half of the machine's memory, between 1 and 8 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    gib = int(total * 0.5 / 2 ** 30)
    return f"{max(1, min(8, gib))}g"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when nothing is set and the
    master is local (tests, bench) is it a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="triptopics-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the checkpoint folder as Parquet and read again.

    For loops that join a table with what is derived from it: a checkpoint hands the planner's size estimate on, and
    as a join's estimate is the product of its sides, its digits multiply with every round (after some fifteen
    rounds the estimate alone takes minutes); a file's size is known."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``triptopics`` importable in local Python workers, once per SparkContext.

    Locally the package is zipped and added with ``addPyFile`` (what
    ``--py-files`` does), so workers started from any directory can run the
    Arrow kernels of ``mapInPandas`` / pandas UDFs.  On a cluster the package
    comes with the deployment (``--py-files triptopics.zip`` or an installed
    wheel), so nothing is written to a machine-local folder there.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or not sc.master.startswith("local"):
        return
    _SHIPPED.add(key)
    if _workers_import(spark):
        return                      # already importable: shipping would only slow tasks down
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="triptopics-pkg-"), "triptopics.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)


def _workers_import(spark: SparkSession) -> bool:
    """One-row probe: can a Python worker import this package as it is?"""
    def probe(batches):
        import importlib.util

        import pandas as pd
        for _ in batches:
            pass
        yield pd.DataFrame({"ok": [importlib.util.find_spec("triptopics") is not None]})

    return bool(spark.range(1).mapInPandas(probe, "ok boolean").first()[0])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
