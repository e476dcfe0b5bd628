"""Query catalog: importing this package registers every query."""

from . import q_docs, q_fits, q_linkage, q_metrics, q_onesweep, q_stream, q_trips, q_tucker  # noqa: F401
from ..session import ensure_checkpoint_dir, ship_package
from .catalog import REGISTRY, Query, query  # noqa: F401


def _with_checkpoint_dir(build):
    """Every query may cut lineage with ``checkpoint()`` and run Python kernels:
    make sure the session names a checkpoint folder (the cluster's
    ``spark.checkpoint.dir``) and that workers can import the package."""
    def run(spark, sf_dir):
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return build(spark, sf_dir)
    run.__name__ = getattr(build, "__name__", "query")
    run.__doc__ = build.__doc__
    return run


def queries():
    return {name: _with_checkpoint_dir(q.build) for name, q in REGISTRY.items()}


def oracle_sql():
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
