"""Registered queries against their DuckDB twins on the smallest scale."""

import pytest

from tables import SF_SMALL
from oracle_check import compare, duck
import __spark_entry__ as E

FAST = ["trips_clean", "od_flow_hourly", "trip_count_histogram", "home_work_users", "station_rank",
        "ranked_trips", "cohort_trips", "train_test_split", "od_flow_rebinned_7h", "tensor_sparsity",
        "top_od_pairs", "passenger_docs", "vocab", "corpus_index", "tfidf", "graph_step", "topic_coherence",
        "perplexity", "topic_match", "destination_accuracy", "js_to_centroid", "category_utility",
        "stream_docs"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    ok, n, _, detail = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert ok, detail


def test_every_sql_twin_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0
