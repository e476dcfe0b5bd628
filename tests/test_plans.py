"""Physical-plan properties: pruning, pushdown, join strategies, no pair products."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tables import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    for name in E.oracle_sql():
        if name.startswith("stream_"):
            continue
        out[name] = _plan(E.queries()[name](spark, SF_SMALL))
    return out


def test_no_pair_products_anywhere(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_scan_prunes_columns(plans):
    p = plans["od_flow_hourly"]
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in p
    assert "value:double" not in p


def test_words_are_counted_where_their_text_lies(plans):
    """Texts are shuffled by document once; no (document, word) rows are."""
    for name in ("tfidf", "unseen_doc_bow", "bag_of_words", "pruned_vocab"):
        keys = [line.split("hashpartitioning(")[1].split(")")[0] for line in plans[name].splitlines() if "hashpartitioning(" in line]
        assert keys and not any("doc_id#" in k and "token#" in k for k in keys), name
        assert any("doc_id#" in k for k in keys), name


def test_filter_reaches_parquet_scan(plans):
    p = plans["od_flow_lineitem"]
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in p


def test_cohort_is_bounded_broadcast_semi_join(plans):
    p = plans["cohort_trips"]
    assert "BroadcastHashJoin LeftSemi" in p and "TakeOrderedAndProject" in p


def test_chain_limits_first_event_map_side(plans):
    p = plans["trips_clean"]
    assert "WindowGroupLimit" in p and "Partial" in p


def test_first_trips_limit_before_shuffle(plans):
    p = plans["first_two_trips"]
    assert "WindowGroupLimit" in p and "Partial" in p


def test_facts_are_not_shuffled_on_station_keys(spark):
    """With the planner's own broadcasts off, the checked hints alone keep the trips off the few hot keys."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for name in ("ranked_trips", "corpus_index", "topic_coherence", "perplexity"):
            p = _plan(E.queries()[name](spark, SF_SMALL))
            for line in p.splitlines():
                if "hashpartitioning(" in line:
                    keys = line.split("hashpartitioning(")[1].split(")")[0].split(", ")
                    plain = {k.split("#")[0] for k in keys if "#" in k}
                    assert plain - {"origin", "dest", "hour", "dim", "word", "topic", "value"} or "ENSURE" not in line or _aggregated(p, line), (name, line)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _aggregated(plan, line):
    """The exchange of this line feeds on a partial aggregate (a row per key and task), not on the facts."""
    number = plan[:plan.index(line)].rsplit("(", 1)[1].split(")")[0]
    tree = plan.split("\n\n")[0].splitlines()
    at = next(i for i, row in enumerate(tree) if row.rstrip().endswith(f"({number})"))
    return "HashAggregate" in tree[at + 1]
