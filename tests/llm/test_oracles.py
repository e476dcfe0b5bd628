"""Queries against their DuckDB twins on the small tables."""
import pytest
from oracle_check import compare, duck

from triptopics.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_twin(spark, name):
    ok, rows, _, detail = compare(spark, name, llm.queries()[name], llm.oracle_sql()[name], SF, duck(SF))
    assert ok and rows > 0, detail


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
