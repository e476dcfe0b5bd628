import pytest
from corpus_rows import edge_rows, make_docs


@pytest.fixture(scope="session")
def edge(spark):
    return edge_rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edge):
    return make_docs(spark, edge).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])
