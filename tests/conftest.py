import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from triptopics.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    yield s
