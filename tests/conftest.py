import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def small(spark):
    from tessera.sources.fixtures import register_tables
    register_tables(spark, SMALL)
    return SMALL
