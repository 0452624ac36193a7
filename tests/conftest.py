import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import local_session

    s = local_session("*", shuffle_partitions=8, app="riskloom-tests")
    yield s


@pytest.fixture(scope="session")
def tables01(spark):
    from riskloom.sources.adapters import Tables

    return Tables(spark, SF01)
