import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pagetide.session import get_spark
    s = get_spark("local[*]", 8, app_name="pagetide-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_check():
    from pagetide.plans.check import duckdb_connection
    return duckdb_connection(SF_CHECK)
