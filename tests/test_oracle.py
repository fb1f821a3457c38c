"""Every SQL-checkable query equals its DuckDB oracle at sf0.01 (the driver's gate)."""
import pytest

import __spark_entry__ as E
from pagetide.plans.check import compare

from conftest import SF_CHECK

NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck_check, name):
    df = E.queries()[name](spark, SF_CHECK)
    ok, msg = compare(df, duck_check, E.oracle_sql()[name], digits=12)
    assert ok, msg
