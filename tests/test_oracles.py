"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from tidewatch.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()
# Without SQL: checked in the unit tests instead.
ROWS_ONLY = {"hashed_row_sample"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert name in ROWS_ONLY
        assert QUERIES[name](spark, SF).count() > 0
        return
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
