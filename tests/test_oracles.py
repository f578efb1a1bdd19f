"""Every query with SQL against DuckDB on the smallest tables; the others return rows."""

import pytest

from roadweave.plans import all_queries, all_sql

from .compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    sql = all_sql().get(name)
    if sql:
        assert differences(spark, con, SF, all_queries()[name], sql) == ""
    else:
        assert all_queries()[name](spark, SF).limit(5).collect()
