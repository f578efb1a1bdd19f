"""The operators that SQL can express, against DuckDB."""

import pytest

from roadweave.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert differences(spark, connect(folder), folder, QUERIES[name], ORACLE_SQL[name]) == ""
