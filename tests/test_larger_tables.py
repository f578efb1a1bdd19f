"""What only larger tables hold, made from the smallest: values of 0, and ids of five digits and more."""

import os

import duckdb
import pytest

from roadweave.plans import all_queries, all_sql

from .compare import TABLES, connect, differences

SF = "/root/testdata/sf0.001"


def tables(folder, name, events):
    """The smallest tables with other events."""
    path = folder / name
    path.mkdir()
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    (path / "events.parquet").unlink()
    duckdb.connect().execute(f"COPY (SELECT {events} FROM '{SF}/events.parquet' ORDER BY ts) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("made"), "zeros", "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value)")


@pytest.fixture(scope="module")
def long_ids(tmp_path_factory):
    """Few entities with many events each; neighbours' ids have the same first four digits, and one has six zeros."""
    return tables(tmp_path_factory.mktemp("made"), "long_ids", "* REPLACE (CASE WHEN user_id % 3 = 0 THEN 1000000 ELSE 54320 END + user_id % 4 AS user_id)")


@pytest.mark.parametrize("name", ["l2_stream_windows", "c4_checkpoint_verdicts", "g8_upsert_nodes"])
def test_values_of_zero_are_unknown(spark, zeros, name):
    assert differences(spark, connect(zeros), zeros, all_queries()[name], all_sql()[name]) == ""


@pytest.mark.parametrize("name", ["d26_evidence_fusion", "l6_fusion", "l6_fusion_stream"])
def test_long_ids_are_told_apart(spark, long_ids, name):
    assert differences(spark, connect(long_ids), long_ids, all_queries()[name], all_sql()[name]) == ""
