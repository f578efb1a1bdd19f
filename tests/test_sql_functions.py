"""Functions for SQL users, and late rows of a stream."""

import pytest
from pyspark.sql import functions as F

from roadweave.functions import tables
from roadweave.operators import windows


def test_expand_windows(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([0, 1, 59, 60, 179, 180, 7199, -1, -61, None])], "k long, t long")
    for width, stride in ((60, 60), (120, 60), (60, 180), (100, 70)):
        got = sorted((r.k, r.window_start, r.window_end) for r in spark.sql("SELECT k, w.* FROM {rows}, LATERAL expand_windows(t, {w}, {s}, NULL) w", rows=rows, w=width, s=stride).collect())
        same = windows.sliding(rows.where("t is not null").withColumn("ts", F.timestamp_seconds("t")), width, stride)
        assert got == sorted((r.k, r.window_start, r.window_start + width) for r in same.collect())
    got = spark.sql("SELECT k, w.window_start FROM {rows}, LATERAL expand_windows(t, 120, 60, 60) w", rows=rows).collect()
    assert got and all(r.window_start >= 60 for r in got)
    with pytest.raises(Exception, match="positive"):
        spark.sql("SELECT * FROM expand_windows(5, 0, 60, NULL)").collect()


def test_key_distance(spark):
    tables.register(spark)
    pairs = [("TN01", "TN0I", 0.5), ("TN01", "TN01", 0.0), ("TN01", "TX09", 2.0), ("TN01", "AB99", None), (None, "A", None), ("", "AB", 2.0)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r.d for r in spark.sql("SELECT key_distance(a, b) AS d FROM {rows}", rows=rows).collect()] == [p[2] for p in pairs]
