"""Places of nodes from range partitions against sorting them all."""

import pytest
from pyspark.sql import functions as F

from roadweave.operators import graph


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_indexed(spark, n):
    keys = spark.range(n).select(F.when(F.col("id") % 100 == 3, None).otherwise((F.col("id") * 7919 % 1000).cast("string")).alias("key"), "id").repartition(13)
    got = sorted((r.i, r.key) for r in graph.indexed(keys, "key").collect())
    assert [i for i, _ in got] == list(range(n))
    assert [k for _, k in got] == sorted((r.key for r in keys.collect()), key=lambda k: (k is not None, k or ""))


def test_edge_index(spark):
    nodes = lambda keys: graph.indexed(spark.createDataFrame([(k,) for k in keys], "key string"), "key")
    edges = spark.createDataFrame([("v2", "b"), ("v1", "a"), ("v2", "b"), ("v9", "a"), ("v1", None)], "v string, c string")
    got = graph.edge_index(edges, "v", "c", nodes(["v1", "v2", "v3"]), nodes(["a", "b"])).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1)]
