"""Pairs within an interval of time against all pairs, and how their work is dealt."""

import random

from pyspark.sql import functions as F

from roadweave.operators import identity


def test_interval_pairs_are_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice("ab"), rnd.choice([None, *[rnd.randint(-300, 300)] * 9])) for k in range(300)] + [(400, "a", -100), (401, "b", 0), (402, "a", 100)]
    df = spark.createDataFrame(rows, "k long, node string, t long")
    got = identity.interval_pairs(df, df, "t", 100, F.col("l.node") != F.col("r.node"))
    assert got.columns == ["k", "node", "t"] * 2
    wanted = sorted((a, b) for a, m, s in rows for b, n, t in rows if None not in (s, t) and s < t <= s + 100 and m != n)
    assert sorted(tuple(r) for r in got.select("l.k", "r.k").collect()) == wanted != []


def test_buckets_are_dealt_over_all_tasks(spark):
    """Small rows were joined in as many tasks as they were read in, here one, however many pairs they make."""
    df = spark.range(2000).select("id", (F.col("id") * 10).alias("t")).coalesce(1)
    pairs = identity.interval_pairs(df, df, "t", 100)
    at = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in at) == sum(min(10, 1999 - k) for k in range(2000)) and len(at) > 4


def test_gathered_rows_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(identity, "TOGETHER", 3)
    rnd = random.Random(7)
    rows = [(k, rnd.choice(["a", "b", None]), rnd.choice([None, *[rnd.randint(-300, 300)] * 9])) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, node string, t long")
    got = identity.interval_pairs(df, df, "t", 100, F.col("l.node") != F.col("r.node"), by=["node"])
    assert got.columns == ["k", "node", "t"] * 2
    wanted = sorted((a, m, s, b, n, t) for a, m, s in rows for b, n, t in rows if None not in (s, t, m, n) and s < t <= s + 100 and m != n)
    assert sorted(tuple(r) for r in got.collect()) == wanted != []


def test_pairs_take_little_room(spark, tmp_path):
    """Pairs in the order in which rows lay took several bytes each."""
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("id"), F.floor(F.rand(1) * 4000).alias("t"))
    pairs = identity.interval_pairs(df, df, "t", 1800).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    pairs.write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 4_000_000 and sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * n
