"""Gram sums and ridge weights against plain matrices; draws that don't depend on partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import forecast
from roadweave.plans.model_queries import HORIZONS, deep_samples

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_gram_sums(spark, parts):
    """Over more partitions than rows hold, with missing values, and no rows at all."""
    rnd = np.random.default_rng(parts)
    x = rnd.integers(-5, 6, (30, 9)).astype(float)
    rows = [([float(v) for v in r],) for r in x] + [(None,), ([None, 1.0, *[0.0] * 7],)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(parts)
    x = np.vstack([x, [0.0, 1.0, *[0.0] * 7]])
    got = {(r.i, r.j): r.s for r in forecast.gram_sums(df, F.col("v")).collect()}
    assert got == {(i, j): s for i in range(9) for j in range(i, 9) if (s := (x.T @ x)[i, j]) is not None}
    assert forecast.gram_sums(df.limit(0), F.col("v")).collect() == []


def test_ridge_of_72_inputs(spark):
    rows = deep_samples(spark, SF).cache()
    n = 72
    inputs = [F.get("x", i) for i in range(n)]
    weights = forecast.ridge(rows, inputs, [F.col(f"y_{h}") for h in HORIZONS], 2.0)
    data = rows.select("x", *[f"y_{h}" for h in HORIZONS]).collect()
    a = np.array([[1.0, *r.x] for r in data])
    y = np.array([[r.y_1, r.y_2, r.y_3] for r in data])
    penalty = 2.0 * np.eye(n + 1)
    penalty[0, 0] = 0
    assert len(a) > n and np.allclose(weights, np.linalg.solve(a.T @ a + penalty, a.T @ y), rtol=1e-4, atol=1e-6)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("predicted"))
    one, many = (sorted((r.k, round(r["mean"], 9), round(r["std"], 9)) for r in forecast.monte_carlo(df.repartition(p), ["k"]).collect()) for p in (1, 9))
    assert one == many
    share = [r["std"] / (0.1 * r.k * 1.5) for r in forecast.monte_carlo(df.where("k > 0"), ["k"], draws=200).collect()]
    assert 0.95 < np.mean(share) < 1.05  # the spread asked for
