"""Each leg's best ones and all scores, made where legs lie, against the scores of all pairs as columns."""

import random

import pytest
from pyspark.sql import functions as F

from roadweave.functions import match
from roadweave.operators import graph, identity, meetings, scores

from .test_meetings import made

LIMITS = match.MatchLimits(timeout_s=100, max_kmh=40, min_kmh=3.0)


def topology(spark):
    return spark.createDataFrame([("a", "b", 250.0), ("b", "a", 1200.0), ("b", "b", 70.0), ("c", "a", None), ("z", "a", 3.0)], "source string, target string, distance_m double")


def legs(spark):
    rows = made(spark).withColumns({"node_id": F.when(F.col("track_id") % 17 > 0, F.col("node_id")), "track_id": F.col("track_id") * 7919 % 401})
    return rows.withColumn("kind", F.when(F.col("track_id") % 3 == 0, "car").otherwise(F.col("kind")))


@pytest.fixture(params=[(16, 4, 16), (65536, 64, 16)], ids=["small shares", "one share"])
def shares(request, monkeypatch):
    for name, value in zip(("SHARE", "BLOCK", "WIDEST"), request.param):
        monkeypatch.setattr(meetings, name, value)


def test_scores_are_those_of_the_columns(spark, shares):
    wanted = identity.candidates(legs(spark), topology(spark), LIMITS).select("before", "after", "seconds", "distance_m", "has_edge", "breakdown.overall", "breakdown.decision")
    got = scores.scored(legs(spark), topology(spark), LIMITS).withColumn("decision", match.decided("overall", LIMITS))
    assert got.columns == wanted.columns and [t for _, t in got.dtypes] == [t for _, t in wanted.dtypes]
    got, wanted = (sorted(tuple(r) for r in df.collect()) for df in (got, wanted))
    assert got == wanted and len(got) > 2000


def test_links_are_those_of_all_pairs(spark, shares):
    """Least scores at which many pairs are equal, and vectors by number too."""
    rows = legs(spark)
    pairs = identity.candidates(rows, topology(spark), LIMITS).cache()
    vectors = rows.where("vector is not null").select("vector").distinct().withColumn("look", F.monotonically_increasing_id()).cache()
    numbered = rows.join(vectors, "vector", "left").drop("vector").cache()
    for least in (0.3, 0.5, 0.6):
        wanted = sorted((r.before, r.after) for r in identity.match_links(pairs, least).collect())
        assert sorted(tuple(r) for r in identity.best_links(rows, topology(spark), LIMITS, least).collect()) == wanted != []
        assert sorted(tuple(r) for r in identity.best_links(numbered, topology(spark), LIMITS, least, vectors).collect()) == wanted


def test_few_legs_lie_in_wide_cells(spark):
    """Every leg lay in three places, with its vector; of those with one vector each task now has it once."""
    rows = spark.range(3000).selectExpr("id track_id", "'a' node_id", "id * 20 first_ts", "id * 20 last_ts", "'' key", "'car' kind", "0L look", "1D width", "1D height", "'EAST' direction")
    looks = spark.createDataFrame([(0, [1.0, 2.0])], "look long, vector array<double>")
    dealt = scores.with_shared(rows, topology(spark), 100, looks)
    n = dealt.agg(F.count("__early").alias("legs"), F.count("vector").alias("vectors"), F.count_distinct("__cell").alias("cells")).first()
    assert n.legs < 2.2 * 3000 and n.vectors == n.cells


def test_chains(spark):
    """Names in no order: the least one came forward by a place or two in a round, now their number doubles."""
    rnd = random.Random(6)
    names = rnd.sample(range(10_000), 700)
    parts = [names[:500], names[500:502], names[502:700]]
    links = spark.createDataFrame([(a, b) for p in parts for a, b in zip(p, p[1:])], "before long, after long")
    assert sorted(tuple(r) for r in graph.chains(links).collect()) == sorted((k, min(p)) for p in parts for k in p)
    assert graph.chains(links.limit(0)).collect() == []
