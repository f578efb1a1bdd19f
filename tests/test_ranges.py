"""Points in ranges of any width against all pairs."""

import random

from roadweave.operators import lookups


def test_within(spark):
    rnd = random.Random(1)
    points = [(k, rnd.choice("ab"), rnd.choice([rnd.uniform(-100, 100), float(rnd.randint(-5, 5)), 1e9, -1e-9, 0.0])) for k in range(300)] + [(900, None, 1.0), (901, "a", None)]
    ranges = []
    for k in range(150):
        low = rnd.choice([rnd.uniform(-100, 100), float(rnd.randint(-5, 5)), 0.0])
        ranges.append((k, rnd.choice("ab"), low, low + rnd.choice([0.0, 1e-9, 0.5, 1.0, 4.0, 33.3, 1e9, 1e12])))
    ranges += [(900, "a", 5.0, 1.0), (901, "a", None, 1.0), (902, None, 0.0, 1.0)]
    p = spark.createDataFrame(points, "p long, road string, at double")
    r = spark.createDataFrame(ranges, "r long, road string, low double, high double")
    got = sorted((x.r, x.p) for x in lookups.within(p, r, ["road"], "at", "low", "high").collect())
    wanted = sorted((rk, pk) for rk, rr, low, high in ranges for pk, pr, at in points if None not in (rr, low, at) and rr == pr and low <= at <= high)
    assert got == wanted and len(wanted) > 1000
    assert lookups.within(p, r.limit(0), ["road"], "at", "low", "high").collect() == [] and lookups.within(p.limit(0), r, ["road"], "at", "low", "high").collect() == []
