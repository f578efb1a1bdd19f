"""Legs that follow one another against all pairs, whatever shares and blocks they are dealt into; links against plain Python."""

import random

from pyspark.sql import functions as F

from roadweave.functions import match, text
from roadweave.operators import identity, meetings

SCHEMA = "track_id long, node_id string, first_ts long, last_ts long, key string, kind string, vector array<double>, width double, height double, direction string"


def made(spark, n=400):
    rnd = random.Random(3)
    keys = ["", None, "unknown", "T", "TN", "TN 09", "TN09AB1234", "TNO9AB1234", "KA05ZZ0001", "é\U0001f600 1"]
    rows = []
    for i in range(n):
        vector = rnd.choice([None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [rnd.uniform(-1, 1), 2.0], *[[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(5)]])
        at = rnd.choice([None, 500, *[rnd.randint(-300, 900)] * 8])
        rows.append((i, rnd.choice("abc"), at, None if at is None else at + rnd.randint(0, 3), rnd.choice(keys), rnd.choice(["car", "Car", "bus", "Unknown", None]), vector, rnd.choice([None, rnd.uniform(0, 50)]), 9.0, rnd.choice([None, "EAST", "WEST", "NORTH", "UNKNOWN", "?"])))
    return spark.createDataFrame(rows, SCHEMA)


def test_following_is_all_pairs(spark, monkeypatch):
    """In shares of 16 legs and blocks of 4; similarities are to the last digit those of the columns."""
    monkeypatch.setattr(meetings, "SHARE", 16)
    monkeypatch.setattr(meetings, "BLOCK", 4)
    legs = made(spark)
    got = [tuple(r) for r in meetings.following(legs, 100).select("p_track_id", "q_track_id", "appearance", "key_similarity", "geometry", "direction", "alike").collect()]
    p, q = legs.alias("p"), legs.alias("q")
    all_pairs = p.crossJoin(q).where("q.first_ts > p.last_ts and q.first_ts - p.last_ts <= 100")
    parts = [match.cosine(F.col("p.vector"), F.col("q.vector")), text.key_similarity("p.key", "q.key"), match.shape_similarity("p.width", "p.height", "p.kind", "q.width", "q.height", "q.kind"), match.direction_similarity("p.direction", "q.direction")]
    wanted = [tuple(r) for r in all_pairs.select("p.track_id", "q.track_id", *parts, F.coalesce(F.lower("p.kind") == F.lower("q.kind"), F.lit(False))).collect()]
    order = lambda r: r[:2]
    assert sorted(got, key=order) == sorted(wanted, key=order) and len(got) > 5000


def test_no_legs(spark):
    assert meetings.following(made(spark).limit(0), 100).collect() == []


def test_links_are_mutual_bests(spark):
    rnd = random.Random(4)
    pairs = {(rnd.randint(0, 30), rnd.randint(0, 30)): rnd.choice([0.2, 0.5, 0.6, 0.7, 0.8]) for _ in range(300)}
    scored = spark.createDataFrame([(a, b, (s,)) for (a, b), s in pairs.items()], "before long, after long, breakdown struct<overall:double>")
    best = lambda rows, own, other: {k: min((-s, p[other]) for p, s in rows if p[own] == k)[1] for k in {p[own] for p, _ in rows}}
    good = [(p, s) for p, s in pairs.items() if s >= 0.5]
    before, after = best(good, 1, 0), best(good, 0, 1)
    got = identity.match_links(scored)
    assert got.columns == scored.columns
    assert sorted((r.before, r.after) for r in got.collect()) == sorted((a, b) for b, a in before.items() if after[a] == b) != []
