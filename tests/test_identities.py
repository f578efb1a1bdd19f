"""Arrival-order journeys against plain Python, against the matcher's columns, and as a stream in any batches."""

import math
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from roadweave.functions import match
from roadweave.plans.stream_queries import JOURNEYS, legs_of_sightings
from roadweave.plans.tables import observations
from roadweave.streaming import flows, identities

SF = "/root/testdata/sf0.001"
NAMES = ["region", "journey", "event", "ts", "track", "node", "leg", "decision", "score", "gap", "key"]


def half_up(x, n=3):
    return math.floor(x * 10**n + 0.5) / 10**n


def score(j, q, rules):
    """Of an open journey (a dict) and a leg; None if it can't be."""
    last = j["last"]
    near = dict(zip(q.near, q.metres, strict=True))
    far = 0.0 if last.node == q.node else near.get(last.node, 500.0)
    dt = q.ts - last.ts
    if last.node != q.node and (dt < far / (rules.max_kmh / 3.6) or dt > rules.max_gap_s):
        return None
    a, b = j["key"] or "", q.key or ""
    if not a or not b:
        key = 0.5
    elif a == b:
        key = 1.0
    else:
        key = half_up(sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)))
        key = key if a[:2] == b[:2] else min(0.05, 0.1 * key)
    dot = lambda x, y: sum(p * r for p, r in zip(x, y, strict=True))
    look = 0.5 if last.vector is None or q.vector is None else max(0.0, min(1.0, dot(last.vector, q.vector) / math.sqrt(dot(last.vector, last.vector) * dot(q.vector, q.vector))))
    (w1, h1), (w2, h2) = (last.width, last.height), (q.width, q.height)
    r1, r2 = w1 / h1, w2 / h2
    shape = half_up((0.6 * min(r1, r2) / max(r1, r2) + 0.4 * max(0, 1 - abs(abs(w1 - h1) / (w1 + h1) - abs(w2 - h2) / (w2 + h2)))) * (1 if j["kind"] == q.kind else 0.35))
    kmh = far / max(0.1, dt) * 3.6 if dt > 0 else 0
    way = 0.5
    if rules.use_direction and "UNKNOWN" not in (last.direction, q.direction):
        way = 1.0 if last.direction == q.direction else 0.1 if {last.direction, q.direction} in ({"NORTH", "SOUTH"}, {"EAST", "WEST"}) else 0.6
    parts = [(0.35, key), (0.15, look), (0.10, shape), (0.10, float(j["kind"] == q.kind)), (0.10, way), (0.05, 1.0 if 15 <= kmh <= 80 or dt == 0 else 0.7), (0.15, 1.0 if far < 1000 else 0.5)]
    total = 0.0
    for w, p in parts:  # one after the other: sums of several at once may round otherwise
        total += w * p
    return half_up(total)


def follow(legs, until, rules):
    """All journeys of one region, one leg after the other."""
    out, journeys = [], []

    def close(now):
        for j in journeys:
            if j["open"] and now - j["last"].ts > rules.timeout_s:
                j["open"] = False
                out.append((j["n"], "COMPLETED", j["last"].ts, None, j["last"].node, j["legs"], None, None, None, j["key"]))

    for q in sorted((q for q in legs if q.ts <= until), key=lambda q: (q.ts, q.track)):
        close(q.ts)
        found, best, decision = None, None, None
        for j in journeys:
            if j["open"] and q.track in j["tracks"]:
                found, best, decision = j, 1.0, "MATCH_CONFIRMED"
        gap = False
        if found is None:
            for j in journeys:
                if j["open"] and not (j["last"].node == q.node and q.ts <= j["last"].ts):
                    s = score(j, q, rules)
                    if s is not None and s >= 0.5 and (best is None or s > best):
                        found, best = j, s
            if found is not None:
                decision = "MATCH_CONFIRMED" if best >= 0.75 else "MATCH_PROBABLE"
                gap = found["last"].node != q.node and found["last"].node not in q.near
            else:
                found = {"n": 101 + len(journeys), "kind": q.kind, "key": None, "legs": 0, "tracks": set(), "open": True}
                journeys.append(found)
        found["last"], found["legs"] = q, found["legs"] + 1
        found["tracks"].add(q.track)
        if q.key and (not found["key"] or q.sure):
            found["key"] = q.key
        out.append((found["n"], "LEG", q.ts, q.track, q.node, found["legs"], decision, best, gap, found["key"]))
    close(until)
    return out


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def wanted(legs, until, rules):
    regions = {}
    for r in legs.collect():
        regions.setdefault(r.region, []).append(r)
    return rounded([(g, *row) for g, own in regions.items() for row in follow(own, until, rules)])


@pytest.mark.parametrize("rules", [JOURNEYS, replace(JOURNEYS, use_direction=True), replace(JOURNEYS, timeout_s=1800.0)])
def test_table_equals_plain_python(spark, rules):
    legs = legs_of_sightings(spark, SF, observations(spark, SF)).cache()
    until = legs.agg(F.max("ts")).first()[0] - 40_000
    got = rounded(map(tuple, identities.joined_table(legs, rules, until).select(*NAMES).collect()))
    assert got == wanted(legs, until, rules)
    assert {r[7] for r in got} == {None, "MATCH_CONFIRMED", "MATCH_PROBABLE"} and {r[2] for r in got} == {"LEG", "COMPLETED"}


def test_claimed_journeys_are_not_free(spark):
    """Two legs fit one journey best: the first to arrive has it, the second begins another."""
    leg = lambda track, t, key, kind="car", look=(1.0, 0.0): ("r", track, "b" if t else "a", float(t), kind, key, True, list(look), 2.0, 1.0, "UNKNOWN")
    rows = spark.createDataFrame([leg("one", 0, "TN01AB1234"), leg("two", 20, "TN01AB1235"), leg("three", 20, "TN01AB1234"), leg("four", 22, "KA99ZZ0000", "truck", (0.0, 1.0))], "region string, track string, node string, ts double, kind string, key string, sure boolean, vector array<double>, width double, height double, direction string")
    edges = spark.createDataFrame([("a", "b", 300.0)], "source string, target string, distance_m double")
    got = {r.track: (r.journey, r.leg, r.decision, r.gap) for r in identities.joined_table(identities.legs_of(rows, edges), until=25.0).collect()}
    assert got["one"] == (101, 1, None, False) and got["three"] == (101, 2, "MATCH_CONFIRMED", False)  # of one moment: by name
    assert got["two"] == (102, 1, None, False) and got["four"] == (103, 1, None, False)
    assert identities.joined_table(identities.legs_of(rows.limit(0), edges)).collect() == []
    nothing = spark.createDataFrame([(None,) * 11, ("r", "t", "x", 5.0, *[None] * 7), ("r", "u", "y", 900.0, *[None] * 7)], rows.schema)
    assert [(r.journey, r.event, r.track) for r in identities.joined_table(identities.legs_of(nothing, edges)).orderBy("journey", "event").collect()] == [(101, "COMPLETED", None), (101, "LEG", "t"), (102, "COMPLETED", None), (102, "LEG", "u")]


def test_scores_equal_the_columns(spark):
    """The parts of the score are those of the set-based matcher."""
    legs = legs_of_sightings(spark, SF, observations(spark, SF)).where("region = 0").limit(60).cache()
    pairs = legs.alias("p").crossJoin(legs.alias("q")).where("q.ts > p.ts")
    seconds = F.col("q.ts") - F.col("p.ts")
    edge = F.try_element_at(F.map_from_arrays("q.near", "q.metres"), F.col("p.node"))
    metres = F.when(F.col("p.node") == F.col("q.node"), 0.0).otherwise(F.coalesce(edge, F.lit(500.0)))
    reason = match.infeasible(F.col("p.node") == F.col("q.node"), seconds, metres, JOURNEYS)
    said = match.score("p.key", "q.key", match.cosine(F.col("p.vector"), F.col("q.vector")), match.shape_similarity("p.width", "p.height", "p.kind", "q.width", "q.height", "q.kind"), F.lower("p.kind") == F.lower("q.kind"), match.direction_similarity("p.direction", "q.direction"), seconds, metres, reason, JOURNEYS)
    rows = pairs.select(F.struct("p.*").alias("p"), F.struct("q.*").alias("q"), said.alias("s")).collect()
    rules, n = replace(JOURNEYS, use_direction=True), 0
    for r in rows:
        p, q = (identities.Leg(*[x[c] for c in identities._LEG]) for x in (r.p, r.q))
        j = identities.Journey(1, p.key, p.kind, 1, [], p.ts, p.node, p.vector, p.width, p.height, p.direction)
        got = identities.likeness(j, q, rules)
        assert (got is None) == (r.s.reason is not None) and (got is None or abs(got - r.s.overall) <= 0.0011)
        n += got is not None and got == r.s.overall
    assert n > 100


@pytest.mark.parametrize("cuts", [(), (3, 9), (1, 2, 11, 20, 21)])
def test_stream_equals_table(spark, tmp_path, cuts):
    obs = observations(spark, SF)
    first = obs.agg(F.min(F.unix_seconds("ts"))).first()[0]
    day = (F.unix_seconds("ts") - first) / 86400
    edges = [-1, *cuts, 10**6]
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        obs.where((day > a) & (day <= b)).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        time.sleep(1.1)  # file streams go by the files' times
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    with flows.rocksdb(spark):
        got = flows.drained(identities.joined(legs_of_sightings(spark, SF, stream), JOURNEYS), "append", "identities")
    until = (obs.agg(F.max(F.unix_millis("ts"))).first()[0] - 3_600_000) / 1000.0
    legs = legs_of_sightings(spark, SF, obs)
    assert rounded(map(tuple, got.select(*NAMES).collect())) == wanted(legs, until, JOURNEYS) != []


def test_vectors_are_made_once(monkeypatch):
    """A leg's and a journey's vector became arrays again for every comparison; state has them as lists."""
    region = identities.Region(JOURNEYS)
    leg = lambda track, t: identities.Leg(t, track, "a", "car", None, False, [1.0, 2.0], 2.0, 1.0, "UNKNOWN", [], [])
    said = [*region.take(leg("one", 0.0)), *region.take(leg("two", 60.0))]
    assert [r[0] for r in said] == [101, 101]
    assert not isinstance(region.open[0].vector, list)
    assert region.open[0].held()[7] == [1.0, 2.0]
