"""Fuzzy keys against all pairs, questions by the tiers of their match."""

import random

from pyspark.sql import functions as F

from roadweave.operators import identity
from tests.test_evidence import distance

FOLD = str.maketrans("OISBZ", "01582")


def all_pairs(left, right):
    return {(a, b): distance(a, b) for a in left for b in right if distance(a, b) <= 2}


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_recall_is_one(spark):
    """Short and long keys, most of one state, with confusions, gaps and insertions."""
    rnd = random.Random(5)
    keys = {f"TN09AB{rnd.randint(0, 9999):04d}" for _ in range(150)} | {"", "A", "AB", "TN", "T0", "ABCDEFGHIJKLMNOPQRST"}
    near = set()
    for k in sorted(keys):
        t = list(k)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(t))
            t[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["O"], ["0"], ["8"], ["X", "Y"]])
        near.add("".join(t))
    got = identity.fuzzy_pairs(frame(spark, sorted(keys)), frame(spark, [*sorted(near), None, None])).collect()
    assert {(r.l, r.r): r.distance for r in got} == all_pairs(keys, near) and len(got) == len(all_pairs(keys, near)) > 300


def test_keys_of_one_state_meet_few(spark):
    """Keys meet by what is left of them, so lists stay short however alike their beginnings are."""
    rnd = random.Random(6)
    keys = sorted({f"TN09AB{rnd.randint(0, 99_999_999):08d}" for _ in range(2000)})
    left = frame(spark, keys).select(F.explode(identity.deletions("key")).alias("x"))
    assert left.groupBy("x").count().agg(F.max("count")).first()[0] <= 10
    got = identity.fuzzy_pairs(frame(spark, keys), frame(spark, keys)).count()
    assert got >= len(keys)


def test_variants_of_a_key_meet_once(spark):
    """However many keys are folded to one text, it has one list entry for each of what is left of it."""
    variants = ["TN00", "TNO0", "TN0O", "TNOO"]
    folded = frame(spark, variants).select(F.translate("key", "O", "0").alias("folded"))
    assert identity.meeting(folded, "folded").count() == identity.meeting(folded.limit(1), "folded").count() == 8  # itself, three without one character, four without two
    got = identity.fuzzy_pairs(frame(spark, variants), frame(spark, variants)).collect()
    assert {(r.l, r.r): r.distance for r in got} == all_pairs(variants, variants) and len(got) == 16


def test_questions_by_tier(spark):
    """By id, by the journey's key, by a leg's key, by the nearest key, and not at all."""
    journeys = spark.createDataFrame([("JRN_101", "VEH_101", "TN09AB1111", 10), ("JRN_102", "VEH_102", "MH12CD2222", 30), ("JRN_103", "VEH_103", None, 50)], "journey_id string, entity_id string, key string, ord long")
    legs = spark.createDataFrame(
        [("JRN_101", "TN09AB1111", "CAM_A_EAST", 10, 1, 0.95, 0.9, "CONFIRMED"), ("JRN_101", "TN09AB1111", "CAM_B_WEST", 25, 2, 0.91, 0.88, "CONFIRMED"), ("JRN_102", "MH12CD2222", "CAM_A_EAST", 30, 3, 0.65, 0.5, "PENDING"), ("JRN_102", "MH12CD2222", "CAM_C_NORTH", 60, 4, 0.70, 0.68, "PENDING"), ("JRN_103", "KA05ZZ0001", "CAM_A_EAST", 50, 5, 0.9, 0.9, "UNKNOWN"), ("JRN_103", None, "CAM_B_WEST", 70, 6, 0.9, 0.9, "CONFIRMED")],
        "journey_id string, key string, node_id string, t long, seq long, confidence double, score double, status string",
    )
    asked = [
        (1, "CAM_B_WEST", " veh_101", None, None, None),  # by id
        (2, "CAM_B", None, "tn-09 ab 1111", None, None),  # by key, node by alias
        (3, "CAM_B_WEST", None, "TN09AB1111", 26, None),  # not in range
        (4, "CAM_C_NORTH", "JRN_102", None, None, None),  # a leg that isn't sure
        (5, "CAM_B_WEST", None, "KA05ZZ0001", None, None),  # by a leg's key that isn't sure
        (6, "CAM_B_WEST", None, "TN09A81111", None, None),  # near: B read as 8
        (7, "CAM_B_WEST", None, "XX99XX9999", None, None),  # nothing like it
        (8, "CAM_B_WEST", "VEH_999", "TN09AB1111", None, None),  # no such id, then by key
        (9, "CAM_B_WEST", None, None, None, None),
        (10, "CAM_B_WEST", "VEH_101", None, 25, 25),  # both ends count
    ]
    q = spark.createDataFrame(asked, "question_id long, node_id string, entity_id string, key string, t_start long, t_end long")
    got = {r.question_id: (r.verdict, r.tier, r.journey_id, r.legs, r.seen_at) for r in identity.crossings(q, journeys, legs).collect()}
    assert got == {
        1: ("OBSERVED", 0, "JRN_101", 1, 25),
        2: ("OBSERVED", 1, "JRN_101", 1, 25),
        3: ("NOT_OBSERVED", 1, "JRN_101", 0, None),
        4: ("UNKNOWN", 0, "JRN_102", 1, 60),
        5: ("UNKNOWN", 2, "JRN_103", 1, 70),
        6: ("UNKNOWN", 3, "JRN_101", 1, 25),
        7: ("NOT_OBSERVED", None, None, 0, None),
        8: ("OBSERVED", 1, "JRN_101", 1, 25),
        9: ("NOT_OBSERVED", None, None, 0, None),
        10: ("OBSERVED", 0, "JRN_101", 1, 25),
    }
    assert identity.crossings(q.limit(0), journeys, legs).collect() == []
    assert {r.verdict for r in identity.crossings(q, journeys.limit(0), legs.limit(0)).collect()} == {"NOT_OBSERVED"}
