"""Candidate joins, identity links, journeys and questions about them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import match, text
from ..functions.match import MatchLimits
from ..shipping import ship_package
from ..streaming import evidence
from ..streaming.ordered import dealt_by
from . import scores
from .meetings import broadcast_if_few, following
from .windows import epoch


#: Left rows of ``interval_pairs`` that meet a right row at once.
TOGETHER = 32


def interval_pairs(left: DataFrame, right: DataFrame, at: str, most: int, on: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Pairs with left.at < right.at <= left.at + most. The range becomes an equi-join:
    each left row goes to its own bucket of width ``most`` and the next one. Buckets are dealt over all tasks, as a few
    bytes of rows make many pairs; besides its result this takes three rows for each of the table on disk.

    Left rows of a bucket that are alike in ``by`` and neighbours in time are gathered, up to ``TOGETHER``; these meet each right row as one
    and are taken apart in place. So pairs come as runs of one right row and repeats of one list of left rows, which files hold in a
    small part of the room. With ``by``, ``on`` is asked of all of them at once and looks at no other column of the left."""
    own = lambda x: F.floor(F.col(x) / most)
    nth = F.row_number().over(Window.partitionBy("__bucket", *by).orderBy(at))
    a = dealt_by(left.where(F.col(at).isNotNull()).withColumn("__bucket", F.explode(F.array(own(at), own(at) + 1))), "__bucket").withColumn("__nth", F.floor((nth - 1) / TOGETHER))
    rows = F.collect_list(F.struct(*[c for c in left.columns if c not in by]))
    a = a.groupBy("__bucket", *by, "__nth").agg(rows.alias("__rows"), F.min(at).alias("__low"), F.max(at).alias("__high")).alias("l")
    b = dealt_by(right.withColumn("__at", own(at)), "__at").alias("r")
    t = F.col(f"r.{at}")
    near = (F.col("__bucket") == F.col("__at")) & (t > F.col("__low")) & (t - F.col("__high") <= most)
    each = a.join(b, near & on if by and on is not None else near).lateralJoin(left.sparkSession.tvf.inline(F.col("__rows").outer()).alias("l"))
    each = each.where((t > F.col(f"l.{at}")) & (t - F.col(f"l.{at}") <= most))
    return (each if by or on is None else each.where(on)).select(*[F.col(f"l.{c}") for c in left.columns], "r.*").drop("__at")


def distances(pairs: DataFrame, topology: DataFrame, fallback: Column | None = None, default_m: float = 500.0) -> DataFrame:
    """Metres between two nodes: the edge's, else ``fallback`` (such as the
    haversine), else a default; 0 within one node."""
    edge = topology.select(F.col("source").alias("__s"), F.col("target").alias("__t"), F.col("distance_m").alias("__m"))
    known = pairs.join(edge, (F.col("source") == F.col("__s")) & (F.col("target") == F.col("__t")), "left")
    metres = F.coalesce(F.col("__m"), *([fallback] if fallback is not None else []), F.lit(default_m))
    return known.withColumn("distance_m", F.when(F.col("source") == F.col("target"), 0.0).otherwise(metres)).withColumn("has_edge", F.col("__m").isNotNull()).drop("__s", "__t", "__m")


def candidates(legs: DataFrame, topology: DataFrame, limits: MatchLimits = MatchLimits()) -> DataFrame:
    """Feasible (earlier leg, later leg) pairs with their score.

    ``legs``: track_id, node_id, first_ts, last_ts (seconds), key, kind, vector, width, height, direction."""
    pairs = following(legs, int(min(limits.max_gap_s, limits.timeout_s))).where("p_track_id <> q_track_id")
    pairs = distances(pairs.withColumns({"source": F.col("p_node_id"), "target": F.col("q_node_id")}), broadcast_if_few(topology)).withColumn("seconds", F.col("q_first_ts") - F.col("p_last_ts"))
    pairs = pairs.withColumn("reason", match.infeasible(F.col("source") == F.col("target"), "seconds", "distance_m", limits)).where("reason is null")
    scored = match.combined("key_similarity", "appearance", "geometry", "alike", "direction", "seconds", "distance_m", "reason", limits)
    return pairs.select(F.col("p_track_id").alias("before"), F.col("q_track_id").alias("after"), "seconds", "distance_m", "has_edge", scored.alias("breakdown"))


def match_links(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Mutual best pairs: each track's best predecessor that also takes it as best successor.

    A pair stands once as its later track's and once as its earlier one's; of these the best is found within each task
    first, so few rows are shuffled."""
    good = scored.where(F.col("breakdown.overall") >= least)
    sides = F.array(F.struct(F.lit("p").alias("of"), F.col("after").alias("own"), F.col("before").alias("other")), F.struct(F.lit("s").alias("of"), F.col("before").alias("own"), F.col("after").alias("other")))
    each = good.withColumn("__side", F.explode(sides)).select("*", "__side.*").drop("__side")
    best = each.withColumn("__n", F.row_number().over(Window.partitionBy("of", "own").orderBy(F.col("breakdown.overall").desc(), "other"))).where("__n = 1")
    both = F.count("*").over(Window.partitionBy("before", "after"))
    return best.withColumn("__n", both).where("__n = 2 and of = 'p'").select(*scored.columns)


def best_links(legs: DataFrame, topology: DataFrame, limits: MatchLimits = MatchLimits(), least: float = 0.5, looks: DataFrame | None = None) -> DataFrame:
    """(before, after): ``match_links`` of ``candidates`` by ``scores.bests``, so that no pair is made but each leg's best ones of a task."""
    best = scores.bests(legs, topology, limits, least, looks)
    ends = F.when(F.col("of") == "p", F.struct(F.col("other").alias("before"), F.col("own").alias("after"))).otherwise(F.struct(F.col("own").alias("before"), F.col("other").alias("after")))
    return best.select(ends.alias("e")).groupBy("e.before", "e.after").agg(F.count("*").alias("n")).where("n = 2").drop("n")


def journey_summary(legs: DataFrame, keys: list[str], at: str = "ts", order: str = "event_id", node: str = "node_id") -> DataFrame:
    """Legs, ordered distinct nodes, first and last sight of a journey."""
    legs_ = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(order).alias("o"), F.col(node).alias("node"))))
    return legs.groupBy(*keys).agg(F.count("*").alias("legs"), F.min(epoch(at)).alias("first_seen"), F.max(epoch(at)).alias("last_seen"), F.array_join(F.array_distinct(F.transform(legs_, lambda s: s["node"])), ">").alias("nodes"))


def in_range(journeys: DataFrame, legs: str, start: Column | None, end: Column | None, at: str = "at") -> DataFrame:
    """Journeys with a leg in the range, inclusive at both ends, and those legs only."""
    inside = lambda s: F.coalesce(s[at] >= start, F.lit(True)) & F.coalesce(s[at] <= end, F.lit(True))
    start, end = F.lit(None) if start is None else start, F.lit(None) if end is None else end
    return journeys.withColumn(legs, F.filter(legs, inside)).where(F.size(legs) > 0)


def deletions(x: Column) -> Column:
    """A text and all that is left of it without one or two of its characters, each once."""
    n = F.length(x)
    without = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: without(x, i))
    two = F.flatten(F.transform(one, lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: without(t, i))).otherwise(F.array(t))))
    return F.when(n == 0, F.array(x)).otherwise(F.array_distinct(F.concat(F.array(x), one, two)))


@F.pandas_udf(DoubleType())
def distance_within_two(a: pd.Series, b: pd.Series) -> pd.Series:
    """The confusion-weighted edit distance of two keys up to 2, else null."""
    return pd.Series([evidence.distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def meeting(keys: DataFrame, folded: str) -> DataFrame:
    """(folded, left_over): what is left of each folded text, once however many keys are folded to it."""
    return dealt_by(keys.select(folded).distinct().select(folded, F.explode(F.transform(deletions(F.col(folded)), lambda t: F.xxhash64(t))).alias("left_over")), "left_over")


def fuzzy_pairs(left: DataFrame, right: DataFrame, most: float = 2.0) -> DataFrame:
    """(l, r, distance) of keys within a confusion-weighted edit distance.

    Confusable characters are folded, then the distance is at least the number of
    edits. Texts that two edits turn into one another share a text that is left of
    either without two characters or fewer, so keys meet by these: nothing is lost, and a list holds only
    keys that are within four edits of one another. A key of n characters has about n * n / 2
    such texts, so keys are to be short, as plates are. ``left`` and ``right`` have one column, key; null is no key."""
    if most > 2:
        raise ValueError("keys meet for distances of up to 2; beyond that pairs would be lost")

    ship_package(left.sparkSession)

    known = lambda df, side: df.where("key is not null").select("key").distinct().select(F.col("key").alias(side), text.folded("key").alias(f"{side}_folded"))
    a, b = known(left, "l"), known(right, "r")
    near = meeting(a, "l_folded").join(meeting(b, "r_folded"), "left_over").where(F.levenshtein("l_folded", "r_folded", 2) >= 0).select("l_folded", "r_folded").distinct()
    pairs = dealt_by(near.join(a, "l_folded").join(b, "r_folded").select("l", "r"), "l", "r")
    return pairs.withColumn("distance", distance_within_two("l", "r")).where(F.col("distance") <= most)


#: Statuses of a leg whose key isn't sure.
UNSURE = ("PENDING", "UNKNOWN")


def journeys_asked_for(questions: DataFrame, journeys: DataFrame, legs: DataFrame, most: float = 2.0) -> DataFrame:
    """(question_id, journey_id, tier, distance, unsure) of the journey that each question means, if any.

    ``questions``: question_id, entity_id, key, of which either may be null; ``journeys``: journey_id, entity_id, key, ord;
    ``legs``: journey_id, key, status. By id first (tier 0), then by the journey's key (1), a leg's key (2), the
    nearest key within ``most`` (3); of several the first in ``ord``. Each tier sees only the questions that the ones before left. A fuzzy match, or
    one by a leg whose key isn't sure, is unsure."""
    asked = questions.select("question_id", F.upper(F.trim(F.col("entity_id").cast("string"))).alias("who"), F.nullif(text.key("key"), F.lit("")).alias("key"))
    known = journeys.select("journey_id", "ord", F.upper(F.col("entity_id").cast("string")).alias("who"), F.upper(F.col("journey_id").cast("string")).alias("name"), F.nullif(text.key("key"), F.lit("")).alias("key"))
    of_legs = legs.select("journey_id", F.nullif(text.key("key"), F.lit("")).alias("key"), F.coalesce(F.col("status").isin(*UNSURE), F.lit(False)).alias("unsure"), F.col("seq")).where("key is not null").join(known.select("journey_id", "ord"), "journey_id")
    first = F.min(F.struct("distance", "ord", "seq", "journey_id", "unsure")).alias("b")
    of = lambda rows, tier: rows.groupBy("question_id").agg(first).select("question_id", "b.journey_id", F.lit(tier).alias("tier"), "b.distance", "b.unsure")
    plain = lambda rows: rows.withColumns({"distance": F.lit(0.0), "seq": F.lit(0).cast("long"), "unsure": F.lit(False)})
    names = known.select("ord", "journey_id", F.explode(F.array_distinct(F.array("who", "name"))).alias("who"))
    found = of(plain(asked.where("who is not null").join(names, "who")), 0)
    left = asked.where("key is not null").join(found, "question_id", "left_anti")
    by_journey = of(plain(left.join(known.where("key is not null").select("journey_id", "ord", "key"), "key")), 1)
    left = left.join(by_journey, "question_id", "left_anti")
    by_leg = of(left.join(of_legs, "key").withColumn("distance", F.lit(0.0)), 2)
    left = left.join(by_leg, "question_id", "left_anti")
    every = known.where("key is not null").select("key", "journey_id", "ord").unionByName(of_legs.select("key", "journey_id", "ord")).groupBy("key").agg(F.min(F.struct("ord", "journey_id")).alias("j"))
    near = fuzzy_pairs(left.select("key"), every.select("key"), most)
    close = left.join(near, left["key"] == near["l"]).join(every, F.col("r") == every["key"]).select("question_id", "distance", "j.ord", F.lit(0).cast("long").alias("seq"), "j.journey_id", F.lit(True).alias("unsure"))
    return reduce(DataFrame.unionByName, [found, by_journey, by_leg, of(close, 3)])


def crossings(questions: DataFrame, journeys: DataFrame, legs: DataFrame, most: float = 2.0) -> DataFrame:
    """Did what a question asks for pass a node in a range of time? (question_id, verdict, tier, journey_id, legs, seen_at).

    ``questions`` has node_id, t_start and t_end beside those of ``journeys_asked_for``, ``legs`` node_id, t, confidence and score too; nodes
    match by alias. UNKNOWN, if the journey or the best leg isn't sure; NOT_OBSERVED, which doesn't say
    that it wasn't there, if there is no journey or no leg of it in range. ``seen_at`` is the best leg's time."""
    meant = journeys_asked_for(questions, journeys, legs, most)
    q = questions.join(meant, "question_id", "left").alias("q")
    own = (F.col("q.journey_id") == F.col("s.journey_id")) & text.alias_of("s.node_id", "q.node_id") & F.coalesce(F.col("s.t") >= F.col("q.t_start"), F.lit(True)) & F.coalesce(F.col("s.t") <= F.col("q.t_end"), F.lit(True))
    usual = lambda x: F.coalesce(F.nullif(F.col(x), F.lit(0.0)), F.lit(0.5))
    best = F.max_by(F.struct("s.status", "s.t"), F.struct(usual("s.confidence"), usual("s.score"), -F.col("s.t")))
    out = q.join(legs.alias("s"), own, "left").groupBy("q.question_id").agg(F.first("q.tier").alias("tier"), F.first("q.journey_id").alias("journey_id"), F.first("q.unsure").alias("unsure"), F.count("s.t").alias("legs"), best.alias("best"))
    unsure = F.col("unsure") | F.coalesce(F.col("best.status").isin(*UNSURE), F.lit(False))
    verdict = F.when(F.col("legs") == 0, "NOT_OBSERVED").when(unsure, "UNKNOWN").otherwise("OBSERVED")
    return out.select("question_id", verdict.alias("verdict"), "tier", "journey_id", "legs", F.col("best.t").alias("seen_at"))


def tiered(questions: DataFrame, tiers: list[DataFrame], by: str = "question_id") -> DataFrame:
    """The answers of the first tier that has any. Each tier: question, answer, distance, ord."""
    every = None
    for k, tier in enumerate(tiers):
        one = tier.select(by, "answer", F.lit(k).alias("tier"), "distance", "ord")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy(by).agg(F.min(F.struct("tier", "distance", "ord", "answer")).alias("b")).select(by, "b.answer", "b.tier", "b.distance")
    return questions.join(best, by, "left")


def verdicts(questions: DataFrame, legs: DataFrame) -> DataFrame:
    """Was the entity seen at the node in the range? ``questions``: question_id,
    node_id, entity_id, t_start, t_end (null: open). ``legs``: node_id, entity_id, t,
    confidence, score, status. Never says that something didn't happen."""
    q, s = questions.alias("q"), legs.alias("s")
    hit = (F.col("q.entity_id") == F.col("s.entity_id")) & (F.col("q.node_id") == F.col("s.node_id")) & F.coalesce(F.col("s.t") >= F.col("q.t_start"), F.lit(True)) & F.coalesce(F.col("s.t") <= F.col("q.t_end"), F.lit(True))
    usual = lambda x: F.coalesce(F.nullif(F.col(x), F.lit(0.0)), F.lit(0.5))
    best = F.max_by("s.status", F.struct(usual("s.confidence"), usual("s.score"), -F.col("s.t")))
    out = q.join(s, hit, "left").groupBy("q.question_id").agg(F.count("s.t").alias("legs"), best.alias("status"))
    return out.select("question_id", "legs", F.when(F.col("legs") == 0, "NOT_OBSERVED").when(F.col("status").isin("PENDING", "UNKNOWN"), "UNKNOWN").otherwise("OBSERVED").alias("verdict"))
