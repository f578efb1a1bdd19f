"""Journeys in order of arrival: every leg goes to the best journey that is still open.

A region's open journeys are its state. A leg is taken once the watermark is past it, in order of
time and track, and compares itself with the last leg of each open journey; the best of
those that are good enough gets it, and then its earlier leg is no longer to be had. A
journey without a leg for longer than the timeout is completed, by the next leg or by a timer.
``joined`` is the stream, ``joined_table`` its batch twin: a region's legs fall into
sessions at pauses longer than the timeout, when no journey is open; sessions run
side by side, and journeys are numbered on from session to session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.match import OPPOSITE, MatchLimits
from ..operators.graph import written
from ..shipping import ship_package
from .ordered import OrderedRows, dealt_by

#: Columns of a leg, by ``legs_of``. ``near`` and ``metres``: the nodes with an edge to this one, and how far they are.
LEG = "ts double, track string, node string, kind string, key string, sure boolean, vector array<double>, width double, height double, direction string, near array<string>, metres array<double>"
#: An open journey: its own facts and its last leg.
JOURNEY = "number long, key string, kind string, legs long, tracks array<string>, ts double, node string, vector array<double>, width double, height double, direction string"
ROW = "journey long, event string, ts double, track string, node string, leg long, decision string, score double, gap boolean, key string"
FIRST_NUMBER = 101
DEFAULT_METRES = 500.0
_LEG = [f.split()[0] for f in LEG.split(", ")]
_ROW = [f.split()[0] for f in ROW.split(", ")]


@dataclass(frozen=True)
class JourneyRules(MatchLimits):
    """The matcher's weights and limits. Directions are compared if asked; without, they count as unknown."""

    use_direction: bool = False


@dataclass(slots=True)
class Leg:
    ts: float
    track: str
    node: str
    kind: str
    key: str | None
    sure: bool
    vector: list | None
    width: float
    height: float
    direction: str
    near: list
    metres: list


@dataclass(slots=True)
class Journey:
    number: int
    key: str | None
    kind: str
    legs: int
    tracks: list
    ts: float
    node: str
    vector: list | None
    width: float
    height: float
    direction: str

    def held(self) -> tuple:
        return tuple(v.tolist() if isinstance(v := getattr(self, f.name), np.ndarray) else v for f in fields(self))


def _half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def key_likeness(a: str | None, b: str | None) -> float:
    """Of two normalised keys, as ``text.key_similarity``."""
    if not a or not b or "UNKNOWN" in (a, b):
        return 0.5
    if a == b:
        return 1.0
    share = _half_up(sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b)), 3)
    return min(0.05, 0.1 * share) if a[:2] != b[:2] else share


def appearance(a: list | None, b: list | None) -> float:
    """Of two vectors, as ``match.cosine``."""
    if a is None or b is None or len(a) != len(b):
        return 0.5
    x, y = np.asarray(a, float), np.asarray(b, float)
    norm = math.sqrt(float(x @ x) * float(y @ y))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def shape_likeness(w1: float, h1: float, w2: float, h2: float, clash: bool) -> float:
    """Of two boxes, as ``match.shape_similarity``."""
    w1, h1, w2, h2 = (max(1.0, v) for v in (w1, h1, w2, h2))
    r1, r2 = w1 / h1, w2 / h2
    longer = max(0.0, 1 - abs(abs(w1 - h1) / (w1 + h1) - abs(w2 - h2) / (w2 + h2)))
    return _half_up(min(1.0, max(0.0, (0.6 * min(r1, r2) / max(r1, r2) + 0.4 * longer) * (0.35 if clash else 1.0))), 3)


def direction_likeness(a: str, b: str) -> float:
    return 0.5 if "UNKNOWN" in (a, b) else 1.0 if a == b else 0.1 if OPPOSITE.get(a) == b else 0.6


def likeness(j: Journey, q: Leg, rules: JourneyRules) -> float | None:
    """The composite score of a leg as a journey's next, or None if it can't be."""
    seconds = q.ts - j.ts
    metres = 0.0 if j.node == q.node else dict(zip(q.near, q.metres, strict=True)).get(j.node, DEFAULT_METRES)
    if seconds < 0:
        return None
    if j.node != q.node:
        if seconds < metres / (rules.max_kmh / 3.6) or seconds > rules.max_gap_s:
            return None
        if rules.min_kmh and seconds > metres / (rules.min_kmh / 3.6):
            return None
    kmh = metres / max(0.1, seconds) * 3.6 if seconds > 0 else 0.0
    a, b = j.kind.lower(), q.kind.lower()
    total = rules.key * key_likeness(j.key, q.key)
    total += rules.appearance * appearance(j.vector, q.vector)
    total += rules.geometry * shape_likeness(j.width, j.height, q.width, q.height, a != b and "unknown" not in (a, b))
    total += rules.kind * (1.0 if a == b else 0.0)
    total += rules.direction * (direction_likeness(j.direction, q.direction) if rules.use_direction else 0.5)
    total += rules.time * (1.0 if 15 <= kmh <= 80 or seconds == 0 else 0.7)
    total += rules.space * (1.0 if metres < 1000 else 0.5)
    return _half_up(total, 3)


@dataclass
class Region:
    """A region's open journeys, oldest first."""

    rules: JourneyRules
    open: list[Journey] = field(default_factory=list)
    number: int = FIRST_NUMBER

    def complete(self, now: float) -> Iterator[tuple]:
        """Close the journeys that are silent for longer than the timeout."""
        late = [j for j in self.open if now - j.ts > self.rules.timeout_s]
        if late:
            self.open = [j for j in self.open if now - j.ts <= self.rules.timeout_s]
        yield from ((j.number, "COMPLETED", j.ts, None, j.node, j.legs, None, None, None, j.key) for j in late)

    def take(self, q: Leg) -> Iterator[tuple]:
        yield from self.complete(q.ts)
        if q.vector is not None:
            q.vector = np.asarray(q.vector, float)  # once, not for every open journey
        decision, score, gap = None, None, False
        own = next((j for j in self.open if q.track in j.tracks), None)
        if own is not None:
            decision, score = "MATCH_CONFIRMED", 1.0
        else:
            best = self.rules.probable
            for j in self.open:
                if j.node == q.node and q.ts <= j.ts:
                    continue  # both at one node at one time: two things
                s = likeness(j, q, self.rules)
                if s is not None and s >= best and (own is None or s > best):
                    own, best = j, s
            if own is not None:
                score, gap = best, own.node != q.node and own.node not in q.near
                decision = "MATCH_CONFIRMED" if best >= self.rules.confirm else "MATCH_PROBABLE"
        if own is None:
            own = Journey(self.number, None, q.kind, 0, [], q.ts, q.node, None, 0.0, 0.0, "UNKNOWN")
            self.open.append(own)
            self.number += 1
        if q.key and (not own.key or q.sure):
            own.key = q.key
        if q.track not in own.tracks:
            own.tracks.append(q.track)
        own.legs, own.ts, own.node, own.vector, own.width, own.height, own.direction = own.legs + 1, q.ts, q.node, q.vector, q.width, q.height, q.direction
        yield (own.number, "LEG", q.ts, q.track, q.node, own.legs, decision, score, gap, own.key)


def legs_of(sightings: DataFrame, topology: DataFrame, region: str = "region") -> DataFrame:
    """Legs with their region: (track, node, ts in seconds, kind, key, sure, vector, width, height, direction).

    Keys are normalised. Every leg gets the edges to its node, a list as long as the node has neighbours. A leg
    without a region, track, node or time is none; other nulls are unknown."""
    near = topology.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_list(F.struct("source", "distance_m"))).alias("edges"))
    rows = sightings.where(F.col(region).isNotNull()).dropna(subset=["track", "node", "ts"]).join(near, "node", "left")
    none = F.expr("cast(array() as array<struct<source:string,distance_m:double>>)")
    edges = F.coalesce("edges", none)
    unknown = lambda c: F.coalesce(F.col(c), F.lit("UNKNOWN"))
    size = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0))
    columns = {"kind": unknown("kind"), "key": text.key(F.col("key")), "sure": F.coalesce("sure", F.lit(False)), "vector": F.col("vector").cast("array<double>"), "width": size("width"), "height": size("height"), "direction": unknown("direction")}
    columns |= {"near": F.transform(edges, lambda e: e["source"].cast("string")), "metres": F.transform(edges, lambda e: e["distance_m"].cast("double"))}
    rows = rows.withColumns({"track": F.col("track").cast("string"), "node": F.col("node").cast("string"), "ts": F.col("ts").cast("double"), **columns})
    return rows.select(F.col(region).alias("region"), *_LEG, *(["event_time"] if "event_time" in rows.columns else []))


def _sessions(rules: JourneyRules):
    """Legs sorted by region, session, time and track: the rows of each session, journeys numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, until, rows = None, None, None, []
        names = ["region", "session", "made", *_ROW]

        def table(kind):
            of = {"ts": pa.float64(), "score": pa.float64(), "gap": pa.bool_(), "journey": pa.int64(), "leg": pa.int64(), "session": pa.int64(), "made": pa.int64(), "region": kind}
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, of.get(n, pa.string())) for n in names]))

        kind = None
        for batch in batches:
            kind = batch.schema.field("region").type
            for r in batch.to_pylist():
                if (r["region"], r["session"]) != key:
                    if own is not None:
                        rows += [(*key, own.number, *x) for x in own.complete(until)]
                    key, own = (r["region"], r["session"]), Region(rules, number=0)
                until = r["until"]
                rows += [(*key, own.number, *x) for x in own.take(Leg(*[r[c] for c in _LEG]))]
                if len(rows) >= 10_000:
                    yield table(kind)
                    rows = []
        if own is not None:
            rows += [(*key, own.number, *x) for x in own.complete(until)]
        if rows:
            yield table(kind)

    return run


def joined_table(legs: DataFrame, rules: JourneyRules = JourneyRules(), until: float = math.inf) -> DataFrame:
    """(region, journey, event, ts, track, node, leg, decision, score, gap, key): one LEG for each leg up to ``until``
    seconds, and COMPLETED for each journey that is over by then.

    Equal to the stream over the same legs. A session is streamed in order, with its open journeys in memory."""
    ship_package(legs.sparkSession)
    legs = legs.where(F.col("ts") <= until).drop("event_time")
    w = Window.partitionBy("region").orderBy("ts")
    times = legs.select("region", "ts").distinct()
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > rules.timeout_s, F.lit(False))
    sessions = times.withColumn("new", new.cast("long")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    rows = legs.join(sessions, ["region", "ts"]).withColumn("until", F.lit(float(until)))
    dealt = dealt_by(rows, "region", "session").sortWithinPartitions("region", "session", "ts", "track")
    kind = legs.schema["region"].dataType.simpleString()
    made = written(dealt.select("region", "session", "until", *_LEG).mapInArrow(_sessions(rules), f"region {kind}, session long, made long, {ROW}"), "journeys")  # read twice
    counts = made.groupBy("region", "session").agg(F.max("made").alias("n"))
    before = F.sum("n").over(Window.partitionBy("region").orderBy("session").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("region", "session", F.coalesce(before, F.lit(0)).alias("before"))
    return made.join(first, ["region", "session"]).withColumn("journey", F.col("journey") + F.col("before") + FIRST_NUMBER).select("region", *_ROW)


class JourneyState(OrderedRows):
    """A region's open journeys and its legs that the watermark isn't past yet. The first row of its state has the next
    journey's number in place of a journey."""

    def __init__(self, rules: JourneyRules):
        self.rules = rules
        super().__init__(LEG, JOURNEY, ["region", *_ROW])

    def due(self, row: tuple) -> int:
        return math.ceil(row[0] * 1000)

    def wakes(self, held: list[tuple]) -> int | None:
        return math.floor((min(j[5] for j in held[1:]) + self.rules.timeout_s) * 1000) + 1 if len(held) > 1 else None

    def advance(self, held: list[tuple], rows: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple] | None]:
        region = Region(self.rules, [Journey(*[list(v) if isinstance(v, (list, tuple)) else v for v in j]) for j in held[1:]], held[0][0] if held else FIRST_NUMBER)
        made = []
        for r in sorted(rows, key=lambda r: r[:2]):
            made += region.take(Leg(*r))
        made += region.complete(watermark / 1000)
        if not rows and not made:
            return [], None
        return made, [(region.number, *[None] * (len(fields(Journey)) - 1)), *[j.held() for j in region.open]]


def joined(stream: DataFrame, rules: JourneyRules = JourneyRules(), late: str = "1 hour") -> DataFrame:
    """The rows of ``joined_table`` from a stream of ``legs_of`` with their ``event_time``, a leg as soon as the
    watermark is past it. The session needs the RocksDB state store."""
    ship_package(stream.sparkSession)
    kind = stream.schema["region"].dataType.simpleString()
    return stream.withWatermark("event_time", late).groupBy("region").transformWithStateInPandas(JourneyState(rules), f"region {kind}, {ROW}", "Append", "EventTime")
