"""Tracks of boxes within a camera: prediction, two-stage association, lost and removed tracks.

A camera's tracks are its state. A frame is taken once the watermark is past it, so all its
boxes are there, whatever batches they came in; frames without boxes count as misses, and
timers take them. ``tracked`` is the stream, ``tracked_table`` its batch twin: a camera's
frames fall into sessions where every track has been removed, sessions run side by side,
and track numbers follow from the number of tracks of a camera's earlier sessions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import written
from ..shipping import ship_package
from .ordered import OrderedRows, dealt_by


@dataclass(frozen=True)
class TrackRules:
    """Thresholds and weights of the tracker. A frame lasts ``frame_s`` seconds."""

    frame_s: float = 1.0
    # Confidence bands, least score, misses, hits, box gates, weights, smoothing, speed.
    high: float = 0.60
    low: float = 0.20
    least_score: float = 0.30
    most_missed: int = 30
    confirm_hits: int = 3
    least_area: float = 100.0
    most_aspect: float = 5.0
    same_box: float = 0.85
    duplicate: float = 0.80
    overlap: float = 0.40
    motion: float = 0.25
    size: float = 0.15
    kind: float = 0.10
    confidence: float = 0.10
    smoothing: float = 0.70
    most_speed: float = 1500.0
    least_motion: float = 2.0
    first_number: int = 101


#: Names of the eighths of a circle from east on, against the clock; y points down.
WAYS = ("EAST", "NORTHEAST", "NORTH", "NORTHWEST", "WEST", "SOUTHWEST", "SOUTH", "SOUTHEAST")
TRACK = "number long, kind string, x1 double, y1 double, x2 double, y2 double, confidence double, seen double, age long, hits long, missed long, status string, vx double, vy double, speed double, direction string, returns long, quality double, votes array<struct<kind:string,n:long>>"
ROW = "frame long, track long, status string, kind string, x1 double, y1 double, x2 double, y2 double, hits long, missed long, age long, speed double, direction string, returns long, quality double"


@dataclass(slots=True)
class Track:
    number: int
    kind: str
    box: tuple[float, float, float, float]
    confidence: float
    seen: float
    age: int = 1
    hits: int = 1
    missed: int = 0
    status: str = "TENTATIVE"
    vx: float = 0.0
    vy: float = 0.0
    speed: float = 0.0
    direction: str = "UNKNOWN"
    returns: int = 0
    quality: float = 0.0
    votes: dict = field(default_factory=dict)

    def held(self) -> tuple:
        """As a row of state, see ``TRACK``."""
        return (self.number, self.kind, *self.box, self.confidence, self.seen, self.age, self.hits, self.missed, self.status, self.vx, self.vy, self.speed, self.direction, self.returns, self.quality, [(k, n) for k, n in self.votes.items()])

    @classmethod
    def from_held(cls, row) -> Track:
        v = list(row)
        votes = {x[0]: x[1] for x in v[18]}
        return cls(v[0], v[1], tuple(v[2:6]), v[6], v[7], v[8], v[9], v[10], v[11], v[12], v[13], v[14], v[15], v[16], v[17], votes)

    def said(self, frame: int) -> tuple:
        """As a row of the result, see ``ROW``."""
        return (frame, self.number, self.status, self.kind, *self.box, self.hits, self.missed, self.age, self.speed, self.direction, self.returns, self.quality)


@dataclass(frozen=True, slots=True)
class Box:
    """A detection; ``order`` is its place among equally sure ones of its frame."""

    order: int
    kind: str
    confidence: float
    box: tuple[float, float, float, float]


# A frame has a handful of boxes and tracks: plain numbers are many times faster there than arrays.
def area(x: tuple) -> float:
    return (x[2] - x[0]) * (x[3] - x[1])


def overlap(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes."""
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    both = wide * high
    union = area(a) + area(b) - both
    return both / union if union > 0 else 0.0


def length(x: float, y: float) -> float:
    """The C library's hypot, as arrays have it; ``math.hypot`` rounds otherwise in the last place."""
    try:
        return abs(complex(x, y))
    except OverflowError:
        return math.inf


def gated(boxes: Iterable[Box], rules: TrackRules) -> list[Box]:
    """Boxes of a usable form, surest first, without those that a surer one of their kind covers."""
    good = []
    for b in sorted(boxes, key=lambda b: b.order):
        w, h = b.box[2] - b.box[0], b.box[3] - b.box[1]
        if w > 0 and h > 0 and w * h >= rules.least_area and max(w, h) / max(1.0, min(w, h)) <= rules.most_aspect:
            good.append(b)
    good.sort(key=lambda b: -b.confidence)
    kept: list[Box] = []
    for b in good:
        if not any(k.kind == b.kind and overlap(b.box, k.box) >= rules.same_box for k in kept):
            kept.append(b)
    return kept


def scores(tracks: list[Track], boxes: list[Box], rules: TrackRules) -> list[float]:
    """Five-factor score of every track and box, box by box of each track: overlap, motion, size, kind, confidence."""
    seen = [(x.box, (x.box[0] + x.box[2]) / 2.0, (x.box[1] + x.box[3]) / 2.0, max(1.0, area(x.box)), x.kind, x.confidence) for x in boxes]
    out = []
    for t in tracks:
        a = t.box
        x, y, own = (a[0] + a[2]) / 2.0, (a[1] + a[3]) / 2.0, max(1.0, area(a))
        reach = max(50.0, length(a[2] - a[0], a[3] - a[1]))
        for b, bx, by, other, kind, sure in seen:
            near = max(0.0, 1.0 - length(x - bx, y - by) / reach)
            size = min(own, other) / max(own, other)
            out.append(rules.overlap * overlap(a, b) + rules.motion * near + rules.size * size + rules.kind * (1.0 if t.kind == kind else 0.5) + rules.confidence * sure)
    return out


def associated(tracks: list[Track], boxes: list[Box], rules: TrackRules) -> list[tuple[int, int]]:
    """Greedy one-to-one pairs, best score first; ties go to the older track, then to the surer box."""
    if not tracks or not boxes:
        return []
    s = scores(tracks, boxes, rules)
    order = sorted((at for at, one in enumerate(s) if one >= rules.least_score), key=lambda at: -s[at])
    pairs, free_t, free_b = [], [True] * len(tracks), [True] * len(boxes)
    for at in order:
        t, b = divmod(at, len(boxes))
        if free_t[t] and free_b[b]:
            free_t[t] = free_b[b] = False
            pairs.append((t, b))
    return pairs


def motion(dx: float, dy: float, seconds: float, rules: TrackRules) -> tuple[float, float, float, str]:
    """Velocity, speed and direction of a shift."""
    if seconds < 0.01:
        return 0.0, 0.0, 0.0, "STATIONARY"
    far = math.hypot(dx, dy)
    vx, vy, speed = dx / seconds, dy / seconds, far / seconds
    if speed > rules.most_speed:
        vx, vy, speed = vx * rules.most_speed / speed, vy * rules.most_speed / speed, rules.most_speed
    way = "STATIONARY" if far < rules.least_motion else WAYS[int((math.degrees(math.atan2(-dy, dx)) + 22.5) % 360.0 // 45.0)]
    return round(vx, 2), round(vy, 2), round(speed, 2), way


def predicted(t: Track, seconds: float, rules: TrackRules) -> tuple:
    """The box moved on at constant velocity, within the picture's upper and left border."""
    if seconds <= 0 or (t.vx == 0.0 and t.vy == 0.0):
        return t.box
    part = min(1.0, rules.most_speed / math.hypot(t.vx, t.vy)) * seconds
    x1, y1 = max(0.0, t.box[0] + t.vx * part), max(0.0, t.box[1] + t.vy * part)
    return x1, y1, max(x1 + 1.0, t.box[2] + t.vx * part), max(y1 + 1.0, t.box[3] + t.vy * part)


def _hit(t: Track, b: Box, now: float, rules: TrackRules) -> None:
    old, new = t.box, b.box
    dx, dy = (((new[i] + new[i + 2]) - (old[i] + old[i + 2])) / 2.0 for i in (0, 1))
    t.vx, t.vy, t.speed, t.direction = motion(dx, dy, max(0.001, now - t.seen), rules)
    t.box = tuple(rules.smoothing * n + (1.0 - rules.smoothing) * o for n, o in zip(new, old, strict=True))
    t.confidence, t.seen, t.age, t.hits, t.missed = b.confidence, now, t.age + 1, t.hits + 1, 0
    t.votes[b.kind] = t.votes.get(b.kind, 0) + 1
    t.kind = max(t.votes, key=t.votes.__getitem__)
    if t.status == "LOST":
        t.status, t.returns = "REACTIVATED", t.returns + 1
    elif t.hits >= rules.confirm_hits:
        t.status = "CONFIRMED"
    t.quality = round(min(1.0, 0.5 * t.hits / t.age + 0.5 * b.confidence), 3)


def _missed(t: Track, now: float, rules: TrackRules) -> None:
    t.missed, t.age, t.status = t.missed + 1, t.age + 1, "LOST"
    t.box = predicted(t, max(0.033, now - t.seen), rules)
    if t.missed > rules.most_missed:
        t.status = "REMOVED"


def _without_duplicates(tracks: list[Track], rules: TrackRules) -> None:
    """Of two tracks of one kind in one place, that with fewer hits is removed."""
    live = [t for t in tracks if t.status != "REMOVED"]
    for i, a in enumerate(live):
        for j in range(i + 1, len(live)):
            b = live[j]
            if a.status == "REMOVED":
                break
            if b.status != "REMOVED" and a.kind == b.kind and overlap(a.box, b.box) >= rules.duplicate:
                (b if a.hits >= b.hits else a).status = "REMOVED"


def take_frame(tracks: list[Track], number: int, boxes: Iterable[Box], now: float, rules: TrackRules) -> tuple[list[Track], int]:
    """All tracks after a frame, those that it removed among them, and the next free number."""
    seen = gated(boxes, rules)
    sure = [b for b in seen if b.confidence >= rules.high]
    weak = [b for b in seen if rules.low <= b.confidence < rules.high]
    first = associated(tracks, sure, rules)
    left = [k for k in range(len(tracks)) if k not in {t for t, _ in first}]
    second = associated([tracks[k] for k in left], weak, rules)
    for t, b in first:
        _hit(tracks[t], sure[b], now, rules)
    for t, b in second:
        _hit(tracks[left[t]], weak[b], now, rules)
    hit = {t for t, _ in first} | {left[t] for t, _ in second}
    taken = {b for _, b in first}
    new = [Track(number + k, b.kind, tuple(map(float, b.box)), b.confidence, now, quality=round(b.confidence, 3), votes={b.kind: 1}) for k, b in enumerate(b for i, b in enumerate(sure) if i not in taken)]
    for k, t in enumerate(tracks):
        if k not in hit:
            _missed(t, now, rules)
    tracks = tracks + new
    _without_duplicates(tracks, rules)
    return tracks, number + len(new)


class Camera:
    """One camera's tracks. ``done`` is the last frame taken, or None before the first."""

    def __init__(self, rules: TrackRules, tracks: list[Track] | None = None, number: int = 0, done: int | None = None):
        self.rules, self.tracks, self.number, self.done = rules, tracks or [], number, done

    def to(self, frame: int, boxes: Iterable[Box]) -> Iterator[tuple]:
        """Take ``frame``, and before it the frames without boxes in which tracks are still missed."""
        yield from self.idle(frame - 1)
        self.done = frame
        self.tracks, self.number = take_frame(self.tracks, self.number, boxes, frame * float(self.rules.frame_s), self.rules)
        yield from self._said()

    def idle(self, last: int) -> Iterator[tuple]:
        """Frames without boxes up to ``last``, as long as there are tracks."""
        while self.tracks and self.done < last:
            self.done += 1
            self.tracks, self.number = take_frame(self.tracks, self.number, (), self.done * float(self.rules.frame_s), self.rules)
            yield from self._said()

    def _said(self) -> Iterator[tuple]:
        yield from (t.said(self.done) for t in self.tracks)
        self.tracks = [t for t in self.tracks if t.status != "REMOVED"]


_NAMES = [f.split()[0] for f in ROW.split(", ")]


def _sessions(rules: TrackRules):
    """Boxes sorted by camera, session, frame and order: the tracks of each session, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, camera, frame, boxes, until = None, None, None, [], None
        rows: list[tuple] = []

        def close():
            out = [*camera.to(frame, boxes)]
            return [(*key, camera.number, *r) for r in out]

        def ended():
            return [(*key, camera.number, *r) for r in camera.idle(until)]

        def table():
            names = ["camera", "session", "made", *_NAMES]
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

        schema = None
        for batch in batches:
            kind = batch.schema.field("camera").type
            long, text, real = pa.int64(), pa.string(), pa.float64()
            of = {"status": text, "kind": text, "direction": text, **{k: real for k in ("x1", "y1", "x2", "y2", "speed", "quality")}}
            schema = pa.schema([("camera", kind), ("session", long), ("made", long), *[(n, of.get(n, long)) for n in _NAMES]])
            for r in batch.to_pylist():
                if (r["camera"], r["session"]) != key or r["frame"] != frame:
                    if camera is not None:
                        rows += close()
                    if (r["camera"], r["session"]) != key:
                        if camera is not None:
                            rows += ended()
                        key, camera = (r["camera"], r["session"]), Camera(rules)
                    frame, boxes, until = r["frame"], [], r["until"]
                boxes.append(Box(r["order"], r["kind"], r["confidence"], (r["x1"], r["y1"], r["x2"], r["y2"])))
                if len(rows) >= 10_000:
                    yield table()
                    rows = []
        if camera is not None:
            rows += close() + ended()
        if rows:
            yield table()

    return run


def detections(boxes: DataFrame, camera: str, frame: str, order: str, kind: str, confidence: str, box: str) -> DataFrame:
    """The columns that the tracker reads, by their names here. Rows that miss one of them are no detection."""
    b = F.col(box)
    rows = boxes.select(F.col(camera).alias("camera"), F.col(frame).cast("long").alias("frame"), F.col(order).cast("long").alias("order"), F.col(kind).cast("string").alias("kind"), F.col(confidence).cast("double").alias("confidence"), *[b[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], *([F.col("ts")] if "ts" in boxes.columns else []))
    return rows.dropna()


def tracked_table(found: DataFrame, rules: TrackRules = TrackRules(), until: int | None = None) -> DataFrame:
    """(camera, frame, track, status, ...) of every track and frame, given ``detections``.

    Frames up to ``until``, by default the table's last, are taken, frames without boxes too.
    Equal to the stream over the same rows. A session is streamed in order, with one frame and the live tracks in memory."""
    ship_package(found.sparkSession)
    if until is None:
        until = found.agg(F.max("frame")).first()[0]
    found = found.where(F.col("frame") <= F.lit(until)).drop("ts")
    w = Window.partitionBy("camera").orderBy("frame")
    frames = found.select("camera", "frame").distinct()
    new = F.coalesce(F.col("frame") - F.lag("frame").over(w) > rules.most_missed + 1, F.lit(False))
    sessions = frames.withColumn("new", new.cast("long")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    rows = found.join(sessions, ["camera", "frame"]).withColumn("until", F.lit(until).cast("long"))
    dealt = dealt_by(rows, "camera", "session").sortWithinPartitions("camera", "session", "frame", "order")
    kind = found.schema["camera"].dataType.simpleString()
    made = written(dealt.mapInArrow(_sessions(rules), f"camera {kind}, session long, made long, {ROW}"), "tracks")  # read twice
    # numbers of a camera's tracks go on from session to session
    counts = made.groupBy("camera", "session").agg(F.max("made").alias("n"))
    before = F.sum("n").over(Window.partitionBy("camera").orderBy("session").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("camera", "session", F.coalesce(before, F.lit(0)).alias("before"))
    out = made.join(first, ["camera", "session"]).withColumn("track", F.col("track") + F.col("before") + rules.first_number)
    return out.select("camera", *_NAMES)


class TrackerState(OrderedRows):
    """A camera's tracks and its boxes of frames that aren't over yet. The first row of its state has the next
    track's number and the last frame taken in place of a track."""

    def __init__(self, rules: TrackRules):
        self.rules = rules
        super().__init__("frame long, order long, kind string, confidence double, x1 double, y1 double, x2 double, y2 double", TRACK, ["camera", *_NAMES])

    def due(self, row: tuple) -> int:
        return int((row[0] + 1) * self.rules.frame_s * 1000)

    def wakes(self, held: list[tuple]) -> int | None:
        return int((held[0][8] + 2) * self.rules.frame_s * 1000) if len(held) > 1 else None

    def advance(self, held: list[tuple], rows: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple] | None]:
        number, done = (held[0][0], held[0][8]) if held else (self.rules.first_number, None)
        camera = Camera(self.rules, [Track.from_held(r) for r in held[1:]], number, done)
        frames: dict[int, list[Box]] = {}
        for frame, order, kind, confidence, *box in rows:
            frames.setdefault(frame, []).append(Box(order, kind, confidence, tuple(box)))
        made = [r for frame in sorted(frames) for r in camera.to(frame, frames[frame])]
        made += camera.idle(int(watermark // (self.rules.frame_s * 1000)) - 1)
        if not frames and not made:
            return [], None
        head = (camera.number, *[None] * 7, camera.done, *[None] * (len(TRACK.split(", ")) - 9))
        return made, [head, *[t.held() for t in camera.tracks]]


def tracked(stream: DataFrame, rules: TrackRules = TrackRules(), late: str = "1 hour") -> DataFrame:
    """The rows of ``tracked_table`` from a stream of ``detections`` with their time ``ts``, a frame as soon as
    the watermark is past it. The session needs the RocksDB state store."""
    ship_package(stream.sparkSession)
    kind = stream.schema["camera"].dataType.simpleString()
    rows = stream.withWatermark("ts", late)
    return rows.groupBy("camera").transformWithStateInPandas(TrackerState(rules), f"camera {kind}, {ROW}", "Append", "EventTime")
