"""Evidence of noisy keys fused as it arrives: what a track's readings say, after each of them.

A track holds the readings of its newest frames, ``FRAMES`` at most; variants of one frame are one
piece of evidence, a repeat of a variant is a frame of its own. Texts cluster around the first
seen, and a cluster's evidence is kept as a sum that readings add to and evicted frames are
taken from. ``fused_stream`` keeps this as keyed state and takes readings in order of ``seq`` once
the watermark is past them; ``fused_table`` streams each track of a table through the same
steps, so both give the same rows, however the stream falls into batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONFUSED
from ..shipping import ship_package
from .ordered import OrderedRows, dealt_by

# Frames held, edits within a cluster, cost of a confused character, thresholds of the statuses.
FRAMES = 20
TOLERANCE = 2
CONFUSED_COST = 0.5
LEAST_FRAMES, LEAST_SCORE, LEAST_AGREEMENT, LEAST_VALID = 2, 1.2, 0.40, 0.20
FAST_FRAMES, FAST_OCR = 10, 0.85
CONTRADICTORY, LEAST_PENDING = 0.30, 0.15
#: Scores are held as whole parts of one.
UNIT = 10_000

READING = "seq long, frame string, variant string, text string, ocr double, valid double, quality double, ms long"
#: A reading that is held, with the frame that it counts for.
HELD = "seq long, frame string, variant string, text string, ocr double, valid double, quality double, effective string"
ROW = "seq long, key string, status string, confidence double, agreement double, score double, cluster_frames long, frames long, readings long"
_READING = [f.split()[0] for f in READING.split(", ")]
_ROW = [f.split()[0] for f in ROW.split(", ")]
_FOLD = str.maketrans(*CONFUSED)


def half_up(x: float, digits: int) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def distance(a: str, b: str) -> float | None:
    """The edit distance, confusable characters at half cost, if it is within the tolerance.
    Only cells that far from the diagonal are filled."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > TOLERANCE:
        return None
    x, y = a.translate(_FOLD), b.translate(_FOLD)
    far = TOLERANCE + 1.0
    row = {j: float(j) for j in range(min(len(b), TOLERANCE) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - TOLERANCE), min(len(b), i + TOLERANCE) + 1):
            best = row.get(j, far) + 1.0
            if j:
                cost = 0.0 if a[i - 1] == b[j - 1] else CONFUSED_COST if x[i - 1] == y[j - 1] else 1.0
                best = min(best, new.get(j - 1, far) + 1.0, row.get(j - 1, far) + cost)
            new[j] = best
        if min(new.values()) > TOLERANCE:
            return None
        row = new
    last = row.get(len(b), far)
    return last if last <= TOLERANCE else None


def near(a: str, b: str) -> bool:
    return distance(a, b) is not None


@dataclass(slots=True)
class Reading:
    seq: int
    frame: str
    variant: str
    text: str
    ocr: float
    valid: float
    quality: float
    effective: str

    @property
    def score(self) -> int:
        """In ten-thousandths, so that sums are exact."""
        part = lambda x: x if x > 0 else 0.5
        return math.floor(max(0.05, min(1.0, 0.45 * self.ocr + 0.30 * part(self.valid) + 0.25 * part(self.quality))) * UNIT + 0.5)


class Evidence:
    """A track's readings, oldest first, and the score of each of its frames."""

    def __init__(self, readings: list[Reading]):
        self.readings: list[Reading] = []
        self.frames: dict[str, int] = {}
        for r in readings:
            self._hold(r)

    def _hold(self, r: Reading) -> None:
        self.readings.append(r)
        self.frames[r.effective] = r.score  # the last variant's counts for the frame

    def add(self, seq: int, frame: str, variant: str, text: str, ocr: float, valid: float, quality: float) -> None:
        again = sum(r.frame == frame and r.variant == variant for r in self.readings)
        self._hold(Reading(seq, frame, variant, text, ocr, valid, quality, f"{frame}_rep{again}" if again else frame))
        if len(self.frames) > FRAMES:
            oldest = next(iter(self.frames))
            del self.frames[oldest]
            self.readings = [r for r in self.readings if r.effective != oldest]

    def clusters(self) -> list[list[str]]:
        """Texts in order of arrival, each with the first seed that it is near to."""
        out: list[list[str]] = []
        for text in dict.fromkeys(r.text for r in self.readings):
            own = next((c for c in out if near(c[0], text)), None)
            if own is None:
                out.append([text])
            else:
                own.append(text)
        return out

    def fused(self) -> tuple:
        """The row after the last reading, see ``ROW``."""
        of: dict[str, int] = {}
        clusters = self.clusters()
        for k, texts in enumerate(clusters):
            of |= dict.fromkeys(texts, k)
        held: list[dict[str, Reading]] = [{} for _ in clusters]
        for r in self.readings:
            held[of[r.text]].setdefault(r.effective, r)
        sums = [sum(self.frames[f] for f in own) for own in held]
        best = max(range(len(sums)), key=lambda k: sums[k])  # of equal ones the earliest
        score, frames = sums[best], len(held[best])
        top = max(held[best].values(), key=lambda r: r.score)
        own = [r for r in self.readings if of[r.text] == best]
        surest = {t: max(r.score for r in own if r.text == t) for t in clusters[best]}
        text = max(clusters[best], key=surest.__getitem__)
        voted = self._voted(own)
        if len(voted) < max(1, len(text) - 2):
            voted = text
        agreement = half_up(score / max(0.001 * UNIT, sum(self.frames.values())), 3)
        quality = top.quality if top.quality > 0 else 0.5
        confidence = half_up(0.40 * top.ocr + 0.30 * top.valid + 0.20 * agreement + 0.10 * quality, 3)
        agreed = agreement >= LEAST_AGREEMENT and top.valid >= LEAST_VALID
        if agreed and (frames >= LEAST_FRAMES and score >= LEAST_SCORE * UNIT or frames == 1 and len(self.frames) >= FAST_FRAMES and top.ocr >= FAST_OCR):
            status = "CONFIRMED"
        elif len(self.readings) >= FRAMES and agreement < CONTRADICTORY:
            status = "UNKNOWN"
        else:
            status = "PENDING" if score >= LEAST_PENDING * UNIT else "UNKNOWN"
        return (self.readings[-1].seq, "" if status == "UNKNOWN" else voted, status, confidence, agreement, (score + UNIT // 2000) // (UNIT // 1000) / 1000, frames, len(self.frames), len(self.readings))

    def _voted(self, own: list[Reading]) -> str:
        """The length and at each place the character with the most evidence; ties go to the surer frame, then to the earlier."""
        lengths: dict[int, int] = {}
        for r in own:
            lengths[len(r.text)] = lengths.get(len(r.text), 0) + self.frames[r.effective]
        out = []
        for at in range(max(lengths, key=lengths.__getitem__)):
            votes: dict[str, list[int]] = {}
            for r in own:
                if at < len(r.text):
                    v = votes.setdefault(r.text[at], [0, 0])
                    v[0] += self.frames[r.effective]
                    v[1] = max(v[1], self.frames[r.effective])
            if not votes:
                break
            out.append(max(votes, key=votes.__getitem__))
        return "".join(out)


def readings(obs: DataFrame) -> DataFrame:
    """(track_id, seq, frame, variant, text, ocr, valid, quality) of readings with a text; missing measures are 0,
    which validity and quality count as 0.5. Rows without a track or a seq are left out."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c.split("_")[0])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = obs.where("track_id is not null and seq is not null and norm_text <> ''")
    ms = F.unix_millis("ts") if "ts" in obs.columns else F.lit(0).cast("long")
    return rows.select("track_id", F.col("seq").cast("long").alias("seq"), name("frame_id").alias("frame"), name("variant").alias("variant"), F.col("norm_text").alias("text"), number("ocr_conf"), number("valid_conf"), number("quality"), ms.alias("ms"), *(["ts"] if "ts" in obs.columns else []))


def _followed(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["track_id", *_ROW], {"key": pa.string(), "status": pa.string(), "confidence": pa.float64(), "agreement": pa.float64(), "score": pa.float64()}
        track, now, rows, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([("track_id", batch.schema.field("track_id").type), *[(n, kinds.get(n, pa.int64())) for n in _ROW]])
            for r in batch.to_pylist():
                if r["track_id"] != track:
                    if now is not None and not every:
                        rows.append((track, *now.fused()))
                    track, now = r["track_id"], Evidence([])
                now.add(*[r[c] for c in _READING[:-1]])
                if every:
                    rows.append((track, *now.fused()))
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=schema)
                rows = []
        if now is not None and not every:
            rows.append((track, *now.fused()))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=schema)

    return run


def fused_table(found: DataFrame, every: bool = False) -> DataFrame:
    """(track_id, seq, key, status, ...) after the last of each track's ``readings``, or after ``every`` one.

    A track's readings are streamed in order of ``seq``, with its newest frames in memory, so a very long track
    costs time but no memory."""
    ship_package(found.sparkSession)
    kind = found.schema["track_id"].dataType.simpleString()
    dealt = dealt_by(found, "track_id").sortWithinPartitions("track_id", "seq", "frame", "variant", "text")
    return dealt.select("track_id", *_READING).mapInArrow(_followed(every), f"track_id {kind}, {ROW}")


class FusionState(OrderedRows):
    """A track's held readings; forgotten ``forget_s`` after the last one."""

    def __init__(self, forget_s: int):
        self.forget_ms = forget_s * 1000
        super().__init__(READING, HELD + ", ms long", ["track_id", *_ROW])

    def due(self, row: tuple) -> int:
        return row[-1]

    def wakes(self, held: list[tuple]) -> int | None:
        return held[-1][-1] + self.forget_ms if held else None

    def advance(self, held: list[tuple], rows: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple] | None]:
        now, last, made = Evidence([Reading(*r[:8]) for r in held]), held[-1][-1] if held else None, []
        for r in sorted(rows, key=lambda r: (r[-1], *r[:4])):
            if last is not None and r[-1] >= last + self.forget_ms:
                now = Evidence([])
            now.add(*r[:-1])
            last = r[-1]
            made.append(now.fused())
        if last is not None and watermark >= last + self.forget_ms:
            return made, []
        if not rows:
            return made, None
        return made, [(r.seq, r.frame, r.variant, r.text, r.ocr, r.valid, r.quality, r.effective, last) for r in now.readings]


def fused_stream(stream: DataFrame, forget_s: int = 365 * 86400, late: str = "1 hour") -> DataFrame:
    """(track_id, seq, key, status, ...) after every one of a stream of ``readings`` with their time ``ts``, in order of time
    and seq. The session needs the RocksDB state store."""
    ship_package(stream.sparkSession)
    kind = stream.schema["track_id"].dataType.simpleString()
    return stream.withWatermark("ts", late).groupBy("track_id").transformWithStateInPandas(FusionState(forget_s), f"track_id {kind}, {ROW}", "Append", "EventTime")
