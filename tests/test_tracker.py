"""The tracker against plain Python, by golden rows, and as a stream in any batches."""

import math
import time

import pytest
from pyspark.sql import functions as F

from roadweave.plans.stream_queries import TRACKING, boxes_of_sightings
from roadweave.plans.tables import observations
from roadweave.streaming import flows, tracker

SF = "/root/testdata/sf0.001"
NAMES = ["camera", "frame", "track", "status", "kind", "x1", "y1", "x2", "y2", "hits", "missed", "age", "speed", "direction", "returns", "quality"]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def follow(boxes, until, rules):
    """One camera's tracks, frame by frame. boxes: frame -> [(order, kind, confidence, box)]."""
    out, tracks, free = [], [], rules.first_number
    for frame in range(min(boxes), until + 1):
        now = frame * rules.frame_s
        seen = []
        for _, kind, sure, b in sorted(sorted(boxes.get(frame, ())), key=lambda x: -x[2]):
            w, h = b[2] - b[0], b[3] - b[1]
            if w > 0 and h > 0 and w * h >= 100 and max(w, h) / max(1, min(w, h)) <= 5 and not any(k == kind and iou(b, o) >= 0.85 for k, _, o in seen):
                seen.append((kind, sure, b))
        used, hit = set(), {}
        for low, high in ((0.6, 9), (0.2, 0.6)):
            pairs = []
            for i, t in enumerate(tracks):
                for j, (kind, sure, b) in enumerate(seen):
                    if i in hit or j in used or not low <= sure < high:
                        continue
                    a = t["box"]
                    dist = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
                    near = max(0.0, 1 - dist / max(50.0, math.hypot(a[2] - a[0], a[3] - a[1])))
                    x, y = max(1.0, (a[2] - a[0]) * (a[3] - a[1])), max(1.0, (b[2] - b[0]) * (b[3] - b[1]))
                    s = 0.4 * iou(a, b) + 0.25 * near + 0.15 * min(x, y) / max(x, y) + 0.1 * (1 if t["kind"] == kind else 0.5) + 0.1 * sure
                    if s >= 0.3:
                        pairs.append((-s, i, j))
            for _, i, j in sorted(pairs):
                if i not in hit and j not in used:
                    hit[i] = j
                    used.add(j)
        for i, t in enumerate(tracks):
            t["age"] += 1
            if i in hit:
                kind, sure, b = seen[hit[i]]
                a, dt = t["box"], max(0.001, now - t["seen"])
                dx, dy = (b[0] + b[2] - a[0] - a[2]) / 2, (b[1] + b[3] - a[1] - a[3]) / 2
                far = math.hypot(dx, dy)
                k = min(1.0, 1500 / (far / dt)) if far else 1.0
                t["v"], t["speed"] = (round(dx / dt * k, 2), round(dy / dt * k, 2)), round(min(1500.0, far / dt), 2)
                angle = math.degrees(math.atan2(-dy, dx)) % 360
                t["way"] = "STATIONARY" if far < 2 else ["EAST", "NORTHEAST", "NORTH", "NORTHWEST", "WEST", "SOUTHWEST", "SOUTH", "SOUTHEAST", "EAST"][int((angle + 22.5) // 45)]
                t["box"] = tuple(0.7 * n + (1 - 0.7) * o for n, o in zip(b, a, strict=True))
                t["hits"], t["missed"], t["seen"] = t["hits"] + 1, 0, now
                t["votes"][kind] = t["votes"].get(kind, 0) + 1
                t["kind"] = [k for k, n in t["votes"].items() if n == max(t["votes"].values())][0]
                t["returns"] += t["status"] == "LOST"
                t["status"] = "REACTIVATED" if t["status"] == "LOST" else "CONFIRMED" if t["hits"] >= 3 else t["status"]
                t["quality"] = round(min(1.0, 0.5 * t["hits"] / t["age"] + 0.5 * sure), 3)
            else:
                t["missed"] += 1
                t["status"] = "LOST" if t["missed"] <= rules.most_missed else "REMOVED"
                vx, vy = t["v"]
                if vx or vy:
                    k = max(0.033, now - t["seen"]) * min(1.0, 1500 / math.hypot(vx, vy))
                    x, y = max(0.0, t["box"][0] + vx * k), max(0.0, t["box"][1] + vy * k)
                    t["box"] = (x, y, max(x + 1, t["box"][2] + vx * k), max(y + 1, t["box"][3] + vy * k))
        for j, (kind, sure, b) in enumerate(seen):
            if j not in used and sure >= 0.6:
                tracks.append({"n": free, "kind": kind, "box": b, "seen": now, "age": 1, "hits": 1, "missed": 0, "status": "TENTATIVE", "v": (0, 0), "speed": 0.0, "way": "UNKNOWN", "returns": 0, "quality": round(sure, 3), "votes": {kind: 1}})
                free += 1
        for i, a in enumerate(tracks):
            for b in tracks[i + 1 :]:
                if "REMOVED" not in (a["status"], b["status"]) and a["kind"] == b["kind"] and iou(a["box"], b["box"]) >= 0.8:
                    (b if a["hits"] >= b["hits"] else a)["status"] = "REMOVED"
        out += [(frame, t["n"], t["status"], t["kind"], *t["box"], t["hits"], t["missed"], t["age"], t["speed"], t["way"], t["returns"], t["quality"]) for t in tracks]
        tracks = [t for t in tracks if t["status"] != "REMOVED"]
    return out


def rounded(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def wanted(found, until, rules):
    cameras = {}
    for r in found.collect():
        cameras.setdefault(r.camera, {}).setdefault(r.frame, []).append((r.order, r.kind, r.confidence, (r.x1, r.y1, r.x2, r.y2)))
    return rounded([(c, *row) for c, boxes in cameras.items() for row in follow({f: b for f, b in boxes.items() if f <= until}, until, rules)])


def test_table_equals_plain_python(spark):
    found = boxes_of_sightings(observations(spark, SF)).cache()
    until = found.agg(F.max("frame")).first()[0] - 5
    got = rounded(map(tuple, tracker.tracked_table(found, TRACKING, until).select(*NAMES).collect()))
    assert got == wanted(found, until, TRACKING)
    assert {r[3] for r in got} == {"TENTATIVE", "CONFIRMED", "LOST", "REACTIVATED", "REMOVED"}


def test_sessions_number_on(spark):
    """Long silences cut a camera into sessions that are followed side by side."""
    rows = [(1, f, k, "car", 0.9, float(30 * k), 10.0, 30.0 * k + 60, 60.0) for f in (3, 4, 5, 37, 38, 90, 122, 123) for k in range(3)] + [(2, 7, 0, "car", 0.9, 1.0, 1.0, 50.0, 50.0), (1, 5, 9, None, 0.9, 1.0, 1.0, 50.0, 50.0)]
    found = spark.createDataFrame(rows, "camera long, frame long, order long, kind string, confidence double, x1 double, y1 double, x2 double, y2 double").dropna()
    rules = tracker.TrackRules()
    got = rounded(map(tuple, tracker.tracked_table(found, rules, 200).select(*NAMES).collect()))
    assert got == wanted(found, 200, rules)
    assert tracker.tracked_table(found.limit(0)).collect() == []


def test_golden_rows():
    """One box is tentative; four frames that move by two pixels keep one id."""
    camera = tracker.Camera(tracker.TrackRules(frame_s=0.1), number=101)
    said = [*camera.to(1, [tracker.Box(0, "car", 0.9, (100.0, 100.0, 200.0, 200.0))])]
    assert [(r[1], r[2]) for r in said] == [(101, "TENTATIVE")]
    for k in range(2, 5):
        said = [*camera.to(k, [tracker.Box(0, "car", 0.9, (100.0 + 2 * k, 100.0, 200.0 + 2 * k, 200.0))])]
    assert [(r[1], r[2], r[8]) for r in said] == [(101, "CONFIRMED", 4)]
    assert [r[2] for r in camera.idle(4 + 31)] == ["LOST"] * 30 + ["REMOVED"] and camera.tracks == []


def streamed(spark, found, folder, batches):
    schema = found.schema
    for n, part in enumerate(batches):
        found.where(part).coalesce(1).write.parquet(f"{folder}/{n}")
        time.sleep(1.1)  # file streams go by the files' times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("cuts", [(), (5, 9), (2, 3, 10, 20)])
def test_stream_equals_table(spark, tmp_path, cuts):
    found = boxes_of_sightings(observations(spark, SF)).where("camera < 3")
    first = found.agg(F.min("frame")).first()[0]
    day = F.col("frame") - first
    edges = [-1, *[24 * c for c in cuts], 10**6]
    parts = [(day > a) & (day <= b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    with flows.rocksdb(spark):
        got = flows.drained(tracker.tracked(streamed(spark, found, tmp_path, parts), TRACKING), "append", "tracker")
    last = found.agg(F.max(F.unix_millis("ts"))).first()[0]
    until = (last - 3_600_000) // 3_600_000 - 1
    assert rounded(map(tuple, got.select(*NAMES).collect())) == wanted(found, until, TRACKING) != []


def test_cameras_are_dealt_over_all_tasks(spark):
    """A few bytes were joined to one task, and each camera was tracked twice."""
    from roadweave.streaming.ordered import dealt_by

    rows = spark.range(64).withColumnRenamed("id", "camera")
    assert dealt_by(rows, "camera").mapInArrow(lambda batches: batches, "camera long").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    box = "camera long, frame long, order long, kind string, confidence double, x1 double, y1 double, x2 double, y2 double"
    found = spark.createDataFrame([(k, 1, 0, "car", 0.9, 0.0, 0.0, 50.0, 40.0) for k in range(64)], box).withColumn("ts", F.current_timestamp())
    plan = tracker.tracked_table(found)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # what was made is read from a table


def test_waiting_rows_are_packed(spark, tmp_path):
    """Every waiting row was a row of state, which took longer to read than to track; a camera has one for each batch."""
    found = spark.createDataFrame([(c, f, k, "car", 0.9, 0.0, 0.0, 50.0, 40.0) for c in range(3) for f in range(40) for k in range(5)], "camera long, frame long, order long, kind string, confidence double, x1 double, y1 double, x2 double, y2 double").withColumn("ts", F.timestamp_seconds(F.col("frame") * 3600 + 1_700_000_000))
    with flows.rocksdb(spark):
        rows = tracker.tracked(streamed(spark, found, tmp_path / "in", [F.col("frame") < 20, F.col("frame") >= 20]), TRACKING)
        q = rows.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("noop").start()
        q.awaitTermination()
    held = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert 0 < max(held) <= 3 * 10


def test_packed_rows_are_whole():
    import pyarrow as pa
    from roadweave.streaming.ordered import packed, unpacked

    rows = [(1, None, 2.5, [0.5, None]), (2**60 + 1, "é", None, []), (3, "", float("inf"), None)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.float64()), ("d", pa.list_(pa.float64()))])
    assert unpacked(packed(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))) == rows
