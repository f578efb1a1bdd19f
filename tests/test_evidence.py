"""Fused evidence against plain Python, by golden rows, and as a stream in any batches."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from roadweave.functions import text
from roadweave.operators import fusion
from roadweave.streaming import evidence, flows

SCHEMA = "track_id string, seq long, frame_id long, variant string, norm_text string, ocr_conf double, valid_conf double, quality double, ts timestamp"
SWAP = {"0": "O", "1": "I", "8": "B", "5": "S", "2": "Z"}
SWAP |= {v: k for k, v in SWAP.items()}


def distance(a, b):
    d = [[float(i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost = 0 if a[i - 1] == b[j - 1] else 0.5 if SWAP.get(a[i - 1]) == b[j - 1] else 1
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + cost)
    return d[-1][-1]


def up(x, n=3):
    return math.floor(x * 10**n + 0.5) / 10**n


def last_row(rows):
    """What a track's readings say after the last: the whole history, from the start, one by one."""
    held = []
    for _, frame, variant, t, ocr, valid, quality in rows:
        again = len([h for h in held if h["frame"] == frame and h["variant"] == variant])
        s = up(max(0.05, min(1.0, 0.45 * ocr + 0.30 * (valid or 0.5) + 0.25 * (quality or 0.5))), 4)
        held.append({"frame": frame, "variant": variant, "x": t, "ocr": ocr, "valid": valid, "q": quality or 0.5, "s": s, "f": (frame, again)})
        order = list(dict.fromkeys(h["f"] for h in held))
        if len(order) > 20:
            held = [h for h in held if h["f"] != order[0]]
    of_frame = {h["f"]: h["s"] for h in held}
    seeds, of = [], {}
    for t in dict.fromkeys(h["x"] for h in held):
        near = [s for s in seeds if distance(s, t) <= 2 and abs(len(s) - len(t)) <= 2]
        of[t] = near[0] if near else t
        seeds += [] if near else [t]
    best, score = None, -1.0
    for seed in seeds:
        total = round(sum(of_frame[f] for f in {h["f"] for h in held if of[h["x"]] == seed}), 6)
        if total > score:
            best, score = seed, total
    own = [h for h in held if of[h["x"]] == best]
    firsts = {}
    for h in own:
        firsts.setdefault(h["f"], h)
    top = max(firsts.values(), key=lambda h: h["s"])
    texts = list(dict.fromkeys(h["x"] for h in own))
    text_ = max(texts, key=lambda t: max(h["s"] for h in own if h["x"] == t))
    sizes = {}
    for h in own:
        sizes[len(h["x"])] = round(sizes.get(len(h["x"]), 0) + of_frame[h["f"]], 6)
    voted = ""
    for k in range(max(sizes, key=sizes.get)):
        votes = {}
        for h in own:
            if k < len(h["x"]):
                w, m = votes.get(h["x"][k], (0.0, 0.0))
                votes[h["x"][k]] = (round(w + of_frame[h["f"]], 6), max(m, of_frame[h["f"]]))
        if not votes:
            break
        voted += max(votes, key=votes.get)
    voted = text_ if len(voted) < max(1, len(text_) - 2) else voted
    whole = lambda x: round(x * 10_000)
    agreement = up(whole(score) / max(10, sum(map(whole, of_frame.values()))))
    frames, good = len(firsts), agreement >= 0.4 and top["valid"] >= 0.2
    if good and (frames >= 2 and score >= 1.2 or frames == 1 and len(of_frame) >= 10 and top["ocr"] >= 0.85):
        status = "CONFIRMED"
    elif len(held) >= 20 and agreement < 0.3:
        status = "UNKNOWN"
    else:
        status = "PENDING" if score >= 0.15 else "UNKNOWN"
    confidence = up(0.40 * top["ocr"] + 0.30 * top["valid"] + 0.20 * agreement + 0.10 * top["q"])
    return (rows[-1][0], "" if status == "UNKNOWN" else voted, status, confidence, agreement, (whole(score) + 5) // 10 / 1000, frames, len(of_frame), len(held))


def tracks(seed, n=25):
    """Readings of a few keys with confusions, lost and added characters, variants and repeats of them."""
    rnd = random.Random(seed)
    out = {}
    for k in range(n):
        keys = ["".join(rnd.choice("ABIOSZ012589") for _ in range(rnd.randint(4, 9))) for _ in range(rnd.choice([1, 1, 2, 6]))]
        rows, frame = [], 0
        for seq in range(rnd.choice([1, 3, 12, 45])):
            t = list(rnd.choice(keys))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                at = rnd.randrange(len(t))
                what = rnd.random()
                t = t[:at] + ([] if what < 0.15 and len(t) > 2 else [SWAP.get(t[at], t[at])] if what < 0.7 else [rnd.choice("AX7")] * (1 + (what > 0.9))) + t[at + 1 :]
            frame += rnd.choice([0, 0, 1, 2])
            rows.append((seq, str(frame), rnd.choice(["raw", "raw", "clahe"]), "".join(t), rnd.randint(1, 100) / 100, rnd.choice([0.0, 0.1, 0.5, 0.9]), rnd.choice([0.0, 0.4, 0.8])))
        out[f"t{k}"] = rows
    return out


def table(spark, made, step=60):
    rows = [(t, seq, int(f), *rest) for t, own in made.items() for seq, f, *rest in own]
    df = spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:-1]))
    return df.withColumn("ts", F.timestamp_seconds(86400 + F.col("seq") * step))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("track_id", *evidence._ROW).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table_equals_plain_python(spark, seed):
    made = tracks(seed)
    found = evidence.readings(table(spark, made).repartition(5))
    every = sorted((t, *last_row(own[: k + 1])) for t, own in made.items() for k in range(len(own)))
    assert rows_of(evidence.fused_table(found, every=True)) == every
    assert rows_of(evidence.fused_table(found)) == sorted((t, *last_row(own)) for t, own in made.items())
    assert {r[3] for r in every} == {"CONFIRMED", "PENDING", "UNKNOWN"} and max(r[8] for r in every) == 20


def test_near_is_the_weighted_distance(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("O0I1AB8") for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    for a in words:
        for b in words:
            assert evidence.near(a, b) == (distance(a, b) <= 2 and abs(len(a) - len(b)) <= 2)
    pairs = spark.createDataFrame([(a, b) for a in words[:15] for b in words[:15]], "a string, b string")
    assert all(r.d == distance(r.a, r.b) for r in pairs.select("a", "b", text.confusion_distance("a", "b").alias("d")).collect())


def test_golden_rows(spark):
    """One weak reading is pending, two frames that agree confirm, and so does one sure reading of a long track."""
    rows = [("weak", 1, 1, "raw", "TN01AB1234", 0.60, 0.65, 0.50), ("two", 1, 10, "raw", "KA01MH9999", 0.92, 0.90, 0.80), ("two", 2, 20, "raw", "KA01MH9999", 0.91, 0.92, 0.85), ("same", 1, 5, "raw", "KA01MH9999", 0.92, 0.90, 0.80), ("same", 2, 5, "clahe", "KA01MH9999", 0.92, 0.90, 0.80), ("none", 1, 1, "raw", "", 0.9, 0.9, 0.9), (None, 1, 1, "raw", "X", 0.9, 0.9, 0.9), ("bare", 1, None, None, "AB12", None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:-1]))
    got = {r.track_id: (r.key, r.status, r.cluster_frames) for r in fusion.fused(df).collect()}
    assert got == {"weak": ("TN01AB1234", "PENDING", 1), "two": ("KA01MH9999", "CONFIRMED", 2), "same": ("KA01MH9999", "PENDING", 1), "bare": ("AB12", "PENDING", 1)}
    assert fusion.fused(df.limit(0)).collect() == []


@pytest.mark.parametrize("cuts", [(), (4, 20), (0, 1, 2, 30)])
def test_stream_equals_table(spark, tmp_path, cuts):
    made = tracks(4, 8)
    df = table(spark, made)
    edges = [-1, *cuts, 10**6]
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        df.where((F.col("seq") > a) & (F.col("seq") <= b)).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        time.sleep(1.1)  # file streams go by the files' times
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    with flows.rocksdb(spark):
        got = flows.drained(evidence.fused_stream(evidence.readings(stream), late="5 minutes"), "append", "fusion")
    mark = max(seq for own in made.values() for seq, *_ in own) * 60 - 300
    assert rows_of(got) == sorted((t, *last_row(own[: k + 1])) for t, own in made.items() for k in range(len(own)) if own[k][0] * 60 <= mark)


def test_stream_forgets(spark, tmp_path):
    """A track that is silent for long begins anew."""
    rows = [("t", 0, 1, "raw", "AB1234", 0.9, 0.9, 0.9), ("t", 100, 2, "raw", "AB1234", 0.9, 0.9, 0.9), ("t", 9000, 3, "raw", "AB1234", 0.9, 0.9, 0.9), ("u", 99_999, 4, "raw", "CD1234", 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:-1])).withColumn("ts", F.timestamp_seconds(86400 + F.col("seq")))
    df.coalesce(1).write.parquet(f"{tmp_path}/0")
    with flows.rocksdb(spark):
        got = flows.drained(evidence.fused_stream(evidence.readings(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/*")), 3600, "5 minutes"), "append", "fusion")
    assert [(r.seq, r.status, r.frames) for r in got.orderBy("seq").collect()] == [(0, "PENDING", 1), (100, "CONFIRMED", 2), (9000, "PENDING", 1)]
