"""Keyed state gives the same rows however the stream falls into batches, and drops late rows."""

import time

import pytest
from pyspark.sql import functions as F

from roadweave.streaming import flows

DAY = 86400
# entity, node, seconds
ROWS = [(1, "a", 100), (1, "a", DAY + 5), (2, "b", DAY + 9), (1, "a", 2 * DAY), (2, "b", 2 * DAY + 50), (1, "a", 6 * DAY), (2, "a", 9 * DAY), (3, "c", 9 * DAY + 7), (1, "b", 40 * DAY)]


def stream(spark, folder, batches):
    schema = "event_id long, node_id string, entity_id long, ts timestamp, speed double"
    for n, rows in enumerate(batches):
        made = [(100 * n + i, node, who, at, 50.0) for i, (who, node, at) in enumerate(rows)]
        df = spark.createDataFrame(made, "event_id long, node_id string, entity_id long, at long, speed double")
        df.select("event_id", "node_id", "entity_id", F.timestamp_seconds("at").alias("ts"), "speed").coalesce(1).write.parquet(f"{folder}/{n}")
        time.sleep(1.1)  # file streams go by the files' times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows_of(df):
    return sorted(tuple(str(x) for c, x in zip(df.columns, r, strict=True) if c != "event_id") for r in df.collect())


@pytest.mark.parametrize("flow", [lambda s: flows.incidents(s, DAY), lambda s: flows.liveness(s, DAY), flows.tracks, flows.throttled, flows.recent])
def test_batches_do_not_matter(spark, tmp_path, flow):
    whole = flows.drained(flow(stream(spark, tmp_path / "one", [ROWS])), "append", "one")
    parts = flows.drained(flow(stream(spark, tmp_path / "many", [ROWS[:3], ROWS[3:4], ROWS[4:7], ROWS[7:]])), "append", "many")
    assert rows_of(whole) == rows_of(parts) != []


def test_incidents_open_reinforce_and_resolve(spark, tmp_path):
    got = rows_of(flows.drained(flows.incidents(stream(spark, tmp_path / "i", [ROWS[:4], ROWS[4:]]), DAY), "append", "i"))
    assert [r[2:] for r in got if r[:2] == ("1", "a")] == [("0", "OPENED", "0.5"), ("1", "REINFORCED", "0.55"), ("2", "REINFORCED", "0.6"), ("3", "RESOLVED", "0.6"), ("6", "OPENED", "0.5"), ("7", "RESOLVED", "0.5")]
    assert [r[2:] for r in got if r[:2] == ("1", "b")] == [("40", "OPENED", "0.5")]  # the watermark isn't past its next day


def test_late_rows_are_dropped(spark, tmp_path):
    got = rows_of(flows.drained(flows.liveness(stream(spark, tmp_path / "l", [[(1, "a", 9 * DAY)], [(1, "a", 9 * DAY + 60)], [(7, "a", DAY), (1, "a", 9 * DAY + 90)]]), DAY), "append", "l"))
    assert got == [("1", str(9 * DAY), "LIVE")]


def test_throttle_reasons(spark, tmp_path):
    rows = stream(spark, tmp_path / "t", [[(1, "a", DAY), (1, "a", DAY + 60), (1, "a", DAY + 6 * 3600)]])
    got = flows.drained(flows.throttled(rows, flows.Attempts(sure_size=51.0)), "append", "t").orderBy("event_id").collect()
    assert [(r.read, r.reason) for r in got] == [(True, "NEW"), (False, "TOO_SOON"), (True, "DUE")]
    rows = stream(spark, tmp_path / "u", [[(1, "a", DAY), (1, "a", DAY + 6 * 3600)]])
    assert [r.reason for r in flows.drained(flows.throttled(rows), "append", "u").orderBy("event_id").collect()] == ["NEW", "DUE"]
    rows = stream(spark, tmp_path / "v", [[(1, "a", DAY), (1, "a", DAY + 6 * 3600)]])
    assert [r.reason for r in flows.drained(flows.throttled(rows, flows.Attempts(sure_size=50.0)), "append", "v").orderBy("event_id").collect()] == ["NEW", "CONFIRMED"]


def test_keys_are_taken_by_the_share(spark, tmp_path, monkeypatch):
    """Every key was a call and a state of its own, which took a thousandth of a second and more each; null keys and long ones are told apart in a share."""
    monkeypatch.setattr(flows, "SHARES", 2)
    rows = [(who, "a", at) for who in [None, 0, 2**60, 2**60 + 1, *range(3, 40)] for at in (DAY, 2 * DAY, 5 * DAY)]
    q = flows.incidents(stream(spark, tmp_path / "s", [rows[:60], rows[60:], [(99, "a", 20 * DAY)]]), DAY).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda batch, number: batch.write.parquet(f"{tmp_path}/o/{number}")).start()
    q.awaitTermination()
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 2
    got = spark.read.parquet(f"{tmp_path}/o/*").where("not entity_id <=> 99").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("step", "status"))).alias("x")).collect()
    assert {r.entity_id for r in got} == {r[0] for r in rows} and len(got) == 41
    assert {tuple(map(tuple, r.x)) for r in got} == {((1, "OPENED"), (2, "REINFORCED"), (3, "RESOLVED"), (5, "OPENED"), (6, "RESOLVED"))}
