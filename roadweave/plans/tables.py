"""How the given tables stand for observations, journeys, boxes and roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series, snapshots

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return snapshots.normalise(raw, {"event_type": "node_id", "user_id": "entity_id", "value": "speed"})


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.transitions(observations(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.segment_state(observations(spark, sf_dir), HOUR)


def journeys(spark: SparkSession, sf_dir: str, timeout_s: int = 12 * HOUR) -> DataFrame:
    return series.sessions(observations(spark, sf_dir), timeout_s)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a frame from the lines of an order."""
    li = table(spark, sf_dir, "lineitem")
    x1, y1 = (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double")
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_quantity")).cast("double").alias("x2"), (y1 + 10 + F.col("l_linenumber") * 5).cast("double").alias("y2"))
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("strength"), box.alias("box"))


#: SQL of the same: observations, transitions, hourly states, journeys, boxes.
OBS = """obs AS (SELECT event_id, event_type AS node_id, user_id AS entity_id, ts, epoch_us(ts) // 1000000 AS t, CASE WHEN value > 0 THEN value END AS speed FROM events)"""
TRANS = OBS + """, tr AS (SELECT event_id, entity_id, ts, t, speed, source, node_id AS target, nullif(greatest(0, t - t0), 0) AS travel_time FROM
 (SELECT *, lag(node_id) OVER w AS source, lag(t) OVER w AS t0 FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)) WHERE source IS NOT NULL)"""
STATES = OBS + """, base AS (SELECT t // 3600 * 3600 AS window_start, node_id AS segment_id, count(*) AS n,
 CAST(sum(CASE WHEN speed > 0 THEN CAST(speed AS DECIMAL(18,2)) END) AS DOUBLE) AS total, count(CASE WHEN CAST(speed AS DECIMAL(18,2)) > 0 THEN 1 END) AS moving,
 count(CASE WHEN speed < 5 THEN 1 END) AS q FROM obs GROUP BY ALL),
 sp AS (SELECT *, CASE WHEN moving > 0 THEN total / moving ELSE 60.0 END AS v FROM base),
 st AS (SELECT window_start, segment_id, n AS vehicle_count, floor(v * 10000.0 + 0.5) / 10000.0 AS average_speed,
 floor((n / 3600 * 3600.0) * 100.0 + 0.5) / 100.0 AS flow_rate, floor((n / greatest(0.05, 500.0 / 1000.0)) * 100.0 + 0.5) / 100.0 AS density,
 floor(least(1.0, n * 5.0 / 500.0) * 10000.0 + 0.5) / 10000.0 AS occupancy, q AS queue_length, CAST(q * 7.0 AS DOUBLE) AS queue_m,
 floor((CASE WHEN v <= 0.5 THEN 500.0 / (60.0 / 3.6) * 10 ELSE greatest(500.0 / (60.0 / 3.6), 500.0 / (v / 3.6)) END) * 100.0 + 0.5) / 100.0 AS travel_time,
 floor(greatest(0, least(1, 0.4 * greatest(0, least(1, (n / 0.5) / 200.0)) + 0.4 * greatest(0.0, 1 - v / 60.0) + 0.2 * greatest(0, least(1, q / 10.0)))) * 1000.0 + 0.5) / 1000.0 AS congestion FROM sp)"""
JOURNEYS = OBS + """, j AS (SELECT *, CAST(sum(CASE WHEN t - t0 > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM
 (SELECT *, lag(t) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS t0 FROM obs))"""
BOXES = """bx AS (SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS id, l_returnflag AS kind, l_extendedprice AS strength, CAST(l_partkey % 100 AS DOUBLE) AS x1, CAST(l_suppkey % 100 AS DOUBLE) AS y1,
 CAST(l_partkey % 100 + 20 + l_quantity AS DOUBLE) AS x2, CAST(l_suppkey % 100 + 10 + l_linenumber * 5 AS DOUBLE) AS y2 FROM lineitem)"""
IOU = "(greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
IOU = f"({IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {IOU}))"
