"""Snapshots, series and states over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables, text, traffic
from ..operators import series, snapshots, windows
from .tables import HOUR, JOURNEYS, OBS, STATES, TRANS, journeys, observations, states, table, transitions

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TRANS}, base AS (SELECT t // 3600 * 3600 AS window_start, node_id, count(DISTINCT entity_id) AS vehicle_count, CAST(sum(CAST(speed AS DECIMAL(18,2))) AS DOUBLE) / count(speed) AS v FROM obs GROUP BY ALL),
 i AS (SELECT t // 3600 * 3600 AS window_start, target AS node_id, floor((count(*) / 3600 * 3600.0) * 100.0 + 0.5) / 100.0 AS f FROM tr GROUP BY ALL), o AS (SELECT t // 3600 * 3600 AS window_start, source AS node_id, floor((count(*) / 3600 * 3600.0) * 100.0 + 0.5) / 100.0 AS f FROM tr GROUP BY ALL)
 SELECT b.window_start, b.node_id, vehicle_count, floor((vehicle_count / 3600 * 3600.0) * 100.0 + 0.5) / 100.0 AS flow_rate, floor(v * 10000.0 + 0.5) / 10000.0 AS average_speed, i.f AS incoming_flow, o.f AS outgoing_flow
 FROM base b LEFT JOIN i USING (window_start, node_id) LEFT JOIN o USING (window_start, node_id)""")
def d1_node_snapshot(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return snapshots.node_snapshot(obs, snapshots.transitions(obs), HOUR)


@query(f"""WITH {TRANS} SELECT t // 3600 * 3600 AS window_start, source, target, count(DISTINCT entity_id) AS vehicle_count, count(*) AS transition_count, floor(avg(travel_time) * 100.0 + 0.5) / 100.0 AS travel_time,
 median(travel_time) AS median_travel_time, count(*) - count(travel_time) AS gap_count, count(travel_time) AS observed_count, coalesce(bool_or(travel_time IS NULL), false) AS has_gap,
 string_agg(DISTINCT CAST(entity_id AS VARCHAR), ',' ORDER BY CAST(entity_id AS VARCHAR)) AS entities, floor((count(*) / 3600 * 3600.0) * 100.0 + 0.5) / 100.0 AS flow_rate FROM tr GROUP BY ALL""")
def d2_edge_snapshot(spark, sf_dir):
    out = snapshots.edge_snapshot(transitions(spark, sf_dir), HOUR)
    return out.withColumn("entities", F.array_join(F.array_sort(F.split("entities", ",")), ","))


@query(f"WITH {STATES} SELECT *, CASE WHEN congestion < 0.25 THEN 'FREE_FLOW' WHEN congestion < 0.5 THEN 'LIGHT' WHEN congestion < 0.75 THEN 'MODERATE' WHEN congestion < 0.9 THEN 'HEAVY' ELSE 'SEVERE' END AS level FROM st")
def d3_segment_state(spark, sf_dir):
    return states(spark, sf_dir).drop("features")


@query(f"WITH {STATES} SELECT window_start, CAST(sum(vehicle_count) AS BIGINT) AS vehicles, floor(CAST(sum(CAST(average_speed AS DECIMAL(18,4))) AS DOUBLE) / count(*) * 1000.0 + 0.5) / 1000.0 AS mean_speed, floor(CAST(sum(CAST(congestion AS DECIMAL(18,3))) AS DOUBLE) / count(*) * 1000.0 + 0.5) / 1000.0 AS mean_congestion, count(*) AS segments FROM st GROUP BY ALL")
def d5_network_totals(spark, sf_dir):
    return snapshots.network_totals(states(spark, sf_dir))


@query(f"WITH {STATES} SELECT window_start, segment_id, CAST(sum(vehicle_count) AS BIGINT) AS vehicles, CAST(sum(queue_length) AS BIGINT) AS queued, CAST(grouping_id(window_start, segment_id) AS BIGINT) AS level FROM st GROUP BY ROLLUP (window_start, segment_id)")
def d5_totals_rollup(spark, sf_dir):
    return snapshots.totals_rollup(states(spark, sf_dir))


@query(f"WITH {TRANS} SELECT event_id, entity_id, source, target, travel_time FROM tr")
def e1_transitions(spark, sf_dir):
    return transitions(spark, sf_dir).select("event_id", "entity_id", "source", "target", "travel_time")


@query(f"""WITH {OBS} SELECT w * 900 AS window_start, node_id, count(*) AS n FROM (SELECT *, unnest(generate_series((t - 3600) // 900 + 1, t // 900)) AS w FROM obs) WHERE w * 900 >= (SELECT min(t) // 900 * 900 FROM obs) GROUP BY ALL""")
def l3_sliding_windows(spark, sf_dir):
    obs = observations(spark, sf_dir)
    origin = obs.agg((F.floor(F.min(windows.epoch("ts")) / 900) * 900).alias("t0"))
    rows = windows.sliding(obs, HOUR, 900).join(F.broadcast(origin), F.col("window_start") >= F.col("t0"))
    return rows.groupBy("window_start", "node_id").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS} SELECT w * 7200 AS window_start, count(*) AS n FROM (SELECT *, unnest(generate_series(CAST(floor((t - 1800) / 7200) AS BIGINT) + 1, t // 7200)) AS w FROM obs) GROUP BY ALL""")
def q3_windows_with_gaps(spark, sf_dir):
    return windows.sliding(observations(spark, sf_dir), 1800, 7200).groupBy("window_start").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS} SELECT w * 7200 AS window_start, count(*) AS n FROM (SELECT *, unnest(generate_series(CAST(floor((t - 1800) / 7200) AS BIGINT) + 1, t // 7200)) AS w FROM obs) GROUP BY ALL""")
def q3_expand_windows_sql(spark, sf_dir):
    """The same windows by the table function, in SQL."""
    tables.register(spark)
    rows = observations(spark, sf_dir).select(windows.epoch("ts").alias("t"))
    return spark.sql("SELECT window_start, count(*) AS n FROM {obs}, LATERAL expand_windows(t, 1800, 7200, NULL) GROUP BY window_start", obs=rows)


@query(f"""WITH {OBS}, b AS (SELECT min(t) // 3600 AS lo, max(t) // 3600 AS hi FROM obs), s AS (SELECT unnest(generate_series(lo, hi)) * 3600 AS window_start FROM b), n AS (SELECT DISTINCT node_id FROM obs),
 c AS (SELECT t // 3600 * 3600 AS window_start, node_id, count(*) AS k FROM obs GROUP BY ALL) SELECT s.window_start, n.node_id, coalesce(k, 0) AS n FROM s CROSS JOIN n LEFT JOIN c ON c.window_start = s.window_start AND c.node_id = n.node_id""")
def q2_include_empty_windows(spark, sf_dir):
    obs = observations(spark, sf_dir)
    counts = windows.tumbling(obs, HOUR).groupBy("window_start", "node_id").agg(F.count("*").alias("k"))
    return windows.spine(obs, HOUR, ["node_id"]).join(counts, ["window_start", "node_id"], "left").select("window_start", "node_id", F.coalesce("k", F.lit(0)).alias("n"))


@query(f"WITH {OBS} SELECT entity_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS sights, arg_max(node_id, (ts, event_id)) AS last_node, arg_max(speed, (ts, event_id)) AS last_speed FROM obs GROUP BY ALL")
def g8_upsert_nodes(spark, sf_dir):
    return snapshots.upsert_nodes(observations(spark, sf_dir))


@query(f"""WITH {TRANS}, e AS (SELECT source, target, count(*) AS weight, bool_or(travel_time IS NULL) AS has_gap FROM tr GROUP BY ALL), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM (SELECT source AS node FROM tr UNION SELECT target FROM tr))
 SELECT source, target, weight, has_gap, a.i AS source_index, b.i AS target_index FROM e JOIN n a ON a.node = source JOIN n b ON b.node = target""")
def d8_static_adjacency(spark, sf_dir):
    out = snapshots.static_adjacency(snapshots.edge_snapshot(transitions(spark, sf_dir), HOUR))
    return out.select("source", "target", "weight", "has_gap", F.col("source_index").cast("long").alias("source_index"), F.col("target_index").cast("long").alias("target_index"))


@query(f"WITH {JOURNEYS} SELECT entity_id, seq, count(*) AS legs, min(t) AS first_seen, max(t) AS last_seen FROM j GROUP BY ALL")
def e22_journey_timeout(spark, sf_dir):
    return journeys(spark, sf_dir).groupBy("entity_id", "seq").agg(F.count("*").alias("legs"), F.min(windows.epoch("ts")).alias("first_seen"), F.max(windows.epoch("ts")).alias("last_seen"))


@query(f"WITH {STATES}, g AS (SELECT segment_id, window_start, CASE WHEN window_start - lag(window_start) OVER (PARTITION BY segment_id ORDER BY window_start) > 5400 THEN 1 ELSE 0 END AS x FROM st), s AS (SELECT *, CAST(sum(x) OVER (PARTITION BY segment_id ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g) SELECT segment_id, segment, count(*) AS steps, min(window_start) AS since FROM s GROUP BY ALL")
def e3_gap_segmentation(spark, sf_dir):
    return series.gap_segments(states(spark, sf_dir), "window_start", 1.5 * HOUR, ["segment_id"]).groupBy("segment_id", "segment").agg(F.count("*").alias("steps"), F.min("window_start").alias("since"))


@query(f"""WITH {STATES}, h AS (SELECT segment_id, window_start, count(*) OVER w AS have, coalesce(sum(vehicle_count) OVER w, 0) AS total FROM st WINDOW w AS (PARTITION BY segment_id ORDER BY window_start ROWS 11 PRECEDING)) SELECT segment_id, window_start, CAST(72 AS BIGINT) AS n, CAST(total AS BIGINT) AS vehicles, CAST(12 - have AS BIGINT) AS padded FROM h""")
def e4_lag_feature_window(spark, sf_dir):
    rows = series.lag_window(states(spark, sf_dir))
    # feature 0 of each step is flow / 3600 = vehicles / 3600 for hourly windows; padding has speed 0.5 as its third
    flows = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get("history", i * 6))
    total = F.aggregate(flows, F.lit(0.0), lambda s, v: s + v)
    padded = F.size(F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.get("history", i * 6 + 2) == 0.5) & (F.get("history", i * 6) == 0.0)))
    return rows.select("segment_id", "window_start", F.size("history").cast("long").alias("n"), F.round(total * 3600).cast("long").alias("vehicles"), padded.cast("long").alias("padded"))


@query(f"""WITH {STATES}, m AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY window_start) AS i FROM st), q AS (SELECT *, i - row_number() OVER (PARTITION BY segment_id ORDER BY window_start) AS island FROM m WHERE queue_length > 0)
 SELECT segment_id, min(window_start) AS since, max(window_start) AS until, count(*) AS steps FROM q GROUP BY segment_id, island""")
def e17_islands(spark, sf_dir):
    runs = series.islands(states(spark, sf_dir), F.col("queue_length") > 0, ["segment_id"], "window_start")
    return runs.groupBy("segment_id", "island").agg(F.min("window_start").alias("since"), F.max("window_start").alias("until"), F.count("*").alias("steps")).drop("island")


@query(f"""WITH {OBS}, s AS (SELECT entity_id, t - lag(t) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS gap FROM obs), m AS (SELECT entity_id, median(gap) AS usual FROM s WHERE gap IS NOT NULL GROUP BY ALL) SELECT entity_id, count(*) AS breaks FROM s JOIN m USING (entity_id) WHERE gap > 3.0 * usual GROUP BY ALL""")
def e21_discontinuities(spark, sf_dir):
    points = observations(spark, sf_dir).select("entity_id", windows.epoch("ts").alias("t"))
    return series.discontinuities(points, ["entity_id"], "t").where("what = 'GAP'").groupBy("entity_id").agg(F.count("*").alias("breaks"))


@query(f"""WITH {OBS}, w AS (SELECT entity_id, event_id, ts, speed, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS k FROM obs) SELECT entity_id, event_id, speed, k AS place FROM w WHERE k <= 60""")
def e5_bounded_history(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return observations(spark, sf_dir).withColumn("place", k.cast("long")).where("place <= 60").select("entity_id", "event_id", "speed", "place")


@query(f"""WITH {OBS} SELECT a.event_id, (SELECT b.event_id FROM obs b WHERE b.entity_id = a.entity_id AND b.node_id = 'purchase' AND b.t <= a.t AND a.t - b.t <= 86400 ORDER BY b.t DESC, b.event_id DESC LIMIT 1) AS purchase FROM obs a WHERE a.node_id = 'click'""")
def c13_as_of(spark, sf_dir):
    obs = observations(spark, sf_dir).select("entity_id", "node_id", "event_id", windows.epoch("ts").alias("t"))
    bought = obs.where("node_id = 'purchase'").groupBy("entity_id", "t").agg(F.max("event_id").alias("purchase"))
    return series.as_of(obs.where("node_id = 'click'").select("entity_id", "event_id", "t"), bought, ["entity_id"], "t", "purchase", 86400).select("event_id", "purchase")


@query(f"""WITH {OBS}, o AS (SELECT node_id, entity_id, t, speed FROM obs) SELECT node_id, count(*) AS n, count(CASE WHEN speed < 5 THEN 1 END) AS queued, count(DISTINCT entity_id) AS entities, floor(CAST(sum(CAST(speed AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100.0 + 0.5) / 100.0 AS mean_speed FROM o GROUP BY ALL""")
def d4_road_metrics(spark, sf_dir):
    speed = F.col("speed").cast("decimal(18,2)")
    return observations(spark, sf_dir).groupBy("node_id").agg(F.count("*").alias("n"), traffic.queue_count("speed").alias("queued"), F.countDistinct("entity_id").alias("entities"), traffic.half_up(F.sum(speed).cast("double") / F.count("*"), 2).alias("mean_speed"))


KEYS = "keys AS (SELECT DISTINCT user_id, chr(CAST(65 + user_id % 26 AS INTEGER)) || chr(CAST(65 + (user_id * 7) % 26 AS INTEGER)) || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key FROM events)"


def noisy_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.concat(F.chr(65 + F.col("user_id") % 26), F.chr(65 + (F.col("user_id") * 7) % 26), F.lpad(F.col("user_id").cast("string"), 4, "0"))
    return e.select("event_id", "event_type", "user_id", "ts", "value", key.alias("clean")).withColumn("key", F.when(F.col("event_id") % 7 == 0, F.translate("clean", "0", "O")).otherwise(F.col("clean")))


@query(f"""WITH {KEYS}, e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN replace(key, '0', 'O') ELSE key END AS key, key AS clean FROM events JOIN keys USING (user_id))
 SELECT event_id, upper(key) AS key, translate(key, 'OISBZ', '01582') = translate(clean, 'OISBZ', '01582') AS folded_equal, CAST(CASE WHEN event_id % 7 = 0 THEN 0.5 * (length(clean) - length(replace(clean, '0', ''))) ELSE 0 END AS DOUBLE) AS distance FROM e""")
def h6_confusion_distance(spark, sf_dir):
    rows = noisy_keys(spark, sf_dir)
    return rows.select("event_id", text.key("key").alias("key"), (text.folded("key") == text.folded("clean")).alias("folded_equal"), text.confusion_distance("key", "clean").alias("distance"))


@query(f"""WITH {KEYS}, k AS (SELECT user_id, key, length(key) AS n, list_aggregate(list_transform(generate_series(1, CAST(length(key) AS BIGINT)), lambda i: CAST(substr(key, CAST(i AS INTEGER), 1) = substr('AA0100', CAST(i AS INTEGER), 1) AS INTEGER)), 'sum') AS same FROM keys)
 SELECT user_id, key, CASE WHEN key = 'AA0100' THEN 1.0 WHEN substr(key, 1, 2) <> 'AA' THEN least(0.05, 0.1 * (floor(same / greatest(n, 6) * 1000.0 + 0.5) / 1000.0)) ELSE floor(same / greatest(n, 6) * 1000.0 + 0.5) / 1000.0 END AS similarity FROM k""")
def h7_key_similarity(spark, sf_dir):
    rows = noisy_keys(spark, sf_dir).select("user_id", F.col("clean").alias("key")).distinct()
    return rows.select("user_id", "key", text.key_similarity("key", F.lit("AA0100")).alias("similarity"))


@query(f"""WITH {KEYS} SELECT user_id, key, CASE WHEN substr(key, 1, 2) IN ({', '.join(repr(s) for s in text.STATES)}) AND length(key) >= 8 AND regexp_matches(key, '^..[0-9]{{2}}.*[0-9]{{4}}$') THEN 'UNCERTAIN' ELSE 'FORMAT_MISMATCH' END AS status FROM keys""")
def h3_validate(spark, sf_dir):
    rows = noisy_keys(spark, sf_dir).select("user_id", F.col("clean").alias("key")).distinct()
    return rows.select("user_id", "key", text.validate("key")["status"].alias("status"))
