"""Lookups, filters, evaluation, tracks and expressions over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, traffic
from ..functions.traffic import half_up
from ..operators import boxes as boxops
from ..operators import evaluation, graph, lookups, series, windows
from ..sources import annotations
from .tables import BOXES, IOU, JOURNEYS, OBS, STATES, TRANS, boxes, journeys, observations, states, table, transitions

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def timed(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("t", windows.epoch("ts"))


@query("SELECT o_orderkey, (SELECT min(c_custkey) FROM customer WHERE upper(trim(c_name)) = upper(trim('  customer#' || lpad(CAST(o_custkey + o_orderkey % 2 AS VARCHAR), 9, '0') || ' '))) AS c_custkey FROM orders")
def b1_lookup_by_key(spark, sf_dir):
    name = F.concat(F.lit("  customer#"), F.lpad((F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string"), 9, "0"), F.lit(" "))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    found = lookups.first_match(asked, "name", table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", ["c_custkey"])
    return found.select("o_orderkey", "found.c_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(upper(o_orderpriority), 'RING') OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(upper(p_name), 'RING'))")
def b4_substring_search(spark, sf_dir):
    legs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_name")
    return lookups.containing(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), legs, "o_orderkey", "o_orderpriority", "p_name", "ring")


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS completed FROM orders")
def b8_completed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").isin("F", "P").alias("completed"))


@query("""SELECT event_id, CASE WHEN s IN ('OFFLINE', 'ERROR') THEN 'INVALID' WHEN s IN ('STALE', 'RECONNECTING') THEN 'STALE' WHEN value / 100 < 0.5 THEN 'DEGRADED' ELSE 'GOOD' END AS label,
 CASE WHEN value / 100 >= 0.8 THEN 'TRUSTED' WHEN value / 100 >= 0.5 THEN 'SUSPECT' ELSE 'UNTRUSTED' END AS trust FROM (SELECT *, CASE event_id % 6 WHEN 0 THEN 'OFFLINE' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'STALE' WHEN 3 THEN 'RECONNECTING' ELSE 'ONLINE' END AS s FROM events)""")
def b9_h34_quality_and_trust_labels(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("OFFLINE", "ERROR", "STALE", "RECONNECTING", "ONLINE", "ONLINE"))), (F.col("event_id") % 6 + 1).cast("int"))
    share = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", traffic.quality_label(status, share).alias("label"), traffic.trust_label(share).alias("trust"))


@query("""WITH e AS (SELECT *, first_value(event_type) OVER w AS f, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT *, sum(CASE WHEN event_type <> f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id, event_id, event_type FROM d WHERE k = 1 OR (event_type <> f AND n = 1) ORDER BY ts, event_id LIMIT 30""")
def b10_track_sampler(spark, sf_dir):
    return lookups.sampled(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT l_orderkey, l_linenumber, floor((0.25 * l_discount * 10 + 0.2 * 0.5 + 0.2 * least(1.0, l_quantity * 4 * 8 / 1500.0) + 0.15 * CASE WHEN l_quantity * 4 / 8 BETWEEN 1.5 AND 6.0 THEN greatest(0.2, least(1.0, 1 - abs(l_quantity * 4 / 8 - 3.5) / 3.5)) ELSE 0.05 END + 0.1 * 0.5 + 0.1 * 0.5) * 10000.0 + 0.5) / 10000.0 AS quality FROM lineitem""")
def b11_pixel_quality(spark, sf_dir):
    q = traffic.pixel_quality(F.col("l_quantity") * 4, F.lit(8.0), sharp=F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", half_up(q, 4).alias("quality"))


@query(f"WITH {BOXES} SELECT frame, id, least(x2, 120.0) AS x2, least(y2, 110.0) AS y2, x2 <= 120 AND y2 <= 110 AS inside FROM bx")
def b6_b12_clip_and_bounds(spark, sf_dir):
    b, clipped = boxes(spark, sf_dir), geo.clipped(F.col("box"), 120, 110)
    return b.select("frame", "id", clipped["x2"].alias("x2"), clipped["y2"].alias("y2"), (clipped == F.col("box")).alias("inside"))


@query(f"WITH {TRANS} SELECT source, target, count(*) AS n FROM tr WHERE source = 'click' AND target IN ('view', 'error') GROUP BY ALL")
def b14_edge_lookup(spark, sf_dir):
    asked = F.struct("source", "target").isin(F.struct(F.lit("click"), F.lit("view")), F.struct(F.lit("click"), F.lit("error")))
    return transitions(spark, sf_dir).where(asked).groupBy("source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {OBS}, l AS (SELECT entity_id, arg_max(node_id, (ts, event_id)) AS node_id, max(t) AS t FROM obs GROUP BY ALL) SELECT node_id, count(*) AS tracks FROM l WHERE (SELECT max(t) FROM obs) - t <= 86400 GROUP BY ALL")
def b15_active_tracks(spark, sf_dir):
    return lookups.active(timed(spark, sf_dir), "entity_id", "node_id", "t", ["ts", "event_id"], 86400)


@query(f"WITH {OBS} SELECT event_id, entity_id FROM obs WHERE t BETWEEN (SELECT min(t) + 86400 FROM obs) AND (SELECT min(t) + 5 * 86400 FROM obs)")
def b2_time_range(spark, sf_dir):
    rows = timed(spark, sf_dir)
    begin = rows.agg(F.min("t").alias("begin"))  # one row
    return rows.join(F.broadcast(begin), F.col("t").between(F.col("begin") + 86400, F.col("begin") + 5 * 86400)).select("event_id", "entity_id")


@query(f"WITH {BOXES} SELECT frame, id FROM bx b WHERE NOT EXISTS (SELECT 1 FROM bx a WHERE a.frame = b.frame AND a.id < b.id AND a.kind <> b.kind AND {IOU} > 0.6)")
def c7_duplicate_claims(spark, sf_dir):
    """Later claims of another kind that overlap an earlier one by more than .60."""
    b = boxes(spark, sf_dir)
    return boxops.unclaimed(b, ["frame"], "id", "kind", 0.6).select("frame", "id")


@query(f"""WITH {BOXES}, f AS (SELECT bx.*, l_suppkey % 25 AS track, l_suppkey % 20 AS truth FROM bx JOIN lineitem ON frame = l_orderkey AND id = l_linenumber), o AS (SELECT a.track, b.truth, CAST(floor({IOU} * 1000000.0 + 0.5) AS BIGINT) AS score FROM f a JOIN f b ON a.frame = b.frame AND a.kind <> 'N' AND b.kind = 'N'), e AS (SELECT track, truth, count(*) AS hits, CAST(sum(score) AS BIGINT) AS total FROM o WHERE score >= 200000 GROUP BY ALL)
 SELECT track, truth, hits, total FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY hits DESC, total DESC, truth) AS k FROM e) WHERE k = 1""")
def c8_tracks_to_truth(spark, sf_dir):
    own = boxes(spark, sf_dir).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_suppkey") % 25).alias("track"), (F.col("l_suppkey") % 20).alias("truth")), ["frame", "id"])
    said, true = own.where("kind <> 'N'").select("frame", "track", F.col("box").alias("a")), own.where("kind = 'N'").select("frame", "truth", F.col("box").alias("b"))
    pairs = said.join(true, "frame").select("track", "truth", F.floor(geo.iou(F.col("a"), F.col("b")) * 1e6 + 0.5).alias("score")).where("score >= 200000")
    return evaluation.truth_of_tracks(pairs)


@query("""SELECT coalesce(v.k, p.k) AS user_id, CASE WHEN p.k IS NULL THEN 'LEFT' WHEN v.k IS NULL THEN 'RIGHT' ELSE 'BOTH' END AS side FROM (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view') v FULL JOIN (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase') p ON v.k = p.k""")
def c9_truth_split(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluation.split(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")


@query(f"WITH {STATES} SELECT a.segment_id, a.window_start, a.average_speed AS observed, b.average_speed AS forecast, floor((a.average_speed - b.average_speed) * 10000.0 + 0.5) / 10000.0 AS residual FROM st a JOIN st b ON a.segment_id = b.segment_id AND a.window_start = b.window_start + 3600")
def c10_observed_and_forecast(spark, sf_dir):
    st = states(spark, sf_dir)
    said = st.select("segment_id", (F.col("window_start") + 3600).alias("window_start"), F.col("average_speed").alias("forecast"))
    return st.join(said, ["segment_id", "window_start"]).select("segment_id", "window_start", F.col("average_speed").alias("observed"), "forecast", half_up(F.col("average_speed") - F.col("forecast"), 4).alias("residual"))


@query("WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND b.i > a.i AND b.i <= a.i + 5")
def c16_negative_pairs(spark, sf_dir):
    return evaluation.neighbours(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", 5)


@query("SELECT s_suppkey, c_custkey, abs(c_acctbal) / 20 AS distance FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(c_acctbal) / 20 BETWEEN 50 AND 50 + abs(s_acctbal) / 100")
def c19_sensors_in_range(spark, sf_dir):
    seen = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("road"), (F.abs("c_acctbal") / 20).alias("distance"))
    reach = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("road"), F.lit(50.0).alias("low"), (50.0 + F.abs("s_acctbal") / 100).alias("high"))
    return lookups.within(seen, reach, ["road"], "distance", "low", "high").select("s_suppkey", "c_custkey", "distance")


VERDICTS = "v AS (SELECT doc_id, source, n_chars, CASE WHEN quality IS NULL THEN 'UNCLEAR' WHEN (n_chars >= 600) = (quality = 1) THEN 'CORRECT' ELSE 'WRONG' END AS verdict FROM documents LEFT JOIN labels USING (doc_id))"


def verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    truth = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"))
    return docs.join(truth, "doc_id", "left").withColumn("verdict", evaluation.verdict(F.col("n_chars") >= 600, F.col("truth")))


@query(f"WITH {VERDICTS} SELECT doc_id, verdict FROM v")
def c20_label_attach(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", "verdict")


@query(f"WITH {VERDICTS} SELECT source, verdict, count(*) AS n FROM v GROUP BY ALL")
def d37_review_counts(spark, sf_dir):
    return verdicts(spark, sf_dir).groupBy("source", "verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {VERDICTS}, c AS (SELECT source, count(CASE WHEN verdict = 'CORRECT' THEN 1 END) AS correct, count(CASE WHEN verdict = 'WRONG' THEN 1 END) AS wrong, count(CASE WHEN verdict = 'UNCLEAR' THEN 1 END) AS unclear, count(*) AS n, CAST(sum(n_chars) AS DOUBLE) AS s FROM v GROUP BY ALL)
 SELECT source, correct, wrong, unclear, floor(coalesce(correct / nullif(correct + wrong, 0), 0.0) * 10000.0 + 0.5) / 10000.0 AS accuracy, floor(correct / n * 10000.0 + 0.5) / 10000.0 AS pass_rate, floor(s / n * 10000.0 + 0.5) / 10000.0 AS mean_confidence FROM c""")
def d12_verification_metrics(spark, sf_dir):
    return evaluation.verification(verdicts(spark, sf_dir), ["source"], confidence="n_chars")


@query(f"WITH {STATES} SELECT 'OBS_' || segment_id || '_' || CAST(window_start * 1000 AS VARCHAR) AS id, segment_id, strftime(make_timestamp(window_start * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS begins, window_start + 3600 AS ends, vehicle_count, average_speed, congestion, CASE WHEN vehicle_count >= 8 THEN 'TRUSTED' WHEN vehicle_count >= 5 THEN 'SUSPECT' ELSE 'UNTRUSTED' END AS trust FROM st")
def d6_h10_master_record(spark, sf_dir):
    begins = F.date_format(F.timestamp_seconds("window_start"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.concat_ws("_", F.lit("OBS"), "segment_id", (F.col("window_start") * 1000).cast("string"))
    return states(spark, sf_dir).select(name.alias("id"), "segment_id", begins.alias("begins"), (F.col("window_start") + 3600).alias("ends"), "vehicle_count", "average_speed", "congestion", traffic.trust_label(F.col("vehicle_count") / 10).alias("trust"))


@query(f"WITH {OBS}, g AS (SELECT entity_id, t - lag(t) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS gap FROM obs) SELECT entity_id, count(*) AS points, count(CASE WHEN gap > 43200 THEN 1 END) AS reactivations, count(CASE WHEN gap > 86400 THEN 1 END) AS lost, floor(coalesce(sum(gap) / nullif(count(gap), 0), 0.0) * 100.0 + 0.5) / 100.0 AS mean_gap FROM g GROUP BY ALL")
def d11_tracker_statistics(spark, sf_dir):
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("entity_id").orderBy("ts", "event_id"))
    rows = timed(spark, sf_dir).withColumn("gap", gap)
    mean = F.coalesce(F.try_divide(F.sum("gap"), F.count("gap")), F.lit(0.0))
    return rows.groupBy("entity_id").agg(F.count("*").alias("points"), F.count_if(F.col("gap") > 43200).alias("reactivations"), F.count_if(F.col("gap") > 86400).alias("lost"), half_up(mean, 2).alias("mean_gap"))


@query(f"WITH {JOURNEYS}, s AS (SELECT entity_id, seq, count(DISTINCT node_id) AS k, count(CASE WHEN event_id % 7 = 0 THEN 1 END) AS bad FROM j GROUP BY ALL) SELECT entity_id, count(CASE WHEN k > 1 THEN 1 END) AS truth, count(CASE WHEN k > 1 AND bad = 0 THEN 1 END) AS correct FROM s GROUP BY ALL")
def d15_journey_accuracy(spark, sf_dir):
    own = journeys(spark, sf_dir).groupBy("entity_id", "seq").agg(F.countDistinct("node_id").alias("k"), F.count_if(F.col("event_id") % 7 == 0).alias("bad"))
    return own.groupBy("entity_id").agg(F.count_if(F.col("k") > 1).alias("truth"), F.count_if((F.col("k") > 1) & (F.col("bad") == 0)).alias("correct"))


@query("SELECT user_id, coalesce(bool_or(value > 200), false) AS high, coalesce(bool_or(event_id % 3 > 0), false) AS ids, coalesce(bool_or(CAST(json_extract_string(props, '$.k') AS BIGINT) > 95), false) AS props FROM events GROUP BY ALL")
def d16_signal_availability(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return evaluation.available(table(spark, sf_dir, "events"), ["user_id"], {"high": F.col("value") - 200, "ids": F.col("event_id") % 3, "props": k - 95})


@query(f"WITH {TRANS}, m AS (SELECT source, target, count(*) AS n, sum(travel_time) / count(travel_time) AS mean, min(travel_time) AS best FROM tr WHERE travel_time IS NOT NULL GROUP BY ALL) SELECT source, target, n, floor((mean - best) * 100.0 + 0.5) / 100.0 AS avoided, floor((mean - best) / greatest(1.0, mean) * 100.0 * 100.0 + 0.5) / 100.0 AS speedup FROM m")
def d23_routing_metrics(spark, sf_dir):
    own = transitions(spark, sf_dir).where("travel_time is not null").groupBy("source", "target").agg(F.count("*").alias("n"), (F.sum("travel_time") / F.count("*")).alias("mean"), F.min("travel_time").alias("best"))
    gain = F.col("mean") - F.col("best")
    return own.select("source", "target", "n", half_up(gain, 2).alias("avoided"), half_up(gain / F.greatest(F.lit(1.0), F.col("mean")) * 100.0, 2).alias("speedup"))


@query("WITH e AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM e) WHERE k = 1")
def d24_dominant_class(spark, sf_dir):
    return evaluation.dominant(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("WITH e AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS s FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || CAST(s AS VARCHAR), ',' ORDER BY event_type) AS history FROM e GROUP BY ALL")
def d27_candidate_history(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("s"))
    history = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "s"))))
    said = F.transform(F.map_entries("history"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return own.groupBy("user_id").agg(history.alias("history")).select("user_id", F.array_join(said, ",").alias("history"))


@query("SELECT event_type AS stage, count(*) AS n, max(value) AS slowest, floor(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*) * 100.0 + 0.5) / 100.0 AS mean_ms, floor(1000.0 * count(*) / CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS fps FROM events GROUP BY ALL")
def d29_stage_latency(spark, sf_dir):
    total = F.sum(F.col("value").cast("decimal(12,2)")).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.max("value").alias("slowest"), half_up(total / F.count("*"), 2).alias("mean_ms"), half_up(1000.0 * F.count("*") / total, 2).alias("fps"))


@query("SELECT l_linestatus AS line, l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)")
def d30_line_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup(F.col("l_linestatus").alias("line"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {TRANS} SELECT 'node' AS what, event_type AS kind, count(DISTINCT user_id) AS n FROM events GROUP BY ALL UNION ALL SELECT 'edge', source || '>' || target, count(*) FROM tr GROUP BY ALL")
def d32_graph_type_counts(spark, sf_dir):
    nodes = observations(spark, sf_dir).groupBy(F.col("node_id").alias("kind")).agg(F.countDistinct("entity_id").alias("n"))
    edges = transitions(spark, sf_dir).groupBy(F.concat_ws(">", "source", "target").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.select(F.lit("node").alias("what"), "kind", "n").unionByName(edges.select(F.lit("edge").alias("what"), "kind", "n"))


@query(f"WITH {STATES} SELECT segment_id, window_start, CAST(queue_length * 6.5 AS DOUBLE) AS queue_m, floor(vehicle_count / 40 * 100.0 * 100.0 + 0.5) / 100.0 AS occupancy, floor(least(1.0, 0.6::DOUBLE * greatest(0.0, 1 - average_speed / 60.0) + 0.4::DOUBLE * vehicle_count / 40 + CASE WHEN average_speed < 20 THEN 0.5::DOUBLE * 0.6::DOUBLE ELSE 0.0 END) * 1000.0 + 0.5) / 1000.0 AS congestion FROM st")
def d35_alternative_road_state(spark, sf_dir):
    blocked = F.when(F.col("average_speed") < 20, 0.6).otherwise(0.0)
    return states(spark, sf_dir).select("segment_id", "window_start", (F.col("queue_length") * 6.5).alias("queue_m"), half_up(F.col("vehicle_count") / 40 * 100.0, 2).alias("occupancy"), half_up(traffic.road_congestion("average_speed", 60.0, "vehicle_count", 40, blocked), 3).alias("congestion"))


@query(f"WITH {STATES}, n AS (SELECT window_start, count(*) AS roads, CAST(sum(vehicle_count) AS BIGINT) AS vehicles, CAST(sum(CAST(congestion AS DECIMAL(8,3))) AS DOUBLE) / count(*) AS c FROM st GROUP BY ALL) SELECT window_start, roads, vehicles, floor(c * 10000.0 + 0.5) / 10000.0 AS congestion, CASE WHEN c < 0.25 THEN 'LOW' WHEN c < 0.5 THEN 'MEDIUM' WHEN c < 0.75 THEN 'HIGH' ELSE 'SEVERE' END AS level FROM n")
def d36_network_averages(spark, sf_dir):
    mean = F.sum(F.col("congestion").cast("decimal(8,3)")).cast("double") / F.count("*")
    own = states(spark, sf_dir).groupBy("window_start").agg(F.count("*").alias("roads"), F.sum("vehicle_count").alias("vehicles"), mean.alias("c"))
    return own.select("window_start", "roads", "vehicles", half_up("c", 4).alias("congestion"), traffic.four_levels("c").alias("level"))


@query(f"WITH {OBS}, m AS (SELECT event_id, speed, t, lag(speed) OVER w AS s0, lag(t) OVER w AS t0 FROM obs WHERE speed IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY t, event_id)), v AS (SELECT *, CASE WHEN t - t0 >= 0.01 THEN greatest(-0.05, least(0.05, (speed - s0) / (t - t0))) ELSE 0.0 END AS vx FROM m) SELECT event_id, floor(vx * 1000000.0 + 0.5) / 1000000.0 AS vx, CASE WHEN t0 IS NULL THEN 'UNKNOWN' WHEN speed > s0 THEN 'UP' WHEN speed < s0 THEN 'DOWN' ELSE 'STAY' END AS way FROM v")
def e8_motion(spark, sf_dir):
    """Velocity along one axis, capped, and its direction."""
    rows = timed(spark, sf_dir).where("speed is not null")
    w = Window.partitionBy("entity_id").orderBy("t", "event_id")
    dt, dx = F.col("t") - F.lag("t").over(w), F.col("speed") - F.lag("speed").over(w)
    vx = F.when(dt >= 0.01, traffic.clip(dx / dt, -0.05, 0.05)).otherwise(0.0)
    return rows.select("event_id", half_up(vx, 6).alias("vx"), F.when(dt.isNull(), "UNKNOWN").when(dx > 0, "UP").when(dx < 0, "DOWN").otherwise("STAY").alias("way"))


@query(f"WITH {OBS}, l AS (SELECT event_id, first_value(t) OVER w AS t0, first_value(speed) OVER w AS s0, t, speed FROM obs WHERE speed IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY t, event_id ROWS 4 PRECEDING)) SELECT event_id, CASE WHEN t > t0 THEN floor(least(200.0, abs(speed - s0) * 1000.0 / (t - t0) * 3.6) * 10000.0 + 0.5) / 10000.0 END AS kmh FROM l")
def e9_windowed_speed(spark, sf_dir):
    rows = timed(spark, sf_dir).where("speed is not null")
    w = Window.partitionBy("entity_id").orderBy("t", "event_id").rowsBetween(-4, 0)
    return rows.select("event_id", series.windowed_speed(F.first("t").over(w), F.first("speed").over(w) * 1000.0, F.col("t"), F.col("speed") * 1000.0).alias("kmh"))


@query(f"WITH {OBS}, h AS (SELECT event_id, count(speed) OVER w AS hits, row_number() OVER w AS age, coalesce(speed, 0) / 500 AS c FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)) SELECT event_id, floor((0.5 * hits / age + 0.5 * c) * 10000.0 + 0.5) / 10000.0 AS quality FROM h")
def e20_track_quality(spark, sf_dir):
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    hits = F.count("speed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    quality = 0.5 * hits / F.row_number().over(w) + 0.5 * (F.coalesce("speed", F.lit(0.0)) / 500)
    return observations(spark, sf_dir).select("event_id", half_up(quality, 4).alias("quality"))


@query("WITH p AS (SELECT DISTINCT l_partkey % 50 AS road, l_extendedprice AS pos FROM lineitem), g AS (SELECT *, lead(pos) OVER (PARTITION BY road ORDER BY pos) - pos AS ahead FROM p) SELECT l_orderkey, l_linenumber, floor(ahead * 100.0 + 0.5) / 100.0 AS ahead FROM lineitem JOIN g ON road = l_partkey % 50 AND pos = l_extendedprice")
def e24_distance_ahead(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("road"), F.col("l_extendedprice").alias("pos"))
    return lookups.ahead(rows, ["road"], "pos").select("l_orderkey", "l_linenumber", half_up("ahead", 2).alias("ahead"))


@query(f"WITH {STATES} SELECT segment_id, window_start, average_speed AS x0, coalesce(lag(average_speed, 1) OVER w, first_value(average_speed) OVER w) AS x1, coalesce(lag(average_speed, 5) OVER w, first_value(average_speed) OVER w) AS x5 FROM st WINDOW w AS (PARTITION BY segment_id ORDER BY window_start)")
def e25_padded_history(spark, sf_dir):
    w = Window.partitionBy("segment_id").orderBy("window_start")
    past = lambda k: F.coalesce(F.lag("average_speed", k).over(w), F.first("average_speed").over(w)).alias(f"x{k}")
    return states(spark, sf_dir).select("segment_id", "window_start", past(0), past(1), past(5))


@query("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS entity, c_nationkey AS node, c_mktsegment AS kind, c_acctbal AS value FROM customer UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_nationkey, NULL, s_acctbal FROM supplier")
def g1_union_of_sources(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), F.col("c_nationkey").alias("node"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("value"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_nationkey").alias("node"), F.col("s_acctbal").alias("value"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT DISTINCT user_id, event_type FROM events WHERE value <= 100 EXCEPT SELECT user_id, event_type FROM events WHERE value > 100")
def g5_resolved(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("value <= 100").select("user_id", "event_type").subtract(e.where("value > 100").select("user_id", "event_type"))


@query("""SELECT c_custkey, floor(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(c_acctbal / 200 - c_nationkey) / 2), 2) + cos(radians(c_nationkey)) * cos(radians(c_acctbal / 200)) * pow(sin(radians(c_custkey % 90 - 10) / 2), 2)))) * 10.0 + 0.5) / 10.0 AS metres FROM customer""")
def h21_haversine(spark, sf_dir):
    lat = F.col("c_nationkey").cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", half_up(geo.haversine(lat, F.lit(10.0), F.col("c_acctbal") / 200, (F.col("c_custkey") % 90).cast("double")), 1).alias("metres"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice AS p FROM lineitem) SELECT l_orderkey, l_linenumber, floor((greatest(1.0, q) + 300.0 * d + 2 * t + p / 1000.0 + CASE WHEN l_linenumber = 7 THEN 300.0 ELSE 0.0 END) * 10000.0 + 0.5) / 10000.0 AS cost, floor(greatest(0.0, least(1.0, 1 - t * 100 / greatest(1.0, q))) * 10000.0 + 0.5) / 10000.0 AS confidence,
 floor(p * 0.9 * 100.0 + 0.5) / 100.0 AS lower, floor(p * 1.1 * 100.0 + 0.5) / 100.0 AS upper, floor((p * 1.1 - p * 0.9) / 3.92 * 100.0 + 0.5) / 100.0 AS std FROM x""")
def h27_h29_j10_costs_and_spreads(spark, sf_dir):
    price = F.col("l_extendedprice")
    spread = traffic.single_forecast_spread(price)
    cost = traffic.road_cost("l_quantity", "l_discount", "l_tax", price, F.col("l_linenumber") == 7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", half_up(cost, 4).alias("cost"), half_up(traffic.variation_confidence("l_quantity", F.col("l_tax") * 100), 4).alias("confidence"), *[half_up(spread[x], 2).alias(x) for x in ("lower", "upper", "std")])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN w <> 0 THEN floor((2.0 * a + 0.5 * b + 3.0) / w * 10000.0 + 0.5) / 10000.0 ELSE a END AS x, CASE WHEN w <> 0 THEN floor((0.1 * a + 1.5 * b - 2.0) / w * 10000.0 + 0.5) / 10000.0 ELSE b END AS y FROM (SELECT *, l_quantity AS a, l_extendedprice / 100 AS b, 0.25 * l_quantity - 5.0 AS w FROM lineitem)")
def h12_projection(spark, sf_dir):
    x, y = geo.project("a", "b", [2.0, 0.5, 3.0, 0.1, 1.5, -2.0, 0.25, 0.0, -5.0])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 100).alias("b"))
    flat = 0.25 * F.col("a") - 5.0 == 0
    return rows.select("l_orderkey", "l_linenumber", F.when(flat, x).otherwise(half_up(x, 4)).alias("x"), F.when(flat, y).otherwise(half_up(y, 4)).alias("y"))


@query(f"WITH {OBS} SELECT 'v' || CAST(entity_id AS VARCHAR) AS source, node_id AS target, 'OBSERVED_AT' AS type, t AS at FROM obs UNION ALL SELECT node_id, 'v' || CAST(entity_id AS VARCHAR), 'OBSERVED', t FROM obs UNION ALL SELECT node_id, 'hour' || CAST(t // 3600 AS VARCHAR), 'DURING', t FROM obs")
def i2_observation_edges(spark, sf_dir):
    own, hour = F.concat(F.lit("v"), F.col("entity_id").cast("string")), F.concat(F.lit("hour"), F.floor(F.col("t") / 3600).cast("string"))
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"), F.col("t").alias("at"))
    three = F.array(edge(own, F.col("node_id"), "OBSERVED_AT"), edge(F.col("node_id"), own, "OBSERVED"), edge(F.col("node_id"), hour, "DURING"))
    return timed(spark, sf_dir).select(F.explode(three).alias("e")).select("e.*")


@query(f"WITH {TRANS}, k AS (SELECT source, target, entity_id, count(*) AS evidence, max(t) AS last_seen, arg_max(speed, (ts, event_id)) AS speed FROM tr WHERE speed IS NOT NULL GROUP BY ALL) SELECT * FROM k")
def i3_journey_edges(spark, sf_dir):
    rows = transitions(spark, sf_dir).where("speed is not null")
    return rows.groupBy("source", "target", "entity_id").agg(F.count("*").alias("evidence"), F.max(windows.epoch("ts")).alias("last_seen"), F.max_by("speed", F.struct("ts", "event_id")).alias("speed"))


@query(f"WITH {OBS} SELECT node_id, count(*) AS n, min(t) AS first_seen, max(t) AS last_seen, arg_max(entity_id, (ts, event_id)) AS last_value FROM obs WHERE t <= 1704500000 GROUP BY ALL")
def i4_state_at(spark, sf_dir):
    return lookups.state_at(timed(spark, sf_dir), "node_id", "t", 1_704_500_000, ["ts", "event_id"], "entity_id")


@query(f"WITH {TRANS}, e AS (SELECT source, target, count(*) AS n, max((t, event_id, travel_time)) AS l FROM tr WHERE travel_time IS NOT NULL GROUP BY ALL), b AS (SELECT source, target, n, l FROM e UNION ALL SELECT target, source, n, l FROM e WHERE source <> target) SELECT source, target, max(n) AS n, max(l)[3] AS last_time FROM b GROUP BY ALL")
def i15_symmetric_evidence(spark, sf_dir):
    own = transitions(spark, sf_dir).where("travel_time is not null").groupBy("source", "target").agg(F.count("*").alias("n"), F.max(F.struct(windows.epoch("ts").alias("t"), "event_id", "travel_time")).alias("l"))
    return graph.symmetric(own).select("source", "target", "n", F.col("l.travel_time").alias("last_time"))


@query(f"WITH {STATES} SELECT segment_id, window_start, greatest(5.0, floor(average_speed * (1 - 0.5 * congestion) * 10000.0 + 0.5) / 10000.0) AS speed, CAST(floor(0.1 * density + 0.5) AS BIGINT) AS queue FROM st")
def j14_derived_forecast(spark, sf_dir):
    speed = F.greatest(F.lit(5.0), half_up(F.col("average_speed") * (1 - 0.5 * F.col("congestion")), 4))
    return states(spark, sf_dir).select("segment_id", "window_start", speed.alias("speed"), F.floor(0.1 * F.col("density") + 0.5).alias("queue"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY entity_id, coalesce(speed, 999) <= 40 ORDER BY t, event_id) AS g, coalesce(speed, 999) <= 40 AS slow FROM obs), s AS (SELECT entity_id, g, count(*) AS points, min(t) AS since, max(t) AS until, arg_max(node_id, (t, event_id)) AS node_id FROM r WHERE slow GROUP BY ALL HAVING count(*) >= 2 AND max(t) - min(t) >= 30), n AS (SELECT node_id, count(DISTINCT entity_id) AS stopped, min(since) AS since FROM s GROUP BY ALL)
 SELECT node_id, stopped, since, CASE WHEN stopped >= 3 THEN 'BLOCKAGE' ELSE 'STOPPED_VEHICLE' END AS type, CASE WHEN stopped >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, floor(least(1.0, 0.75 + 0.05 * stopped) * 100.0 + 0.5) / 100.0 AS confidence FROM n""")
def k5_stopped_and_blockage(spark, sf_dir):
    return series.blockages(timed(spark, sf_dir).withColumn("speed", F.coalesce("speed", F.lit(999.0))), "entity_id", "node_id", ["t", "event_id"], "t", most_kmh=40, least_points=2)


@query(f"WITH {STATES}, r AS (SELECT CASE window_start // 3600 % 3 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'REACTIVE' ELSE 'PREDICTIVE' END AS controller, travel_time, queue_length FROM st), m AS (SELECT controller, count(*) AS n, CAST(sum(CAST(travel_time AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS delay, CAST(max(queue_length) AS BIGINT) AS longest_queue FROM r GROUP BY ALL) SELECT controller, n, floor(delay * 1000.0 + 0.5) / 1000.0 AS delay, longest_queue, floor(((SELECT delay FROM m WHERE controller = 'FIXED') - delay) / (SELECT delay FROM m WHERE controller = 'FIXED') * 100.0 * 100.0 + 0.5) / 100.0 AS gain FROM m")
def k9_controller_comparison(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("FIXED"), F.lit("REACTIVE"), F.lit("PREDICTIVE")), (F.floor(F.col("window_start") / 3600) % 3 + 1).cast("int"))
    delay = F.sum(F.col("travel_time").cast("decimal(12,2)")).cast("double") / F.count("*")
    own = states(spark, sf_dir).groupBy(kind.alias("controller")).agg(F.count("*").alias("n"), delay.alias("d"), F.max("queue_length").alias("longest_queue"))
    fixed = own.where("controller = 'FIXED'").select(F.col("d").alias("f"))  # one row
    return own.join(F.broadcast(fixed), F.lit(True)).select("controller", "n", half_up("d", 3).alias("delay"), "longest_queue", half_up((F.col("f") - F.col("d")) / F.col("f") * 100.0, 2).alias("gain"))


@query("""WITH s AS (SELECT user_id, event_id, value AS x, CAST(event_id % 100 AS DOUBLE) AS y, lag(value) OVER w AS x0, CAST(lag(event_id) OVER w % 100 AS DOUBLE) AS y0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 h AS (SELECT *, 'v' AS line FROM s WHERE (x0 - 50) * (x - 50) < 0 UNION ALL SELECT *, 'h' FROM s WHERE (y0 - 40.5) * (y - 40.5) < 0)
 SELECT user_id, line, event_id, CASE WHEN abs(x - x0) >= abs(y - y0) THEN CASE WHEN x >= x0 THEN 'EAST' ELSE 'WEST' END WHEN y >= y0 THEN 'SOUTH' ELSE 'NORTH' END AS way FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line ORDER BY event_id) AS k FROM h) WHERE k = 1""")
def c11_e12_line_crossings(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    lines = spark.createDataFrame([("v", 50.0, -1.0, 50.0, 101.0), ("h", -1.0, 40.5, 100000.0, 40.5)], "line string, px double, py double, qx double, qy double")
    return boxops.first_crossings(points, lines, ["user_id"], "event_id").select("user_id", "line", "event_id", "way")


POLYGON = ((10.0, 10.0), (80.0, 20.5), (60.5, 90.0), (20.0, 70.5))
INSIDE = " + ".join(f"CASE WHEN ({py} > y) <> ({qy} > y) AND x < {px} + ({qx - px}) * (y - {py}) / ({qy - py}) THEN 1 ELSE 0 END" for (px, py), (qx, qy) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))


@query(f"SELECT l_orderkey, l_linenumber, ({INSIDE}) % 2 = 1 AS inside FROM (SELECT *, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y FROM lineitem)")
def b7_points_in_polygon(spark, sf_dir):
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POLYGON])
    inside = geo.in_polygon((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"), corners)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", inside.alias("inside"))


@query(f"WITH {OBS}, n AS (SELECT node_id, count(*) AS seen, count(DISTINCT entity_id) AS entities, max(t) AS last_seen FROM obs GROUP BY ALL) SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i, seen, entities, last_seen FROM n")
def i9_node_features(spark, sf_dir):
    """Features of the nodes with their places in the order of their ids; nodes are a short list."""
    own = timed(spark, sf_dir).groupBy("node_id").agg(F.count("*").alias("seen"), F.countDistinct("entity_id").alias("entities"), F.max("t").alias("last_seen"))
    return own.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("long").alias("i"), "seen", "entities", "last_seen")


@query(f"WITH {OBS}, v AS (SELECT entity_id AS vehicle, coalesce(arg_max(coalesce(speed, 0), (ts, event_id)), 0.0) AS speed, CASE WHEN entity_id % 2 = 0 THEN 1.0 ELSE 2.0 END AS kind, CAST(count(*) AS DOUBLE) AS seen FROM obs GROUP BY entity_id) SELECT vehicle, row_number() OVER (ORDER BY vehicle) - 1 AS i, CAST(speed AS DOUBLE) AS speed, CAST(kind AS DOUBLE) AS kind, seen FROM v")
def i9_vehicle_features(spark, sf_dir):
    """Features of vehicles by their places: last speed, kind, sightings."""
    own = vehicles_seen(spark, sf_dir)
    return graph.indexed(own, "vehicle").select("vehicle", "i", "speed", "kind", "seen")


def vehicles_seen(spark, sf_dir):
    last = F.max_by(F.coalesce("speed", F.lit(0.0)), F.struct("ts", "event_id"))
    return observations(spark, sf_dir).groupBy(F.col("entity_id").alias("vehicle")).agg(last.alias("speed"), F.count("*").cast("double").alias("seen")).withColumn("kind", F.when(F.col("vehicle") % 2 == 0, 1.0).otherwise(2.0))


@query(f"WITH {STATES}, l AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY window_start DESC) AS k FROM st) SELECT segment_id, row_number() OVER (ORDER BY segment_id) - 1 AS i, CAST(vehicle_count AS DOUBLE) AS vehicle_count, density, average_speed, CAST(queue_length AS DOUBLE) AS queue_length, CAST(100 AS DOUBLE) AS capacity, congestion FROM l WHERE k = 1")
def i9_road_features(spark, sf_dir):
    """Features of roads by their places, from each one's last hour; a capacity that isn't known is 100."""
    names = ("vehicle_count", "density", "average_speed", "queue_length")
    last = states(spark, sf_dir).groupBy("segment_id").agg(F.max_by(F.struct(*names, "congestion"), "window_start").alias("s"))
    return graph.indexed(last, "segment_id").select("segment_id", "i", *[F.col(f"s.{n}").cast("double").alias(n) for n in names], F.lit(100.0).alias("capacity"), "s.congestion")


@query(f"WITH {OBS}, v AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS i FROM (SELECT DISTINCT entity_id FROM obs)), c AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS i FROM (SELECT DISTINCT node_id FROM obs)) SELECT DISTINCT v.i AS source_i, c.i AS target_i FROM obs JOIN v USING (entity_id) JOIN c USING (node_id)")
def i9_observed_by(spark, sf_dir):
    """Which vehicle was seen by which camera, as pairs of their places."""
    obs = observations(spark, sf_dir)
    placed = lambda c: graph.indexed(obs.select(F.col(c).alias("key")).distinct(), "key")
    return graph.edge_index(obs, "entity_id", "node_id", placed("entity_id"), placed("node_id"))


#: Vehicles, and vehicles of a single frame, of one file of ground truth by the ranges of their ids: files become more, not longer.
FILE_VEHICLES, FILE_FRAMES = 200, 20_000


def ground_truth(spark, sf_dir):
    """Every entity as a vehicle with a plate, or one in five without; its sightings are its frames."""
    who, event = F.col("user_id"), F.col("event_id")
    plate = F.when(who % 5 != 0, F.concat(F.lit("TN"), F.lpad((who % 100).cast("string"), 2, "0"), F.lit("AB"), F.lpad(who.cast("string"), 4, "0")))
    return table(spark, sf_dir, "events").select(who.alias("who"), plate.alias("plate"), event.alias("frame"), (event % 900).alias("x"), (event % 500).alias("y"), (F.lit(40) + event % 30).alias("w"))


#: What stands in the files; frames in order of their numbers.
TRUTH = """v AS (SELECT user_id AS who, CASE WHEN user_id % 5 <> 0 THEN 'TN' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || 'AB' || lpad(CAST(user_id AS VARCHAR), 4, '0') END AS plate, event_id AS frame, event_id % 900 AS x, event_id % 500 AS y, 40 + event_id % 30 AS w FROM events)"""
SAID = "CASE WHEN plate IS NULL THEN 'CAM_V' || who ELSE plate END AS vehicle_gt_id, CAST(who AS VARCHAR) AS raw_id, coalesce(plate, '') AS raw_plate"


@query(f"""WITH {TRUTH} SELECT {SAID}, CASE WHEN who % 4 = 0 THEN 'motorcycle' ELSE 'car' END AS vehicle_type, who % 4 = 0 AS motorcycle, who % 7 = 0 AS discard, 'A & "B" <' || who AS model, CAST(count(*) AS INTEGER) AS observation_count, CAST(min(frame) AS INTEGER) AS min_frame, CAST(max(frame) AS INTEGER) AS max_frame, CAST(sum(x + y + w + 20) AS DOUBLE) AS plate_sides, CAST(sum(x + y + 5 * w + 100) AS DOUBLE) AS vehicle_sides FROM v GROUP BY who, plate
 UNION ALL SELECT coalesce(plate, 'CAM_V' || frame), CAST(frame AS VARCHAR), coalesce(plate, ''), 'car', false, false, '', 1, CAST(frame AS INTEGER), CAST(frame AS INTEGER), CAST(x + y + w + 20 AS DOUBLE), NULL FROM v WHERE frame % 10 = 0""")
def a5_ground_truth_xml(spark, sf_dir):
    """The given tables rendered in both XML forms, and read back."""
    rows = ground_truth(spark, sf_dir)
    box = lambda x, y, w, h, names: dict(zip(names, (x, y, w, h), strict=True))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    full, short = ("x", "y", "width", "height"), ("x1", "y1", "w", "h")
    odd = F.col("frame") % 2 == 1
    inner = F.when(odd, F.concat(annotations.element("plate", box(x, y, w, F.lit(20), full)), annotations.element("vehicle", box(x, y, 5 * w, F.lit(100), full)))).otherwise(F.concat(annotations.element("plate_bbox", box(x, y, w, F.lit(20), short)), annotations.element("bbox", box(x, y, 5 * w, F.lit(100), short))))
    frames = rows.select("who", "plate", annotations.element("frame", {"number": F.when(odd, F.col("frame")), "id": F.when(~odd, F.col("frame"))}, inner).alias("xml"))
    who = F.col("who")
    facts = [F.when(F.col("plate").isNotNull(), F.concat(F.lit("<plate>"), F.col("plate"), F.lit("</plate>"))).otherwise(""), annotations.element("motorcycle", {}, (who % 4 == 0).cast("int").cast("string")), annotations.element("model", {}, F.concat(F.lit("A &amp; &quot;B&quot; &lt;"), who))]
    one = frames.groupBy("who", "plate").agg(F.concat_ws("", F.collect_list("xml")).alias("xml")).select(F.lit("vehicles").alias("root"), F.floor(who / FILE_VEHICLES).alias("file"), annotations.element("vehicle", {"id": who, "discard": F.when(who % 7 == 0, "true")}, F.concat(*facts, F.col("xml"))).alias("value"))
    other = rows.where("frame % 10 = 0").select(F.lit("GroundTruthRoot").alias("root"), F.floor(F.col("frame") / FILE_FRAMES).alias("file"), annotations.element("vehicle", {"iframe": F.col("frame"), "placa": F.col("plate")}, annotations.element("region", box(x, y, w, F.lit(20), full))).alias("value"))
    folder = graph.shared_path(spark, "truth")
    document = F.concat(F.lit("<"), "root", F.lit(">\n"), F.concat_ws("\n", F.collect_list("value")), F.lit("\n</"), "root", F.lit(">"))
    files = one.unionByName(other).groupBy("root", "file").agg(document.alias("value"))
    files.repartition("root", "file").write.option("maxRecordsPerFile", 1).partitionBy("root", "file").text(folder)  # one document a file
    return sides_of(annotations.xml_vehicles(spark, f"{folder}/*/*", "CAM")[0])


def sides_of(vehicles):
    total = lambda name: F.aggregate("observations", F.lit(0.0), lambda s, o: s + F.aggregate(o[name], F.lit(0.0), lambda t, v: t + v))
    return vehicles.select("vehicle_gt_id", "raw_id", "raw_plate", "vehicle_type", "motorcycle", "discard", "model", "observation_count", "min_frame", "max_frame", total("plate_box").alias("plate_sides"), total("vehicle_box").alias("vehicle_sides"))


@query(f"WITH {TRUTH} SELECT {SAID}, 'car' AS vehicle_type, who % 4 = 0 AS motorcycle, who % 7 = 0 AS discard, 'A & \"B\" <' || who AS model, CAST(count(*) AS INTEGER) AS observation_count, CAST(min(frame) AS INTEGER) AS min_frame, CAST(max(frame) AS INTEGER) AS max_frame, CAST(sum(x + y + w + 20) AS DOUBLE) AS plate_sides, CAST(sum(x + y + 5 * w + 100) AS DOUBLE) AS vehicle_sides FROM v WHERE who % 3 <> 0 GROUP BY who, plate")
def a5_ground_truth_json(spark, sf_dir):
    """The given tables rendered as JSON lists, and read back; a third of the vehicles is another camera's."""
    rows = ground_truth(spark, sf_dir)
    x, y, w = (F.col(c).cast("double") for c in ("x", "y", "w"))
    seen = F.struct("frame", F.array(x, y, w, F.lit(20.0)).alias("plate_bbox"), F.array(x, y, 5 * w, F.lit(100.0)).alias("bbox"))
    who = F.col("who")
    items = rows.groupBy("who", "plate").agg(F.collect_list(seen).alias("frames"))
    item = F.struct(F.when(who % 2 == 0, who).alias("id"), F.when(who % 2 == 1, who).alias("vehicle_id"), F.col("plate"), (who % 4 == 0).alias("motorcycle"), (who % 7 == 0).alias("discard"), F.concat(F.lit('A & "B" <'), who).alias("model"), F.when(who % 3 == 0, "OTHER").when(who % 3 == 1, "CAM_EAST").alias("camera_id"), "frames")
    some = items.groupBy(F.floor(who / FILE_VEHICLES).alias("file")).agg(F.to_json(F.struct(F.collect_list(item).alias("vehicles"))).alias("value")).select("value")
    folder = graph.shared_path(spark, "truth")
    some.write.option("maxRecordsPerFile", 1).text(folder)  # one document a file
    return sides_of(annotations.json_vehicles(spark, folder, "CAM")[0])
