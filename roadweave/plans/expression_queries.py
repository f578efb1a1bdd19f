"""Readers' mappings, key functions, formulas and track smoothing over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import match, text, traffic
from ..functions.traffic import half_up
from ..operators import fusion, graph, series
from ..sources import files, registry
from .tables import BOXES, OBS, TRANS, boxes, observations, table, transitions

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rounded(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


CLEAN = "CASE WHEN isnan({0}) OR {0} < 0 THEN NULL ELSE {0} END"
MATRIX = f"""m AS (SELECT event_id AS step, event_type AS node, {rounded(CLEAN.format("s"), 2)} AS speed, {rounded(CLEAN.format("f"), 2)} AS flow, c FROM
 (SELECT *, CASE event_id % 11 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN -1.0 ELSE value END AS s, CASE event_id % 7 WHEN 0 THEN -2.0 ELSE value * 3 END AS f, CASE WHEN event_id % 2 = 0 THEN event_id % 50 END AS c FROM events))"""


def matrix(spark, sf_dir):
    n = F.col("event_id")
    speed = F.when(n % 11 == 0, float("nan")).when(n % 11 == 1, -1.0).otherwise(F.col("value"))
    flow = F.when(n % 7 == 0, -2.0).otherwise(F.col("value") * 3)
    return table(spark, sf_dir, "events").select(n.alias("step"), F.col("event_type").alias("node"), speed.alias("speed"), flow.alias("flow"), F.when(n % 2 == 0, n % 50).alias("count"))


@query(f"""WITH {MATRIX}, ed AS (SELECT source, target, 100.0 * length(source) + length(target) AS w FROM (SELECT DISTINCT event_type AS source FROM events), (SELECT DISTINCT event_type AS target FROM events) WHERE source < target)
 SELECT step, node, target, speed, flow, coalesce(c, CAST(floor(flow * 0.25 + 0.5) AS BIGINT)) AS count, CASE WHEN speed > 5 THEN {rounded("w / (speed / 3.6)")} END AS travel_time FROM m LEFT JOIN ed ON node = source""")
def a2_matrix_snapshots(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    pairs = kinds.select(F.col("event_type").alias("source")).join(kinds.select(F.col("event_type").alias("target")), F.col("source") < F.col("target"))
    edges = pairs.withColumn("w", 100.0 * F.length("source") + F.length("target"))
    return files.matrix_snapshots(matrix(spark, sf_dir), edges, hours=0.25)


@query(f"""SELECT step, sensor, {rounded("f", 2)} AS flow, {rounded("o * 100", 2)} AS density, {rounded("s", 2)} AS speed, {rounded("CASE WHEN s <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (1 - s / 65.0) * 100)) END", 2)} AS congestion FROM
 (SELECT event_id AS step, event_type AS sensor, value AS f, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 1000 END AS o, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0.0 ELSE value END AS s FROM events)""")
def a3_detector_states(spark, sf_dir):
    n = F.col("event_id")
    occupied = F.when(n % 7 == 0, float("nan")).otherwise(F.col("value") / 1000)
    speed = F.when(n % 11 == 0, float("nan")).when(n % 11 == 1, -1.0).when(n % 11 == 2, 0.0).otherwise(F.col("value"))
    return files.detector_states(table(spark, sf_dir, "events").select(n.alias("step"), F.col("event_type").alias("sensor"), F.col("value").alias("flow"), occupied.alias("occupancy"), speed.alias("speed")))


@query("""SELECT user_id AS track_id, event_id AS seq, 'VALID_OBSERVATION' AS event FROM events WHERE event_type <> 'purchase' UNION ALL
 SELECT track_id, seq, 'PLATE_CONFIRMED' FROM (SELECT user_id AS track_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1""")
def a7_audit_events(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "CONFIRMED").otherwise("VALID")
    return files.audit_events(table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"))).drop("ts")


@query("SELECT event_id, epoch_us(ts) + CASE WHEN event_type = 'view' THEN 0 ELSE 1500000 - 250000 * length(event_type) END AS us FROM events")
def a11_clock_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("camera_id"), F.col("ts").cast("timestamp").alias("ts"))
    cameras = rows.select("camera_id").distinct().where("camera_id <> 'view'").withColumn("offset_s", 1.5 - 0.25 * F.length("camera_id"))
    return files.aligned(rows, cameras).select("event_id", F.unix_micros("ts").alias("us"))


@query("""SELECT l_orderkey, l_linenumber, x AS x1, y AS y1, x + greatest(1.0, w) AS x2, y + greatest(1.0, h) AS y2, CASE k WHEN 0 THEN 'ambulance' WHEN 1 THEN 'motorcycle' WHEN 2 THEN 'car' ELSE 'bus' END AS class_name FROM
 (SELECT *, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, CAST(l_quantity - 10 AS DOUBLE) AS w, CAST(l_linenumber - 2 AS DOUBLE) AS h, l_orderkey % 4 AS k FROM lineitem)""")
def a13_detections(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Emergency", "motorbike", "CAR", "bus"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    size = {"x": F.col("l_partkey") % 100, "y": F.col("l_suppkey") % 100, "w": F.col("l_quantity") - 10, "h": F.col("l_linenumber") - 2}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("class_name"), *[v.cast("double").alias(k) for k, v in size.items()])
    return files.detections(rows).select("l_orderkey", "l_linenumber", "box.*", "class_name")


@query("""SELECT c_custkey, upper(trim(a)) = upper(trim(b)) OR starts_with(upper(trim(b)), upper(trim(a)) || '_') OR starts_with(upper(trim(a)), upper(trim(b)) || '_') AS same FROM
 (SELECT c_custkey, c_mktsegment AS a, lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN '_' || c_nationkey WHEN 1 THEN CAST(c_nationkey AS VARCHAR) ELSE ' ' END AS b FROM customer)""")
def b3_camera_alias(spark, sf_dir):
    nation, k = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 3
    other = F.concat(F.lower("c_mktsegment"), F.when(k == 0, F.concat(F.lit("_"), nation)).when(k == 1, nation).otherwise(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias_of("c_mktsegment", other).alias("same"))


@query("""SELECT event_id, t AS trust, CASE WHEN coalesce(t, 0) >= 0.8 THEN 'TRUSTED' WHEN coalesce(t, 0) >= 0.5 THEN 'SUSPECT' ELSE 'UNTRUSTED' END AS trust_label, 'OBSERVED' AS provenance FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN length(event_type) / 8.0 END AS t FROM events)""")
def c15_trust_enrichment(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    known = rows.select("event_type").distinct().where("event_type <> 'view'").withColumn("trust", F.length("event_type") / 8.0)
    return registry.with_trust(rows, known, "event_type").drop("event_type")


@query("""WITH v AS (SELECT user_id, t AS text, max(c) + 0.005 * (count(*) - 1) AS score, max(c) AS conf, count(*) AS votes FROM (SELECT user_id, substr(event_type, 1, CAST(3 + event_id % 5 AS BIGINT)) AS t, value / 1000 AS c FROM events) GROUP BY ALL),
 b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, votes DESC, text DESC) = 1),
 l AS (SELECT v.user_id, v.text, v.score FROM v JOIN b ON v.user_id = b.user_id AND length(v.text) > length(b.text) AND v.conf >= b.conf - 0.10 AND regexp_matches(v.text, array_to_string(string_split(b.text, ''), '.*')) QUALIFY row_number() OVER (PARTITION BY v.user_id ORDER BY length(v.text) DESC, v.score DESC, v.text DESC) = 1)
 SELECT b.user_id, coalesce(l.text, b.text) AS text, coalesce(l.score, b.score) AS score FROM b LEFT JOIN l ON b.user_id = l.user_id""")
def d25_h8_variant_consensus(spark, sf_dir):
    part = F.substring(F.col("event_type"), F.lit(1), (F.col("event_id") % 5 + 3).cast("int"))
    return fusion.variant_consensus(table(spark, sf_dir, "events").select("user_id", part.alias("norm_text"), (F.col("value") / 1000).alias("ocr_conf")), ["user_id"])


@query(f"""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
 SELECT b.event_id, {rounded("sum(a.value * pow(0.3, b.k - a.k) * CASE WHEN a.k = 1 THEN 1.0 ELSE 0.7 END) + 1e-9")} AS smoothed FROM e b JOIN e a ON a.user_id = b.user_id AND a.k <= b.k GROUP BY b.event_id""")
def e10_smoothing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    return series.smoothed(rows, ["user_id"], "at", "value").select("event_id", half_up(F.col("smoothed") + 1e-9, 4).alias("smoothed"))


@query(f"""WITH {BOXES} SELECT frame, id, {rounded("a")} AS x1, {rounded("b")} AS y1, {rounded("greatest(a + 1, greatest(0.0, x2 + vx * s))")} AS x2, {rounded("greatest(b + 1, greatest(0.0, y2 + vy * s))")} AS y2 FROM
 (SELECT *, greatest(0.0, x1 + vx * s) AS a, greatest(0.0, y1 + vy * s) AS b FROM (SELECT *, frame % 41 - 20 AS vx, frame % 61 - 30 AS vy, id * 0.5 AS s FROM bx))""")
def e11_extrapolated_boxes(spark, sf_dir):
    moved = series.extrapolated(F.col("box"), F.col("frame") % 41 - 20, F.col("frame") % 61 - 30, F.col("id") * 0.5)
    side = moved.alias("m")
    return boxes(spark, sf_dir).select("frame", "id", side).select("frame", "id", *[half_up(F.col(f"m.{s}"), 4).alias(s) for s in ("x1", "y1", "x2", "y2")])


@query("""WITH o AS (SELECT user_id AS track_id, epoch_us(ts) // 86400000000 AS frame_id, event_type AS variant, event_id AS seq FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame_id, variant ORDER BY seq) AS n FROM o),
 f AS (SELECT *, frame_id || CASE WHEN n = 1 THEN '' ELSE '_rep' || (n - 1) END AS effective_frame FROM r), g AS (SELECT *, min(seq) OVER (PARTITION BY track_id, effective_frame) AS first FROM f)
 SELECT track_id, seq, effective_frame FROM g QUALIFY dense_rank() OVER (PARTITION BY track_id ORDER BY first DESC, effective_frame) <= 20""")
def e13_e14_effective_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("frame_id"), F.col("event_type").alias("variant"), F.col("event_id").alias("seq"))
    return series.repeated_frames(rows).select("track_id", "seq", "effective_frame")


@query(f"WITH {OBS}, f AS (SELECT entity_id, node_id, min((ts, event_id)) AS first FROM obs GROUP BY ALL) SELECT entity_id, string_agg(node_id, ',' ORDER BY first) AS nodes FROM f GROUP BY ALL")
def g6_distinct_in_order(spark, sf_dir):
    out = series.distinct_in_order(observations(spark, sf_dir), ["entity_id"], "node_id", ["ts", "event_id"])
    return out.select("entity_id", F.array_join("node_id", ",").alias("nodes"))


@query("SELECT c_custkey, k AS key, CAST(levenshtein(k, 'CUSTOMER' || c_mktsegment) AS INTEGER) AS distance FROM (SELECT *, trim(regexp_replace(upper(c_name || ' - ' || c_nationkey), '[ -]', '', 'g')) AS k FROM customer)")
def h1_h5_key_and_edits(spark, sf_dir):
    key = text.key(F.concat_ws(" - ", "c_name", F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), F.levenshtein(key, F.concat(F.lit("CUSTOMER"), "c_mktsegment")).alias("distance"))


def _short(t: str) -> str:
    return f"CASE WHEN length(t) >= 7 AND length({t}) BETWEEN 5 AND 6 AND regexp_full_match({t}, '[A-Z]{{2,3}}[0-9]+') THEN ',' || {t} ELSE '' END"


@query(f"SELECT c_custkey, t || {_short('substr(t, 2, 20)')} || {_short('substr(t, 3, 20)')} AS candidates FROM (SELECT c_custkey, substr(c_mktsegment, 1, CAST(c_custkey % 5 AS BIGINT)) || 'KA' || (100 + c_nationkey * 41) AS t FROM customer)")
def h4_prefix_strip(spark, sf_dir):
    t = F.concat(F.substring(F.col("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 5).cast("int")), F.lit("KA"), (F.col("c_nationkey") * 41 + 100).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.strip_candidates(t), ",").alias("candidates"))


@query("""WITH m AS (SELECT user_id, event_type AS t, event_id % 7 + 1 AS s FROM events), sz AS (SELECT user_id, length(t) AS n FROM m GROUP BY user_id, length(t) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(s) DESC, length(t) DESC) = 1),
 ch AS (SELECT user_id, i, substr(t, i, 1) AS c, s FROM (SELECT m.user_id, t, s, unnest(range(1, length(t) + 1)) AS i FROM m JOIN sz ON m.user_id = sz.user_id AND length(t) = n)),
 b AS (SELECT user_id, i, c FROM ch GROUP BY user_id, i, c QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY sum(s) DESC, max(s) DESC, c DESC) = 1) SELECT user_id, string_agg(c, '' ORDER BY i) AS voted FROM b GROUP BY ALL""")
def h9_character_vote(spark, sf_dir):
    return fusion.voted(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("norm_text"), (F.col("event_id") % 7 + 1).alias("score")), ["user_id"])


@query(f"""SELECT *, CASE WHEN score < 0.25 THEN 'FREE_FLOW' WHEN score < 0.50 THEN 'LIGHT' WHEN score < 0.75 THEN 'MODERATE' WHEN score < 0.90 THEN 'HEAVY' ELSE 'SEVERE' END AS level,
 {rounded("flow / 3600.0 + 10 * (density / 200.0) + 100 * (v / 120.0) + 1000 * occupancy + 10000 * (q / 20.0) + 100000 * score", 3)} AS vector FROM (SELECT l_orderkey, l_linenumber, v, n // 2 AS q, {rounded("CASE WHEN n > 0 THEN n / s * 3600.0 ELSE 0.0 END")} AS flow, {rounded("n / greatest(0.05, len / 1000.0)")} AS density, {rounded("least(1.0, n * 5.0 / (len * 2))")} AS occupancy,
 {rounded("CASE WHEN v <= 0.5 THEN len / (60 / 3.6) * 10 ELSE greatest(len / (60 / 3.6), len / (greatest(v, 0.1) / 3.6)) END")} AS travel_time,
 {rounded("0.4 * greatest(0.0, least(1.0, (n / greatest(0.05, len / 1000.0)) / 200.0)) + 0.4 * greatest(0.0, 1 - v / 60.0) + 0.2 * least(1.0, (n // 2) / 20.0)", 3)} AS score
 FROM (SELECT *, CAST(l_quantity AS BIGINT) AS n, 60 * l_linenumber AS s, 30 + l_partkey % 2000 AS len, l_suppkey % 130 AS v FROM lineitem))""")
def h13_h20_traffic_formulas(spark, sf_dir):
    n, v = F.col("l_quantity").cast("long"), F.col("l_suppkey") % 130
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), n.alias("n"), F.floor(n / 2).alias("q"), (F.col("l_linenumber") * 60).alias("s"), (F.col("l_partkey") % 2000 + 30).alias("len"))
    dense = traffic.density("n", "len")
    seconds = traffic.travel_time("len", F.when(F.col("v") > 0, F.col("v")).otherwise(0.1), 60)
    out = rows.select("l_orderkey", "l_linenumber", "v", "q", half_up(traffic.flow("n", "s"), 4).alias("flow"), half_up(dense, 4).alias("density"), half_up(traffic.occupancy("n", "len", 2), 4).alias("occupancy"), half_up(seconds, 4).alias("travel_time"), traffic.congestion_score(dense, 200, "v", 60, "q", 20).alias("score"))
    parts = traffic.feature_vector("flow", "density", "v", "occupancy", "q", 20, "score")
    weighed = F.aggregate(F.transform(parts, lambda x, i: x * F.pow(F.lit(10.0), i)), F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("level", traffic.congestion_level("score")).withColumn("vector", half_up(weighed, 3))


@query(f"""SELECT a.vec_id, {rounded("CASE WHEN len(a.e) <> len(b.e) THEN 0.5 WHEN list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)))) END", 6)} AS cosine
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def h23_cosine(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    following = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return own.join(following, "vec_id").select("vec_id", half_up(match.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


#: Directions by number, the last unknown.
DIRECTIONS = ("NORTH", "EAST", "SOUTH", "WEST", "NORTHEAST", "SOUTHEAST", "SOUTHWEST", "NORTHWEST", "UNKNOWN")
_DIRS = "[" + ", ".join(f"'{d}'" for d in DIRECTIONS) + "]"
_OPPOSITE = "(a || '-' || b) IN (" + ", ".join(f"'{x}-{y}'" for x, y in match.OPPOSITE.items()) + ")"


@query(f"""SELECT l_orderkey, l_linenumber, {rounded("greatest(0.0, least(1.0, (0.6 * least(w1 / h1, w2 / h2) / greatest(w1 / h1, w2 / h2) + 0.4 * greatest(0.0, 1 - abs(abs(w1 - h1) / (w1 + h1) - abs(w2 - h2) / (w2 + h2)))) * CASE WHEN l_linenumber % 3 <> 0 AND l_returnflag <> 'A' THEN 0.35 ELSE 1.0 END))", 3)} AS shape,
 CAST(CASE WHEN a = 'UNKNOWN' OR b = 'UNKNOWN' THEN 0.5 WHEN a = b THEN 1.0 WHEN {_OPPOSITE} THEN 0.1 ELSE 0.6 END AS DOUBLE) AS direction FROM
 (SELECT *, greatest(1.0, CAST(l_quantity AS DOUBLE)) AS w1, CAST(l_linenumber * 5 AS DOUBLE) AS h1, greatest(1.0, CAST(l_suppkey % 60 AS DOUBLE)) AS w2, greatest(1.0, CAST(l_partkey % 40 AS DOUBLE)) AS h2, {_DIRS}[CAST(l_orderkey % 9 + 1 AS BIGINT)] AS a, {_DIRS}[CAST(l_partkey % 9 + 1 AS BIGINT)] AS b FROM lineitem)""")
def h24_h25_shape_and_direction(spark, sf_dir):
    way = lambda x: F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.col(x) % 9 + 1).cast("int"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "unknown").otherwise("a")
    shape = match.shape_similarity("l_quantity", F.col("l_linenumber") * 5, "l_returnflag", F.col("l_suppkey") % 60, F.col("l_partkey") % 40, kind)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shape.alias("shape"), match.direction_similarity(way("l_orderkey"), way("l_partkey")).alias("direction"))


@query(f"""SELECT l_orderkey, l_linenumber, {rounded("greatest(0.0, q - 1.960 * d)")} AS lower, {rounded("q + 1.960 * d")} AS upper, {rounded("greatest(0.05, least(1.0, 0.45 * (CAST(l_discount AS DOUBLE) * 10) + 0.30 * (CAST(l_tax AS DOUBLE) * 10) + 0.25 * CASE WHEN l_linenumber = 1 THEN 0.5 ELSE q / 50 END))")} AS evidence
 FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) * 100 AS d FROM lineitem)""")
def h28_h31_interval_and_evidence(spark, sf_dir):
    q, tax = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")
    bounds = traffic.interval(q, tax * 100)
    sure = text.evidence_score(F.col("l_discount").cast("double") * 10, tax * 10, F.when(F.col("l_linenumber") != 1, q / 50))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", half_up(bounds["lower"], 4).alias("lower"), half_up(bounds["upper"], 4).alias("upper"), half_up(sure, 4).alias("evidence"))


@query(f"""SELECT l_orderkey, l_linenumber, {rounded("u + 0.5 * u * g + 10.0 * u / greatest(1.0, served + u) + CASE WHEN ns <> (l_linenumber % 2 = 0) THEN 25.0 ELSE 0.0 END + CASE WHEN blocked THEN 1000.0 ELSE 0.0 END - CASE WHEN helped THEN 1000.0 ELSE 0.0 END")} AS cost FROM
 (SELECT *, CASE WHEN ns THEN qe + greatest(0.0, pe) ELSE qn + greatest(0.0, pn) END AS u, CASE WHEN ns THEN qn ELSE qe END AS served, CASE WHEN ns THEN en ELSE ee END AS helped, CASE WHEN ns THEN ee ELSE en END AS blocked FROM
 (SELECT *, l_orderkey % 2 = 0 AS ns, CAST(l_quantity AS DOUBLE) AS qn, CAST(l_suppkey % 30 AS DOUBLE) AS qe, l_partkey % 20 - 5 AS pn, l_suppkey % 20 - 5 AS pe, l_orderkey % 7 = 0 AS en, l_orderkey % 5 = 0 AS ee, 10 + 5 * l_linenumber AS g FROM lineitem))""")
def h33_signal_objective(spark, sf_dir):
    is_ = lambda x, n: F.col(x) % n == 0
    less = lambda x: F.col(x) % 20 - 5
    cost = traffic.signal_cost(is_("l_orderkey", 2), is_("l_linenumber", 2), F.col("l_quantity").cast("double"), F.col("l_suppkey") % 30, less("l_partkey"), less("l_suppkey"), is_("l_orderkey", 7), is_("l_orderkey", 5), F.col("l_linenumber") * 5 + 10, 5.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", half_up(cost, 4).alias("cost"))


@query(f"WITH {TRANS} SELECT coalesce(a.target, b.source) AS node_id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM (SELECT target, count(*) AS n_in FROM tr GROUP BY ALL) a FULL JOIN (SELECT source, count(*) AS n_out FROM tr GROUP BY ALL) b ON a.target = b.source")
def i5_in_and_out_flow(spark, sf_dir):
    return graph.in_out(transitions(spark, sf_dir))
