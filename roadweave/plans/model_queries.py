"""Forecasting, measures, incidents and control over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.traffic import half_up
from ..operators import forecast, graph, incidents, windows
from .tables import HOUR, OBS, STATES, TRANS, observations, states, table, transitions

QUERIES = {}
SQL = {}
HORIZONS = (1, 2, 3)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hourly(spark, sf_dir):
    """Vehicles of every node and hour, 0 where none."""
    obs = observations(spark, sf_dir)
    counts = windows.tumbling(obs, HOUR).groupBy("window_start", "node_id").agg(F.count("*").alias("n"))
    return forecast.dense(counts, windows.spine(obs, HOUR, ["node_id"]), ["node_id"], "window_start", "n")


def samples(spark, sf_dir):
    return forecast.chronological(forecast.supervised(hourly(spark, sf_dir), "node_id", "window_start", "n", 3, HORIZONS), "window_start")


HOURLY = OBS + """, b AS (SELECT min(t) // 3600 AS lo, max(t) // 3600 AS hi FROM obs), s AS (SELECT unnest(generate_series(lo, hi)) * 3600 AS window_start FROM b), nd AS (SELECT DISTINCT node_id FROM obs),
 k AS (SELECT t // 3600 * 3600 AS window_start, node_id, count(*) AS c FROM obs GROUP BY ALL), hr AS (SELECT s.window_start, nd.node_id, coalesce(c, 0) AS n FROM s CROSS JOIN nd LEFT JOIN k ON k.window_start = s.window_start AND k.node_id = nd.node_id),
 lagged AS (SELECT *, lag(n, 2) OVER w AS x0, lag(n, 1) OVER w AS x1, n AS x2, lead(n, 1) OVER w AS y1, lead(n, 2) OVER w AS y2, lead(n, 3) OVER w AS y3 FROM hr WINDOW w AS (PARTITION BY node_id ORDER BY window_start)),
 sup AS (SELECT * FROM lagged WHERE x0 IS NOT NULL AND y3 IS NOT NULL), tm AS (SELECT window_start, row_number() OVER (ORDER BY window_start) AS i, count(*) OVER () AS c FROM (SELECT DISTINCT window_start FROM sup)),
 sp AS (SELECT sup.*, CASE WHEN i <= greatest(1, floor(c * 0.7)) THEN 'train' WHEN i <= greatest(1, floor(c * 0.7)) + floor(c * 0.15) THEN 'validation' ELSE 'test' END AS split FROM sup JOIN tm USING (window_start)),
 lng AS (SELECT node_id, window_start, split, horizon, actual, x0, x1, x2 FROM sp, LATERAL (VALUES (1, y1), (2, y2), (3, y3)) v(horizon, actual)),
 pr AS (SELECT node_id, window_start, split, horizon, CAST(actual AS DOUBLE) AS actual, 'persistence' AS model, CAST(x2 AS DOUBLE) AS predicted FROM lng UNION ALL SELECT node_id, window_start, split, horizon, CAST(actual AS DOUBLE), 'moving_average', (CAST(x0 AS DOUBLE) + x1 + x2) / 3 FROM lng)"""
R6 = "floor({} * 1000000.0 + 0.5) / 1000000.0"
R4 = "floor({} * 10000.0 + 0.5) / 10000.0"
R2 = "floor({} * 100.0 + 0.5) / 100.0"


@query(f"WITH {HOURLY} SELECT split, count(*) AS samples, min(window_start) AS since, max(window_start) AS until, CAST(sum(x0 + x1 + x2) AS BIGINT) AS inputs, CAST(sum(y1 + y2 + y3) AS BIGINT) AS targets FROM sp GROUP BY ALL")
def e15_e16_samples_and_split(spark, sf_dir):
    x = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v)
    return samples(spark, sf_dir).groupBy("split").agg(F.count("*").alias("samples"), F.min("window_start").alias("since"), F.max("window_start").alias("until"), F.sum(x).alias("inputs"), F.sum(F.col("y_1") + F.col("y_2") + F.col("y_3")).alias("targets"))


@query(f"WITH {HOURLY}, e AS (SELECT unnest([x0, x1, x2]) AS v FROM sp WHERE split = 'train') SELECT {R6.format('avg(v)')} AS mean, {R6.format('stddev_samp(v)')} AS std, min(v) AS low, max(v) AS high FROM e")
def d28_train_scaler(spark, sf_dir):
    s = forecast.scaler(samples(spark, sf_dir))
    return s.select(half_up("mean", 6).alias("mean"), half_up("std", 6).alias("std"), "low", "high")


@query(f"WITH {HOURLY}, e AS (SELECT unnest([x0, x1, x2]) AS v FROM sp WHERE split = 'train'), m AS (SELECT avg(v) AS mu, stddev_samp(v) AS sd FROM e) SELECT node_id, window_start, {R4.format('((x2 - mu) / sd)')} AS z FROM sp CROSS JOIN m WHERE split = 'test'")
def h30_zscore(spark, sf_dir):
    rows = samples(spark, sf_dir)
    one = F.broadcast(forecast.scaler(rows))  # a single row
    return rows.where("split = 'test'").join(one, F.lit(True)).select("node_id", "window_start", half_up(forecast.scaled(F.element_at("x", -1).cast("double")), 4).alias("z"))


@query(f"WITH {HOURLY} SELECT model, horizon, count(*) AS n, {R6.format('avg(abs(predicted - actual))')} AS mae, {R6.format('sqrt(avg((predicted - actual) * (predicted - actual)))')} AS rmse, {R4.format('(100 * avg(CASE WHEN actual <> 0 THEN abs(predicted - actual) / abs(actual) END))')} AS mape, {R6.format('avg(predicted - actual)')} AS bias FROM pr WHERE split = 'test' GROUP BY ALL")
def j1_j2_d17_baseline_errors(spark, sf_dir):
    return forecast.errors(forecast.predictions(samples(spark, sf_dir)).where("split = 'test'"), ["model", "horizon"])


@query(f"WITH {HOURLY}, m AS (SELECT model, horizon, {R6.format('avg(abs(predicted - actual))')} AS mae FROM pr WHERE split = 'test' GROUP BY ALL) SELECT horizon, arg_min(model, mae) AS best_model, min(mae) AS mae FROM m GROUP BY ALL")
def d19_best_model(spark, sf_dir):
    rows = forecast.predictions(samples(spark, sf_dir)).where("split = 'test'")
    return forecast.best_models(forecast.errors(rows, ["model", "horizon"]), ["horizon"], ["persistence", "moving_average"])


@query(f"WITH {HOURLY}, e AS (SELECT node_id, window_start, horizon, any_value(actual) AS actual, {R6.format('avg(predicted)')} AS predicted, {R6.format('stddev_pop(predicted)')} AS std FROM pr WHERE split = 'test' GROUP BY ALL) SELECT * FROM e")
def j9_ensemble(spark, sf_dir):
    rows = forecast.predictions(samples(spark, sf_dir)).where("split = 'test'")
    return forecast.ensemble(rows, ["node_id", "window_start", "horizon"])


@query(f"""WITH {HOURLY}, e AS (SELECT node_id, window_start, horizon, any_value(actual) AS actual, {R6.format('avg(predicted)')} AS p, {R6.format('stddev_pop(predicted)')} AS s FROM pr WHERE split = 'test' GROUP BY ALL), i AS (SELECT *, greatest(0.0, p - 1.96 * s) AS lo, p + 1.96 * s AS hi FROM e)
 SELECT horizon, {R6.format('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)')} AS picp, {R6.format('avg(hi - lo)')} AS mpiw, {R6.format('abs(avg(s) - avg(abs(actual - p)))')} AS ece FROM i GROUP BY ALL""")
def d18_calibration(spark, sf_dir):
    return forecast.calibration(j9_ensemble(spark, sf_dir), ["horizon"])


def ridge_sql(name, rows, inputs):
    """Tables of a ridge regression of y1 to y3 on ``inputs``: sums of products over the training rows, then
    elimination, one pivot a step, to ``{name}w`` with the weights in the columns after the inputs'."""
    k = len(inputs) + 1
    return f"""{name}v AS (SELECT CAST([1.0, {", ".join(inputs)}, y1, y2, y3] AS DOUBLE[]) AS v FROM {rows} WHERE split = 'train'),
 {name}g AS (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(v[i] * v[j]) + CASE WHEN i = j AND i > 1 THEN 1.0 ELSE 0.0 END AS s FROM {name}v, (SELECT unnest(range(1, {k + 1})) AS i), (SELECT unnest(range(1, {k + 4})) AS j) GROUP BY i, j) GROUP BY i),
 {name}e(p, m) AS (SELECT 0, list(r ORDER BY i) FROM {name}g UNION ALL SELECT p + 1, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = p + 1 THEN list_transform(m[p + 1], lambda x: x / m[p + 1][p + 1]) ELSE list_transform(range(1, {k + 4}), lambda j: m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END) FROM {name}e WHERE p < {k}),
 {name}w AS (SELECT m FROM {name}e WHERE p = {k})"""


def ridge_predictions(name, model, rows, inputs):
    """Long rows of the test split by such weights."""
    k = len(inputs) + 1
    terms = " + ".join([f"m[1][{k} + h]", *[f"m[{i + 2}][{k} + h] * {x}" for i, x in enumerate(inputs)]])
    return f"SELECT '{model}' AS model, CAST(h AS INTEGER) AS horizon, CAST([y1, y2, y3][h] AS DOUBLE) AS actual, {terms} AS predicted FROM {rows}, {name}w, (SELECT unnest([1, 2, 3]) AS h) WHERE split = 'test'"


MEASURED = f"SELECT model, horizon, count(*) AS n, {R6.format('avg(abs(predicted - actual))')} AS mae, {R6.format('sqrt(avg((predicted - actual) * (predicted - actual)))')} AS rmse, {R4.format('(100 * avg(CASE WHEN actual <> 0 THEN abs(predicted - actual) / abs(actual) END))')} AS mape, {R6.format('avg(predicted - actual)')} AS bias FROM al GROUP BY ALL"


@query(f"WITH RECURSIVE {HOURLY}, {ridge_sql('r', 'sp', ['x0', 'x1', 'x2'])}, al AS (SELECT model, horizon, actual, predicted FROM pr WHERE split = 'test' UNION ALL {ridge_predictions('r', 'ridge', 'sp', ['x0', 'x1', 'x2'])}) {MEASURED}")
def j3_j13_ridge_comparison(spark, sf_dir):
    """Ridge from distributed Gram sums beside the simple forecasters, on the test split."""
    rows = samples(spark, sf_dir)
    inputs = [F.get("x", i).cast("double") for i in range(3)]
    weights = forecast.ridge(rows.where("split = 'train'"), inputs, [F.col(f"y_{h}") for h in HORIZONS])
    ridge = {h: forecast.linear(inputs, weights[:, k]) for k, h in enumerate(HORIZONS)}
    return forecast.errors(forecast.predictions(rows, HORIZONS, {"ridge": ridge}).where("split = 'test'"), ["model", "horizon"])


DRAWN = "(CAST(('0x' || substr(md5(node_id || '|' || window_start || '|' || horizon || '|' || draw || '|42'), {}, 12)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE)"


@query(f"""WITH {HOURLY}, n AS (SELECT node_id, window_start, horizon, predicted * (1 + sqrt(-2.0 * ln({DRAWN.format(1)})) * cos(2.0 * pi() * {DRAWN.format(13)}) * CAST(0.1 AS DOUBLE)) AS v FROM pr, (SELECT unnest(range(1, 21)) AS draw) WHERE split = 'test' AND model = 'persistence'),
 m AS (SELECT node_id, window_start, horizon, avg(v) AS mean, stddev_pop(v) AS std FROM n GROUP BY ALL) SELECT node_id, window_start, horizon, {R6.format('mean')} AS mean, {R6.format('std')} AS std, {R6.format('greatest(0.0, mean - 1.96 * std)')} AS lower, {R6.format('(mean + 1.96 * std)')} AS upper FROM m""")
def j8_monte_carlo(spark, sf_dir):
    rows = forecast.predictions(samples(spark, sf_dir)).where("split = 'test' and model = 'persistence'")
    return forecast.monte_carlo(rows, ["node_id", "window_start", "horizon"]).select("node_id", "window_start", "horizon", *[half_up(x, 6).alias(x.split(".")[-1]) for x in ("mean", "std", "bounds.lower", "bounds.upper")])


@query(f"WITH {TRANS} SELECT source, count(travel_time) AS n, {R4.format('avg(travel_time)')} AS mean, {R4.format('median(travel_time)')} AS median, {R4.format('coalesce(stddev_samp(travel_time), 0)')} AS std, min(travel_time) AS low, max(travel_time) AS high, {R4.format('(avg(travel_time) - 1.96 * coalesce(stddev_samp(travel_time), 0) / sqrt(count(travel_time)))')} AS ci_low, {R4.format('(avg(travel_time) + 1.96 * coalesce(stddev_samp(travel_time), 0) / sqrt(count(travel_time)))')} AS ci_high FROM tr GROUP BY ALL")
def d20_summary(spark, sf_dir):
    return forecast.summary(transitions(spark, sf_dir), ["source"], "travel_time")


@query(f"WITH {TRANS} SELECT source, target, {R2.format('avg(travel_time)')} AS mean_s, {R2.format('median(travel_time)')} AS median_s, {R2.format('quantile_cont(travel_time, 0.95)')} AS p95_s, max(travel_time) AS max_s, {R2.format('(count(travel_time) / 1.0)')} AS throughput FROM tr GROUP BY ALL")
def d21_travel_measures(spark, sf_dir):
    return forecast.travel_measures(transitions(spark, sf_dir), ["source", "target"], "travel_time")


EXPECTED = STATES + """, ex AS (SELECT segment_id, window_start // 3600 AS step, average_speed AS speed, queue_length AS queue, vehicle_count AS flow, density, congestion,
 lag(average_speed) OVER w AS expected_speed, lag(queue_length) OVER w AS expected_queue, lag(vehicle_count) OVER w AS expected_flow FROM st WINDOW w AS (PARTITION BY segment_id ORDER BY window_start)),
 inc AS (SELECT segment_id, step, 'SPEED_DROP' AS kind, CASE WHEN expected_speed - speed >= 35 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, floor(least(1.0, (expected_speed - speed) / 40) * 10000.0 + 0.5) / 10000.0 AS confidence FROM ex WHERE expected_speed - speed >= 20
 UNION ALL SELECT segment_id, step, 'QUEUE_GROWTH', CASE WHEN queue - expected_queue >= 20 THEN 'CRITICAL' ELSE 'HIGH' END, floor(least(1.0, (queue - expected_queue) / 15) * 10000.0 + 0.5) / 10000.0 FROM ex WHERE queue - expected_queue >= 2
 UNION ALL SELECT segment_id, step, 'FLOW_COLLAPSE', 'CRITICAL', 0.9 FROM ex WHERE expected_flow > 2 AND flow <= 0.25 * expected_flow AND density >= 1
 UNION ALL SELECT segment_id, step, 'CONGESTION_SURGE', CASE WHEN congestion >= 0.65 THEN 'HIGH' ELSE 'MEDIUM' END, floor(least(1.0, congestion) * 10000.0 + 0.5) / 10000.0 FROM ex WHERE congestion - 0.15 >= 0.15 AND congestion >= 0.3)"""
RULES = incidents.Rules(queue_growth=2, flow_floor=2, flow_density=1, surge=0.15, surge_from=0.3)


def expected(spark, sf_dir):
    """Each state with the one before as its expectation."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("segment_id").orderBy("window_start")
    was = lambda x: F.lag(x).over(w)
    return states(spark, sf_dir).select(
        "segment_id",
        F.floor(F.col("window_start") / HOUR).alias("step"),
        F.col("average_speed").alias("speed"),
        F.col("queue_length").alias("queue"),
        F.col("vehicle_count").alias("flow"),
        "density",
        "congestion",
        was("average_speed").alias("expected_speed"),
        was("queue_length").alias("expected_queue"),
        was("vehicle_count").alias("expected_flow"),
        F.lit(0.15).alias("baseline"),
    )


@query(f"WITH {EXPECTED} SELECT segment_id, step, kind, severity, CAST(confidence AS DOUBLE) AS confidence FROM inc")
def k1_k4_residual_rules(spark, sf_dir):
    return incidents.residuals(expected(spark, sf_dir), RULES)


@query(f"WITH {EXPECTED}, r AS (SELECT *, step - row_number() OVER (PARTITION BY segment_id, kind ORDER BY step) AS run FROM inc) SELECT segment_id, kind, min(step) AS opened, count(*) AS steps, floor(least(1.0, arg_min(CAST(confidence AS DOUBLE), step) + 0.05 * (count(*) - 1)) * 10000.0 + 0.5) / 10000.0 AS confidence, max(step) + 1 AS resolved_at FROM r GROUP BY segment_id, kind, run")
def k6_e18_incident_lifecycle(spark, sf_dir):
    return incidents.lifecycle(incidents.residuals(expected(spark, sf_dir), RULES))


def crossings(spark, sf_dir):
    """Junction = user % 50; click and view come from north and south, the others from east and west."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("junction"), F.col("event_type").isin("click", "view").alias("ns"), F.col("value"))
    n = lambda test: F.count_if(test).cast("double")
    return e.groupBy("junction").agg(
        n(F.col("ns")).alias("queue_ns"),
        n(~F.col("ns")).alias("queue_ew"),
        n(F.col("ns") & (F.col("value") < 50)).alias("predicted_ns"),
        n(~F.col("ns") & (F.col("value") < 50)).alias("predicted_ew"),
        (F.max(F.when(F.col("ns"), F.col("value"))) > 485).alias("emergency_ns"),
        F.lit(False).alias("emergency_ew"),
        (F.col("junction") % 2 == 0).alias("current_ns"),
    )


CROSS = """cr AS (SELECT user_id % 50 AS junction, CAST(count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS DOUBLE) AS qn, CAST(count(CASE WHEN event_type NOT IN ('click', 'view') THEN 1 END) AS DOUBLE) AS qe,
 CAST(count(CASE WHEN event_type IN ('click', 'view') AND value < 50 THEN 1 END) AS DOUBLE) AS pn, CAST(count(CASE WHEN event_type NOT IN ('click', 'view') AND value < 50 THEN 1 END) AS DOUBLE) AS pe, max(CASE WHEN event_type IN ('click', 'view') THEN value END) > 485 AS en FROM events GROUP BY ALL)"""


@query(f"""WITH {CROSS}, op AS (SELECT junction, phase, green, i, CASE WHEN phase = 'NS' THEN qe + pe ELSE qn + pn END AS u, CASE WHEN phase = 'NS' THEN qn ELSE qe END AS s, CASE WHEN (phase = 'NS') <> (junction % 2 = 0) THEN 25.0 ELSE 0.0 END AS sw, CASE WHEN en THEN (CASE WHEN phase = 'NS' THEN -1000.0 ELSE 1000.0 END) ELSE 0.0 END AS em
 FROM cr, LATERAL (SELECT unnest(generate_series(0, 13)) AS i) g, LATERAL (SELECT CASE WHEN i < 7 THEN 'NS' ELSE 'EW' END AS phase, CAST([15, 20, 25, 30, 35, 40, 45][i % 7 + 1] AS INTEGER) AS green) h),
 c AS (SELECT *, floor((u + 0.5 * u * green + 10.0 * u / greatest(1.0, s + u) + sw + em) * 100.0 + 0.5) / 100.0 AS cost FROM op), r AS (SELECT *, row_number() OVER (PARTITION BY junction ORDER BY cost, i) AS k FROM c) SELECT junction, phase, green, cost FROM r WHERE k = 1""")
def k8_predictive_plan(spark, sf_dir):
    return incidents.signal_plans(crossings(spark, sf_dir))


@query(f"WITH {CROSS} SELECT junction, CASE WHEN qn > qe OR (qn = qe AND junction % 2 = 0) THEN 'NS' ELSE 'EW' END AS phase, greatest(15.0, least(60.0, 2.0 * greatest(qn, qe))) AS green FROM cr")
def k7_reactive_plan(spark, sf_dir):
    plan = incidents.reactive_plan("queue_ns", "queue_ew", "current_ns")
    return crossings(spark, sf_dir).select("junction", plan.alias("p")).select("junction", "p.*")


@query(f"WITH {CROSS} SELECT junction, floor(greatest(20.0, least(80.0, 90.0 * qn / (qn + qe))) * 100.0 + 0.5) / 100.0 AS green_ns FROM cr")
def k12_green_split(spark, sf_dir):
    return incidents.green_split(crossings(spark, sf_dir), "junction", "queue_ns", "queue_ew")


@query("""WITH l AS (SELECT l_orderkey AS vehicle, l_suppkey AS junction, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS hop FROM lineitem),
 a AS (SELECT vehicle, CAST(hop AS INTEGER) AS hop, junction, CASE WHEN n > 1 THEN CAST(hop * 60.0 AS DOUBLE) / (n - 1) ELSE 0.0 END AS t FROM l)
 SELECT vehicle, hop, junction, floor(t * 10000.0 + 0.5) / 10000.0 AS arrival, floor(greatest(0.0, t - 15.0) * 10000.0 + 0.5) / 10000.0 AS green_from, floor((t + 10.0) * 10000.0 + 0.5) / 10000.0 AS green_to FROM a""")
def e19_k10_priority_windows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    path = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"])
    paths = li.groupBy(F.col("l_orderkey").alias("vehicle")).agg(path.alias("path")).withColumn("seconds", F.lit(60.0))
    return incidents.priority_windows(paths, "vehicle")


#: Own lags x0 to x2 and lags propagated over the degree-normalised transition graph, b0 to b2.
BESIDE = TRANS.replace(OBS, HOURLY) + """, ew AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS w FROM tr GROUP BY ALL), gw AS (SELECT source, target, sum(w) AS w FROM (SELECT * FROM ew UNION ALL SELECT x, x, 1.0 FROM (SELECT source AS x FROM ew UNION SELECT target FROM ew)) GROUP BY ALL), dg AS (SELECT source, greatest(1e-6, sum(w)) AS d FROM gw GROUP BY ALL),
 an AS (SELECT gw.source, gw.target, w / sqrt(p.d * q.d) AS a FROM gw JOIN dg p ON p.source = gw.source JOIN dg q ON q.source = gw.target), bs AS (SELECT an.source AS node_id, window_start, sum(a * x0) AS b0, sum(a * x1) AS b1, sum(a * x2) AS b2 FROM an JOIN sp ON sp.node_id = an.target GROUP BY ALL), bo AS (SELECT * FROM sp JOIN bs USING (node_id, window_start))"""
OWN, SPREAD = ["x0", "x1", "x2"], ["b0", "b1", "b2"]
SETS = {"full": OWN + SPREAD, "temporal_only": OWN, "spatial_only": SPREAD, "one_step": OWN[2:]}
ABLATION = f"""WITH RECURSIVE {BESIDE}, {", ".join(ridge_sql(m[:2], "bo", x) for m, x in SETS.items())},
 al AS (SELECT p.model, p.horizon, p.actual, p.predicted FROM pr p JOIN bs USING (node_id, window_start) WHERE split = 'test' UNION ALL {" UNION ALL ".join(ridge_predictions(m[:2], m, "bo", x) for m, x in SETS.items())}) {MEASURED}"""


@query(ABLATION)
def j11_j12_ablation(spark, sf_dir):
    """Ridge on own lags, on lags propagated over the transition graph, on both, and on
    one step of history: errors on the test split."""
    rows = samples(spark, sf_dir)
    trans = transitions(spark, sf_dir)
    adjacency = graph.normalised_adjacency(trans.groupBy("source", "target").agg(F.count("*").alias("w")))
    lags = rows.select(F.col("node_id").alias("node"), "window_start", F.posexplode("x").alias("lag", "x")).withColumn("x", F.col("x").cast("double"))
    near = graph.propagated(adjacency, lags, 1, ["window_start", "lag"])
    beside = near.groupBy(F.col("node").alias("node_id"), "window_start").agg(F.map_from_entries(F.collect_list(F.struct("lag", "x"))).alias("beside"))
    both = graph.written(rows.join(beside, ["node_id", "window_start"]), "samples")
    own = [F.get("x", i).cast("double") for i in range(3)]
    spread = [F.coalesce(F.try_element_at("beside", F.lit(i)), F.lit(0.0)) for i in range(3)]
    sets = {"full": own + spread, "temporal_only": own, "spatial_only": spread, "one_step": own[2:]}
    train = both.where("split = 'train'")
    models = {}
    for name, inputs in sets.items():
        weights = forecast.ridge(train, inputs, [F.col(f"y_{h}") for h in HORIZONS])
        models[name] = {h: forecast.linear(inputs, weights[:, k]) for k, h in enumerate(HORIZONS)}
    return forecast.errors(forecast.predictions(both, HORIZONS, models).where("split = 'test'"), ["model", "horizon"])


#: Six measures of a node's hour, to two digits, so that sums of products are told apart exactly; a sample has those of twelve hours in a row and the vehicles of the next three.
MEASURES = ("vehicle_count", "flow_rate", "density", "average_speed", "occupancy", "queue_length")


def deep_samples(spark, sf_dir, history=12):
    w = Window.partitionBy("segment_id").orderBy("window_start")
    rows = states(spark, sf_dir).withColumn("f", F.array(*[half_up(F.col(m).cast("double"), 2) for m in MEASURES]))
    rows = rows.select("segment_id", "window_start", F.flatten(F.collect_list("f").over(w.rowsBetween(1 - history, 0))).alias("x"), F.lag("window_start", history - 1).over(w).alias("since"), F.lead("window_start", 3).over(w).alias("until"), *[F.lead("vehicle_count", h).over(w).cast("double").alias(f"y_{h}") for h in HORIZONS])
    return rows.where((F.col("window_start") - F.col("since") == (history - 1) * HOUR) & (F.col("until") - F.col("window_start") == 3 * HOUR))


@query(f"""WITH {STATES}, w AS (SELECT segment_id, window_start, flatten(list(CAST([{", ".join(R2.format(m) for m in MEASURES)}] AS DOUBLE[])) OVER (PARTITION BY segment_id ORDER BY window_start ROWS 11 PRECEDING)) AS x, lag(window_start, 11) OVER v AS since, lead(window_start, 3) OVER v AS until, [lead(vehicle_count, 1) OVER v, lead(vehicle_count, 2) OVER v, lead(vehicle_count, 3) OVER v] AS y FROM st WINDOW v AS (PARTITION BY segment_id ORDER BY window_start)),
 s AS (SELECT list_concat([1.0::DOUBLE], x, CAST(y AS DOUBLE[])) AS v FROM w WHERE window_start - since = 39600 AND until - window_start = 10800)
 SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, {R4.format('sum(v[i] * v[j])')} AS s FROM s, (SELECT unnest(range(1, 77)) AS i), (SELECT unnest(range(1, 77)) AS j) WHERE i <= j GROUP BY i, j""")
def j3_j5_gram_sums(spark, sf_dir):
    """What a ridge regression on 72 inputs needs of all samples: 2926 sums."""
    rows = deep_samples(spark, sf_dir)
    vector = F.concat(F.array(F.lit(1.0)), F.col("x"), F.array(*[F.col(f"y_{h}") for h in HORIZONS]))
    return forecast.gram_sums(rows, vector).select("i", "j", half_up("s", 4).alias("s"))
