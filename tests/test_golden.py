"""Golden rows: small literal inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from roadweave.functions import geo, match, text, traffic
from roadweave.operators import boxes, fusion, graph, identity, incidents, series
from roadweave.plans.identity_queries import legs
from roadweave.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_traffic(spark):
    got = one(spark, traffic.flow(F.lit(10), F.lit(60)), traffic.density(F.lit(5), F.lit(500)), traffic.occupancy(F.lit(10), F.lit(500)), traffic.travel_time(F.lit(500.0), F.lit(60.0), F.lit(60.0)), traffic.congestion_score(F.lit(200), F.lit(200), F.lit(5), F.lit(60), F.lit(90), F.lit(100)))
    assert tuple(round(x, 9) for x in got[:4]) == (600.0, 10.0, 0.10, 30.0) and got[4] >= 0.85


def test_text(spark):
    d = lambda a, b: text.confusion_distance(F.lit(a), F.lit(b))
    assert one(spark, d("VN472", "VN4712"), d("TN09AB0", "TN09ABO"), d("ABC", "ABC"), d("AB", "")) == (1.0, 0.5, 0.0, 2.0)
    assert one(spark, text.normalize(F.lit("tn-o9 ab i234")), text.normalize(F.lit("PTS5330")), text.normalize(F.lit("INVALID x")), text.normalize(F.lit("IND KA01MH9999"))) == ("TN09AB1234", "TS5330", "INVALID X", "KA01MH9999")
    assert one(spark, text.validate(F.lit("TN09AB1234"))["status"], text.validate(F.lit("AB12"))["status"]) == ("VALID", "INVALID")
    assert one(spark, text.strip_candidates(F.lit("PTS5330")), text.is_subsequence(F.lit("AC"), F.lit("ABC")), text.is_subsequence(F.lit("CA"), F.lit("ABC")), text.alias_of(F.lit("cam_a"), F.lit("CAM_A_EAST"))) == (["PTS5330", "TS5330"], True, False, True)


def test_geo(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    assert one(spark, geo.in_polygon(F.lit(1.0), F.lit(1.0), square), geo.in_polygon(F.lit(5.0), F.lit(1.0), square)) == (True, False)
    assert one(spark, geo.crosses(*map(F.lit, (0, 0, 2, 2, 0, 2, 2, 0))), geo.crosses(*map(F.lit, (0, 0, 1, 1, 2, 2, 3, 3)))) == (True, False)
    assert one(spark, geo.direction(F.lit(5.0), F.lit(0.0)), geo.direction(F.lit(0.0), F.lit(-5.0)), geo.direction(F.lit(1.0), F.lit(0.0))) == ("EAST", "NORTH", "STATIONARY")


def test_match(spark):
    limits = match.MatchLimits()
    why = lambda same, s, m: match.infeasible(F.lit(same), F.lit(s), F.lit(m), limits)
    assert one(spark, why(False, -1, 300.0), why(False, 1, 300.0), why(False, 18, 300.0), why(False, 4000, 300.0), why(True, 9999, 0.0)) == ("NEGATIVE_TIME", "IMPOSSIBLE_SPEED", None, "GAP_EXCEEDED", None)
    assert one(spark, match.direction_similarity(F.lit("EAST"), F.lit("WEST")), match.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) == (0.1, 0.5)


def test_suppression_and_assignment(spark):
    rows = [(1, 1, "car", 0.9, (0.0, 0.0, 10.0, 10.0)), (1, 2, "car", 0.8, (0.0, 0.0, 10.0, 9.0)), (1, 3, "car", 0.7, (0.0, 0.0, 10.0, 8.1)), (1, 4, "bus", 0.6, (0.0, 0.0, 10.0, 10.0))]
    df = spark.createDataFrame(rows, "frame long, id long, kind string, s double, box struct<x1:double,y1:double,x2:double,y2:double>")
    assert sorted(r.id for r in boxes.suppressed(df, ["frame"], "kind", "s", 0.85).collect()) == [1, 3, 4]
    assert sorted(r.id for r in boxes.dominated(df, ["frame"], "kind", "s", 0.85).collect()) == [1, 4]
    scores = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.7), (1, 2, 2, 0.2)], "frame long, a long, b long, score double")
    assert [(r.a, r.b) for r in boxes.assigned(scores, ["frame"]).collect()] == [(1, 1)]


def test_fusion(spark):
    rows = [("T", 10, "raw", 1, "KA01MH9999", 0.92, 0.90, 0.80), ("T", 20, "raw", 2, "KA01MH9999", 0.91, 0.92, 0.85), ("T", 30, "raw", 3, "KA01MH9g99", 0.50, 0.40, 0.50), ("W", 1, "raw", 4, "TN01AB1234", 0.60, 0.65, 0.50)]
    df = spark.createDataFrame(rows, "track_id string, frame_id int, variant string, seq long, norm_text string, ocr_conf double, valid_conf double, quality double")
    got = {r.track_id: r for r in fusion.fused(df).collect()}
    assert (got["T"].key, got["T"].status) == ("KA01MH9999", "CONFIRMED") and got["W"].status == "PENDING"


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 30.0, 250.0), (2, 4, 30.0, 250.0), (1, 3, 40.0, 375.0), (3, 4, 40.0, 375.0)], "source long, target long, cost double, metres double")
    got = {r.node: r for r in graph.shortest_paths(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got[4].path == [1, 2, 4] and got[4].cost == 60.0 and got[4].metres == 500.0
    slow = spark.createDataFrame([(2, 4, 0.0, 100.0, 500.0)], "source long, target long, from_s double, to_s double, seconds double")
    late = {r.node: r for r in graph.timed_paths(e, slow, spark.createDataFrame([(1, 0.0)], "node long, start double")).collect()}
    assert late[4].path == [1, 3, 4] and late[4].arrival == 80.0
    c = {r.node: r.component for r in graph.components(spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_lifecycle_and_stationary(spark):
    inc = spark.createDataFrame([("s", "K", 1, 0.5), ("s", "K", 2, 0.9), ("s", "K", 5, 0.4)], "segment_id string, kind string, step long, confidence double")
    got = sorted((r.opened, r.steps, r.confidence, r.resolved_at) for r in incidents.lifecycle(inc).collect())
    assert got == [(1, 2, 0.55, 3), (5, 1, 0.4, 6)]
    points = spark.createDataFrame([("t", float(i * 10), 0.0) for i in range(5)] + [("u", 0.0, 50.0)], "track string, at double, speed double")
    assert [r.track for r in series.stationary(points, ["track"], "at").collect()] == ["t"]


def test_match_links_two_candidates(spark):
    vec = lambda i: [1.0 if k == i else 0.0 for k in range(4)]
    rows = [("A", "CAM_A", 0, 0, "", "car", vec(1)), ("C", "CAM_C", 0, 0, "KW527", "car", vec(0)), ("B", "CAM_B", 18, 18, "KW527", "car", vec(0))]
    legs = spark.createDataFrame(rows, "track_id string, node_id string, first_ts long, last_ts long, key string, kind string, vector array<double>").selectExpr("*", "100.0 as width", "100.0 as height", "'EAST' as direction")
    topo = spark.createDataFrame([("CAM_A", "CAM_B", 300.0), ("CAM_C", "CAM_B", 250.0)], "source string, target string, distance_m double")
    links = identity.match_links(identity.candidates(legs, topo)).collect()
    assert [(r.before, r.after) for r in links] == [("C", "B")]


def test_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,cost\n1,2,1000\n2,1,1000\n2,3,500\n")
    got = {(r.source, r.target) for r in files.weighted_edges(spark, str(tmp_path / "e.csv")).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 2)}
    rows = spark.createDataFrame([(0, 1, 10.0, 0.1, 65.0), (1, 1, float("nan"), -1.0, 0.0)], "step int, sensor int, flow double, occupancy double, speed double")
    a, b = files.detector_states(rows).orderBy("step").collect()
    assert (a.density, a.congestion, b.flow, b.density, b.congestion) == (10.0, 0.0, None, None, 100.0)
    files.save_graph(rows, rows, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g"))[0].count() == 2


def test_legs_use_every_vector(spark):
    """A leg's vector is that of its user's id modulo the table's number of vectors."""
    sf = "/root/testdata/sf0.1"
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    users = {r.event_id: r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").where("event_id % 40 = 0").collect()}
    got = {r.track_id: list(r.vector) for r in legs(spark, sf).where("track_id % 40 = 0").select("track_id", "vector").collect()}
    assert len(vectors) > 500 and sorted(vectors) in (list(range(len(vectors))), list(range(1, len(vectors) + 1)))
    assert got.keys() == users.keys() and all(got[e] == vectors.get(u % len(vectors), vectors.get(len(vectors))) for e, u in users.items())


def test_rounds(spark):
    """A path of more than 64 edges is found; a bound that doesn't do is an error."""
    chain = spark.range(67).selectExpr("id source", "id + 1 target", "1D cost", "1D metres").coalesce(1)
    start = spark.range(1).select(F.col("id").alias("node"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r.node: r.cost for r in graph.shortest_paths(chain, start).collect()} == {k: float(k) for k in range(68)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    few = chain.limit(5)
    timetable = spark.createDataFrame([], "source long, target long, from_s double, to_s double, seconds double")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(few, start, rounds=2)
    with pytest.raises(RuntimeError):
        graph.timed_paths(few, timetable, start.withColumn("start", F.lit(0)), rounds=2)
    with pytest.raises(RuntimeError):
        graph.components(few.select(F.col("source").alias("a"), F.col("target").alias("b")), rounds=1)
