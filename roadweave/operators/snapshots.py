"""Observations, transitions and windowed graph snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import traffic as T
from .windows import epoch, tumbling


def normalise(raw: DataFrame, alias: dict[str, str]) -> DataFrame:
    """The observation schema from any source: names mapped, speeds that aren't
    positive and unknown directions become null."""
    df = raw.withColumnsRenamed(alias)
    df = df.withColumn("speed", F.when(F.col("speed") > 0, F.col("speed")))
    if "direction" in df.columns:
        df = df.withColumn("direction", F.nullif(F.col("direction"), F.lit("UNKNOWN")))
    return df


def transitions(obs: DataFrame, entity: str = "entity_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each record with its entity's one before: source, target, seconds between
    (null if 0). The first record of an entity has none."""
    w = Window.partitionBy(entity).orderBy(*order)
    rows = obs.withColumn("source", F.lag("node_id").over(w)).withColumn("before", F.lag("ts").over(w)).where("source is not null")
    gap = F.greatest(F.lit(0), epoch("ts") - epoch("before"))
    return rows.withColumnRenamed("node_id", "target").withColumn("travel_time", F.nullif(gap, F.lit(0))).drop("before")


def edge_snapshot(trans: DataFrame, seconds: int) -> DataFrame:
    """Per window and (source, target): entities, transitions, flow, mean and median travel time."""
    t = F.col("travel_time")
    return (
        tumbling(trans, seconds)
        .groupBy("window_start", "source", "target")
        .agg(
            F.countDistinct("entity_id").alias("vehicle_count"),
            F.count("*").alias("transition_count"),
            T.half_up(F.avg(F.when(t > 0, t)), 2).alias("travel_time"),
            F.median(F.when(t > 0, t)).alias("median_travel_time"),
            F.count_if(t.isNull()).alias("gap_count"),
            F.count_if(t.isNotNull()).alias("observed_count"),
            F.coalesce(F.bool_or(t.isNull()), F.lit(False)).alias("has_gap"),
            F.array_join(F.array_sort(F.collect_set("entity_id")).cast("array<string>"), ",").alias("entities"),
        )
        .withColumn("flow_rate", T.half_up(T.flow("transition_count", seconds), 2))
    )


def node_snapshot(obs: DataFrame, trans: DataFrame, seconds: int, entity: str = "entity_id", track: str | None = None) -> DataFrame:
    """Per window and node: distinct entities, flow, mean positive speed, and the
    flow of transitions in and out, null where there are none."""
    who = F.coalesce(F.col(entity), F.col(track)) if track else F.col(entity)
    speed = F.col("speed").cast("decimal(18,2)")
    base = (
        tumbling(obs, seconds)
        .groupBy("window_start", "node_id")
        .agg(F.countDistinct(who).alias("vehicle_count"), F.sum(F.when(speed > 0, speed)).alias("total"), F.count(F.when(speed > 0, speed)).alias("n"))
        .select("window_start", "node_id", "vehicle_count", T.half_up(T.flow("vehicle_count", seconds), 2).alias("flow_rate"), T.half_up(F.col("total").cast("double") / F.col("n"), 4).alias("average_speed"))
    )
    moved = tumbling(trans, seconds)
    side = lambda name, out: moved.groupBy("window_start", F.col(name).alias("node_id")).agg(T.half_up(T.flow(F.count("*"), seconds), 2).alias(out))
    keys = ["window_start", "node_id"]
    return base.join(side("target", "incoming_flow"), keys, "left").join(side("source", "outgoing_flow"), keys, "left")


def segment_state(obs: DataFrame, seconds: int, length_m: float = 500.0, limit: float = 60.0, capacity: int = 10, lanes: int = 1, ignore_zero_speed: bool = True) -> DataFrame:
    """Per window and segment: the state with its derived measures and feature vector."""
    speed = F.col("speed").cast("decimal(18,2)")
    counted = F.when(speed > 0, speed) if ignore_zero_speed else speed
    n = F.col("vehicle_count")
    base = (
        tumbling(obs, seconds)
        .groupBy("window_start", F.col("node_id").alias("segment_id"))
        .agg(F.count("*").alias("vehicle_count"), F.sum(counted).cast("double").alias("total"), F.count(counted).alias("moving"), T.queue_count("speed").alias("queue_length"))
        .withColumn("average_speed", F.when(F.col("moving") > 0, F.col("total") / F.col("moving")).otherwise(F.lit(limit)))
    )
    out = base.select(
        "window_start",
        "segment_id",
        "vehicle_count",
        T.half_up("average_speed", 4).alias("average_speed"),
        T.half_up(T.flow(n, seconds), 2).alias("flow_rate"),
        T.half_up(T.density(n, length_m), 2).alias("density"),
        T.half_up(T.occupancy(n, length_m, lanes), 4).alias("occupancy"),
        "queue_length",
        T.queue_metres("queue_length").alias("queue_m"),
        T.half_up(T.travel_time(length_m, "average_speed", limit), 2).alias("travel_time"),
        T.congestion_score(T.density(n, length_m), 200, "average_speed", limit, "queue_length", capacity).alias("congestion"),
    ).withColumn("level", T.congestion_level("congestion"))
    return out.withColumn("features", T.feature_vector("flow_rate", "density", "average_speed", "occupancy", "queue_length", capacity, "congestion"))


def network_totals(states: DataFrame) -> DataFrame:
    """Totals a window over all segments."""
    return states.groupBy("window_start").agg(F.sum("vehicle_count").alias("vehicles"), T.half_up(F.sum(F.col("average_speed").cast("decimal(18,4)")).cast("double") / F.count("*"), 3).alias("mean_speed"), T.half_up(F.sum(F.col("congestion").cast("decimal(18,3)")).cast("double") / F.count("*"), 3).alias("mean_congestion"), F.count("*").alias("segments"))


def totals_rollup(states: DataFrame) -> DataFrame:
    """Vehicles and queue by window and segment, by window, and over all."""
    return states.rollup("window_start", "segment_id").agg(F.sum("vehicle_count").alias("vehicles"), F.sum("queue_length").alias("queued"), F.grouping_id().alias("level"))


def upsert_nodes(obs: DataFrame) -> DataFrame:
    """First and last sight, number of sights, and the newest attributes of an entity; an unknown one doesn't replace a known one."""
    newest = F.struct("ts", "event_id")
    return obs.groupBy("entity_id").agg(F.min(epoch("ts")).alias("first_seen"), F.max(epoch("ts")).alias("last_seen"), F.count("*").alias("sights"), F.max_by("node_id", F.when(F.col("node_id").isNotNull(), newest)).alias("last_node"), F.max_by("speed", F.when(F.col("speed").isNotNull(), newest)).alias("last_speed"))


def static_adjacency(edges: DataFrame) -> DataFrame:
    """Weights and gaps of (source, target) over all windows, with indices of the sorted nodes."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    index = ends.withColumn("i", F.row_number().over(Window.orderBy("node")) - 1)  # the dimension of nodes, one row each
    total = edges.groupBy("source", "target").agg(F.sum(F.coalesce("transition_count", F.lit(1))).alias("weight"), F.bool_or("has_gap").alias("has_gap"))
    return total.join(index.withColumnsRenamed({"node": "source", "i": "source_index"}), "source").join(index.withColumnsRenamed({"node": "target", "i": "target_index"}), "target")
