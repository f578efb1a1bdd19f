"""Readers and writers of the formats that observations come in and results go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.traffic import distance_kernel, half_up

# The columns of a verification table.
VERIFICATION = "crop_id string, frame_number long, track_id string, timestamp double, raw_ocr string, normalized_ocr string, ocr_confidence double, plate_detector_confidence double, indian_format string, indian_validation_reason string, temporal_consistency double, human_ground_truth string, human_result string"


def weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """``from,to,cost`` as edges weighted by distance; a missing reverse edge is added."""
    raw = spark.read.schema("source int, target int, cost double").option("header", True).csv(path)
    return with_reverse(raw.select("source", "target", distance_kernel("cost").alias("w")))


def with_reverse(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "w")
    return edges.unionByName(back.join(edges, ["source", "target"], "left_anti"))


def verification(spark: SparkSession, path: str) -> DataFrame:
    """A verification table; values that don't fit their column are null. Empty texts stay empty."""
    return spark.read.schema(VERIFICATION).option("header", True).option("mode", "PERMISSIVE").option("emptyValue", "").option("escape", '"').option("multiLine", True).csv(path)


def append_verification(df: DataFrame, path: str) -> None:
    """Add rows to a verification table: measures to three digits, columns that ``df`` lacks empty, for people to fill."""
    measures = ("timestamp", "ocr_confidence", "plate_detector_confidence", "temporal_consistency")
    columns = []
    for name, kind in (field.split() for field in VERIFICATION.split(", ")):
        value = F.col(name).cast(kind) if name in df.columns else F.lit("" if kind == "string" else None).cast(kind)
        columns.append((half_up(value, 3) if name in measures else value).alias(name))
    df.select(*columns).write.mode("append").option("header", True).option("escape", '"').csv(path)


def audit_events(obs: DataFrame) -> DataFrame:
    """Every valid observation, and the first confirmation of each track, for a JSON sink."""
    first = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "seq"))
    valid = obs.where("status = 'VALID'").select("track_id", "ts", "seq", F.lit("VALID_OBSERVATION").alias("event"))
    confirmed = obs.where("status = 'CONFIRMED'").withColumn("__k", first).where("__k = 1").select("track_id", "ts", "seq", F.lit("PLATE_CONFIRMED").alias("event"))
    return valid.unionByName(confirmed)


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def detector_states(rows: DataFrame, limit: float = 65.0) -> DataFrame:
    """Loop-detector rows (step, sensor, flow, occupancy, speed) as features: NaN and
    negative values are missing, density and congestion in percent."""
    clean = lambda c: F.when(F.isnan(c) | (F.col(c) < 0), None).otherwise(F.col(c))
    speed = clean("speed")
    congestion = F.when(speed <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - speed / limit) * 100)))
    return rows.select("step", "sensor", half_up(clean("flow"), 2).alias("flow"), half_up(clean("occupancy") * 100, 2).alias("density"), half_up(speed, 2).alias("speed"), half_up(congestion, 2).alias("congestion"))


def matrix_snapshots(rows: DataFrame, edges: DataFrame, hours: float) -> DataFrame:
    """A long matrix (step, node, speed, flow, count) with a row for each edge (source, target,
    w in metres) that leaves the node, and one without where none does.

    NaN and negative values are missing; a missing count is that of the flow over
    ``hours``; an edge has a travel time where its node moves at over 5 km/h."""
    clean = lambda c: half_up(F.when(F.isnan(c) | (F.col(c) < 0), None).otherwise(F.col(c)), 2).alias(c)
    own = rows.select("step", "node", clean("speed"), clean("flow"), "count")
    own = own.withColumn("count", F.coalesce("count", F.floor(F.col("flow") * hours + 0.5)))
    moving = F.when(F.col("speed") > 5, half_up(F.col("w") / (F.col("speed") / 3.6), 4))
    return own.join(edges, own["node"] == edges["source"], "left").select("step", "node", "target", "speed", "flow", "count", moving.alias("travel_time"))


def availability(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values that are present, a row for each column."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), half_up(c, 6).alias("present")) for c in columns])).alias("x")).select("x.*")


def aligned(df: DataFrame, cameras: DataFrame, key: str = "camera_id") -> DataFrame:
    """Event times moved by each camera's clock offset in seconds (0 where unknown)."""
    return df.join(cameras.select(key, "offset_s"), key, "left").withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.round(F.coalesce("offset_s", F.lit(0.0)) * 1e6).cast("long"))).drop("offset_s")


def sampled_frames(df: DataFrame, every: int, fps: float | Column) -> DataFrame:
    """Every n-th frame, with its time."""
    return df.where(F.pmod(F.col("frame_id") - 1, F.lit(every)) == 0).withColumn("t", F.col("frame_id") / fps)


# Classes under other names.
CLASSES = {"emergency": "ambulance", "motorbike": "motorcycle"}


def detections(df: DataFrame) -> DataFrame:
    """x, y, w, h as corner boxes with sides of 1 at least, and class names mapped."""
    names = F.create_map(*[F.lit(v) for kv in CLASSES.items() for v in kv])
    box = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.greatest(F.lit(1.0), "w")).alias("x2"), (F.col("y") + F.greatest(F.lit(1.0), "h")).alias("y2"))
    return df.withColumn("box", box).withColumn("class_name", F.coalesce(F.try_element_at(names, F.lower("class_name")), F.lower("class_name")))
