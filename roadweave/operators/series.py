"""Window functions over series and tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, traffic
from .windows import epoch


def sessions(obs: DataFrame, timeout_s: int, entity: str = "entity_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """A new journey of an entity begins after a longer pause than the timeout."""
    w = Window.partitionBy(entity).orderBy(*order)
    gap = epoch("ts") - F.lag(epoch("ts")).over(w)
    return obs.withColumn("seq", F.sum(F.when(gap > timeout_s, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def gap_segments(series: DataFrame, at: str, most: float, by: list[str]) -> DataFrame:
    """Number the stretches without a larger gap than ``most``."""
    w = Window.partitionBy(*by).orderBy(at)
    return series.withColumn("segment", F.sum(F.when(F.col(at) - F.lag(at).over(w) > most, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def lag_window(states: DataFrame, steps: int = 12, by: str = "segment_id", at: str = "window_start", features: str = "features", missing: tuple[float, ...] = (0, 0, 0.5, 0, 0, 0)) -> DataFrame:
    """The last ``steps`` feature vectors, oldest first, padded on the left, as one vector."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(1 - steps, 0)
    pad = F.array(*[F.lit(float(x)) for x in missing])
    have = F.collect_list(features).over(w)
    return states.withColumn("history", F.flatten(F.concat(F.array_repeat(pad, F.lit(steps) - F.size(have)), have)))


def islands(df: DataFrame, condition: Column, by: list[str], at: str) -> DataFrame:
    """Number the runs of rows in which the condition holds; other rows go."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = df.withColumn("__hit", condition).withColumn("__new", F.when(F.col("__hit") & ~F.coalesce(F.lag("__hit").over(w), F.lit(False)), 1).otherwise(0))
    return marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__hit").drop("__hit", "__new")


def stationary(points: DataFrame, by: list[str], at: str, speed: str = "speed", most_kmh: float = 3.6, least_points: int = 5, least_s: float = 30.0) -> DataFrame:
    """Runs of low speed with enough points and time."""
    runs = islands(points, F.col(speed) <= most_kmh, by, at)
    return runs.groupBy(*by, "island").agg(F.count("*").alias("points"), F.min(at).alias("since"), F.max(at).alias("until")).where((F.col("points") >= least_points) & (F.col("until") - F.col("since") >= least_s))


def motion(points: DataFrame, by: list[str], at: str, x: str, y: str, most: float = 1500.0, least_dt: float = 0.01) -> DataFrame:
    """Velocity, capped speed and direction from neighbouring points."""
    w = Window.partitionBy(*by).orderBy(at)
    dt = F.col(at) - F.lag(at).over(w)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    ok = dt >= least_dt
    speed = F.least(F.lit(most), F.hypot(dx, dy) / dt)
    zero = lambda v: F.when(ok, v).otherwise(0.0)
    return points.withColumn("vx", zero(dx / dt)).withColumn("vy", zero(dy / dt)).withColumn("pixel_speed", zero(speed)).withColumn("heading", F.when(dt.isNull(), "UNKNOWN").otherwise(geo.direction(dx, dy)))


def extrapolated(box: Column, vx, vy, seconds) -> Column:
    """A box moved at constant velocity; coordinates aren't negative and sides at least 1."""
    go = lambda v, speed: F.greatest(F.lit(0.0), v + traffic.c(speed) * traffic.c(seconds))
    x1, y1 = go(box["x1"], vx), go(box["y1"], vy)
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x1 + 1, go(box["x2"], vx)).alias("x2"), F.greatest(y1 + 1, go(box["y2"], vy)).alias("y2"))


def smoothed(points: DataFrame, by: list[str], at: str, value: str, a: float = 0.7) -> DataFrame:
    """Exponential moving average up to each row. Rows so far back that a double
    no longer holds their weight are left out, so a frame is bounded."""
    a = min(1.0, max(0.1, a))
    back = math.ceil(math.log(1e-18) / math.log(1 - a)) if a < 1 else 1
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-back, 0)
    have = F.collect_list(value).over(w)
    return points.withColumn("smoothed", F.aggregate(F.slice(have, 2, F.size(have) + 1), F.element_at(have, 1).cast("double"), lambda s, v: F.lit(a) * v + F.lit(1 - a) * s))


def distinct_in_order(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The distinct values of each group by first occurrence; only those are collected."""
    first = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("__first"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", value))), lambda s: s[value]).alias(value))


def repeated_frames(obs: DataFrame) -> DataFrame:
    """The n-th repeat of a variant in a frame becomes a frame of its own; then the
    newest 20 effective frames of a track stay."""
    again = F.row_number().over(Window.partitionBy("track_id", "frame_id", "variant").orderBy("seq"))
    named = obs.withColumn("effective_frame", F.when(again == 1, F.col("frame_id").cast("string")).otherwise(F.concat_ws("_rep", F.col("frame_id").cast("string"), (again - 1).cast("string"))))
    first = F.min("seq").over(Window.partitionBy("track_id", "effective_frame"))
    rank = F.dense_rank().over(Window.partitionBy("track_id").orderBy(F.col("__first").desc(), "effective_frame"))
    return named.withColumn("__first", first).withColumn("__rank", rank).where("__rank <= 20").drop("__first", "__rank")


def discontinuities(points: DataFrame, by: list[str], at: str, factor: float = 3.0) -> DataFrame:
    """Gaps over ``factor`` times the median interval, and repeated times."""
    w = Window.partitionBy(*by).orderBy(at)
    steps = points.withColumn("gap", F.col(at) - F.lag(at).over(w)).where("gap is not null")
    usual = steps.groupBy(*by).agg(F.median("gap").alias("usual"))
    return steps.join(usual, by).where((F.col("gap") > factor * F.col("usual")) | (F.col("gap") == 0)).withColumn("what", F.when(F.col("gap") == 0, "REPEATED").otherwise("GAP"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, tolerance: float) -> DataFrame:
    """The newest earlier value of ``right`` that isn't older than the tolerance."""
    known = right.select(*by, at, F.struct(F.col(value).alias("v"), F.col(at).alias("t")).alias("__v"), F.lit(0).alias("__left"))
    both = left.withColumn("__left", F.lit(1)).unionByName(known, allowMissingColumns=True)
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__last", last).where("__left = 1")
    return out.withColumn(value, F.when(F.col(at) - F.col("__last.t") <= tolerance, F.col("__last.v"))).drop("__v", "__left", "__last")


def windowed_speed(t0: Column, at0: Column, t: Column, at: Column, most: float = 200.0) -> Column:
    """km/h between two places in metres, capped; null without time between them."""
    return F.when(t > t0, traffic.half_up(F.least(F.lit(most), F.abs(at - at0) / (t - t0) * 3.6), 4))


def blockages(points: DataFrame, by: str, node: str, order: list[str], at: str, speed: str = "speed", most_kmh: float = 3.6, least_points: int = 5, least_s: float = 30.0, least_stopped: int = 3) -> DataFrame:
    """Stopped entities by the node of their last slow point: three and more block it."""
    w = Window.partitionBy(by).orderBy(*order)
    slow = F.col(speed) <= most_kmh
    new = F.when(slow & ~F.coalesce(F.lag(slow).over(w), F.lit(False)), 1).otherwise(0)
    runs = points.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(slow)
    each = runs.groupBy(by, "__run").agg(F.count("*").alias("points"), F.min(at).alias("since"), F.max(at).alias("until"), F.max_by(node, F.struct(*order)).alias(node))
    held = each.where((F.col("points") >= least_points) & (F.col("until") - F.col("since") >= least_s))
    own = held.groupBy(node).agg(F.countDistinct(by).alias("stopped"), F.min("since").alias("since"))
    many = F.col("stopped") >= least_stopped
    sure = traffic.half_up(F.least(F.lit(1.0), 0.75 + 0.05 * F.col("stopped")), 2)
    return own.select(node, "stopped", "since", F.when(many, "BLOCKAGE").otherwise("STOPPED_VEHICLE").alias("type"), F.when(many, "CRITICAL").otherwise("HIGH").alias("severity"), sure.alias("confidence"))
