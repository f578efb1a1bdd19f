"""Anomaly rules, incident lifecycles and control decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import traffic
from ..functions.traffic import c, half_up


@dataclass(frozen=True)
class Rules:
    """Thresholds of the residual rules."""

    speed_drop: float = 20.0
    speed_drop_high: float = 35.0
    queue_growth: float = 8.0
    queue_growth_critical: float = 20.0
    flow_floor: float = 200.0
    flow_share: float = 0.25
    flow_density: float = 35.0
    surge: float = 0.20
    surge_from: float = 0.45
    surge_high: float = 0.65


def residuals(observed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each rule that an (observed, expected) row breaks.

    Columns: segment_id, step, speed, expected_speed, queue, expected_queue, flow,
    expected_flow, density, congestion, baseline."""
    drop = F.col("expected_speed") - F.col("speed")
    growth = F.col("queue") - F.col("expected_queue")
    surge = F.col("congestion") - F.col("baseline")
    hit = lambda test, kind, severity, confidence: F.when(test, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), half_up(F.least(F.lit(1.0), confidence), 4).alias("confidence")))
    found = F.array(
        hit(drop >= rules.speed_drop, "SPEED_DROP", F.when(drop >= rules.speed_drop_high, "HIGH").otherwise("MEDIUM"), drop / 40),
        hit(growth >= rules.queue_growth, "QUEUE_GROWTH", F.when(growth >= rules.queue_growth_critical, "CRITICAL").otherwise("HIGH"), growth / 15),
        hit((F.col("expected_flow") > rules.flow_floor) & (F.col("flow") <= rules.flow_share * F.col("expected_flow")) & (F.col("density") >= rules.flow_density), "FLOW_COLLAPSE", F.lit("CRITICAL"), F.lit(0.9)),
        hit((surge >= rules.surge) & (F.col("congestion") >= rules.surge_from), "CONGESTION_SURGE", F.when(F.col("congestion") >= rules.surge_high, "HIGH").otherwise("MEDIUM"), F.col("congestion")),
    )
    return observed.select("segment_id", "step", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("segment_id", "step", "i.*")


def lifecycle(incidents: DataFrame, by: tuple[str, ...] = ("segment_id", "kind"), at: str = "step") -> DataFrame:
    """Runs of consecutive steps are one incident: each repeat adds 0.05 of
    confidence, and it is resolved at the step after its last."""
    w = Window.partitionBy(*by).orderBy(at)
    run = incidents.withColumn("__run", F.col(at) - F.row_number().over(w))
    out = run.groupBy(*by, "__run").agg(F.min(at).alias("opened"), F.max(at).alias("last"), F.count("*").alias("steps"), F.min_by("confidence", at).alias("c0"))
    return out.select(*by, "opened", "steps", half_up(F.least(F.lit(1.0), F.col("c0") + 0.05 * (F.col("steps") - 1)), 4).alias("confidence"), (F.col("last") + 1).alias("resolved_at"))


# Green times that a plan may give.
GREENS = (15, 20, 25, 30, 35, 40, 45)


def signal_plans(crossings: DataFrame, clearance: float = 5.0) -> DataFrame:
    """The phase and green time with the lowest cost; the first of the grid wins ties.

    Columns: junction, queue_ns, queue_ew, predicted_ns, predicted_ew, emergency_ns,
    emergency_ew, current_ns (is north-south green)."""
    grid = [(ns, g) for ns in (True, False) for g in GREENS]
    options = F.array(*[F.struct(half_up(traffic.signal_cost(F.lit(ns), "current_ns", "queue_ns", "queue_ew", "predicted_ns", "predicted_ew", "emergency_ns", "emergency_ew", F.lit(g), clearance), 2).alias("cost"), F.lit(i).alias("ord"), F.lit("NS" if ns else "EW").alias("phase"), F.lit(g).alias("green")) for i, (ns, g) in enumerate(grid)])
    return crossings.withColumn("__best", F.array_min(options)).select("junction", F.col("__best.phase").alias("phase"), F.col("__best.green").alias("green"), F.col("__best.cost").alias("cost"))


def reactive_plan(queue_ns, queue_ew, current_ns, least: float = 15, most: float = 60):
    """The longer queue gets green, two seconds a vehicle."""
    to_ns = F.when(c(queue_ns) == c(queue_ew), c(current_ns)).otherwise(c(queue_ns) > c(queue_ew))
    green = traffic.clip(2.0 * F.greatest(c(queue_ns), c(queue_ew)), least, most)
    return F.struct(F.when(to_ns, "NS").otherwise("EW").alias("phase"), green.alias("green"))


def green_split(counts: DataFrame, junction: str, ns: str, ew: str, cycle: float = 90.0, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """North-south green in proportion to its share of the demand."""
    a, b = F.sum(ns), F.sum(ew)
    return counts.groupBy(junction).agg(half_up(F.when(a + b > 0, traffic.clip(cycle * a / (a + b), low, high)).otherwise(cycle / 2), 2).alias("green_ns"))


def priority_windows(paths: DataFrame, by: str, path: str = "path", total: str = "seconds", before: float = 15.0, after: float = 10.0) -> DataFrame:
    """Arrival at each junction of a path, an equal share of the time a hop, and the green window around it."""
    hops = paths.select(by, F.col(total), F.size(path).alias("__n"), F.posexplode(path).alias("hop", "junction"))
    at = F.when(F.col("__n") > 1, F.col("hop") * F.col(total) / (F.col("__n") - 1)).otherwise(0.0)
    return hops.select(by, "hop", "junction", half_up(at, 4).alias("arrival"), half_up(F.greatest(F.lit(0.0), at - before), 4).alias("green_from"), half_up(at + after, 4).alias("green_to"))


def corridors(routes: DataFrame, events: DataFrame, by: list[str], share: float = 0.65) -> DataFrame:
    """Green windows along each corridor of an emergency vehicle, which takes ``share`` of a
    route's time; a cancelled or completed corridor gives its junctions back.

    ``routes``: ``by``, path, seconds; ``events``: ``by``, status, seq; the latest status holds."""
    name = F.struct(*by)
    plan = priority_windows(routes.select(name.alias("corridor"), "path", (F.col("seconds") * share).alias("seconds")), "corridor")
    latest = events.groupBy(name.alias("corridor")).agg(F.max_by("status", "seq").alias("status"))
    status = F.coalesce("status", F.lit("ACTIVE"))
    return plan.join(latest, "corridor", "left").select("corridor.*", "hop", "junction", "arrival", "green_from", "green_to", status.alias("status"), (status == "ACTIVE").alias("preempted"))
