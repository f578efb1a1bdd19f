"""Traffic formulas over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str | float | int) -> Column:
    """A column by name, a literal, or the column itself."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Rounding that gives the same double in Spark and in other engines."""
    return F.floor(c(x) * (10.0**digits) + 0.5) / (10.0**digits)


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c(x)))


def flow(n, seconds) -> Column:
    """Vehicles an hour; 0 without any."""
    return F.when(c(n) > 0, c(n) / c(seconds) * 3600.0).otherwise(0.0)


def density(n, length_m) -> Column:
    """Vehicles a km, on 50 m at least."""
    return c(n) / F.greatest(F.lit(0.05), c(length_m) / 1000.0)


def occupancy(n, length_m, lanes=1, vehicle_m: float = 5.0) -> Column:
    return F.least(F.lit(1.0), c(n) * vehicle_m / (c(length_m) * c(lanes)))


def queue_count(speed, threshold: float = 5.0) -> Column:
    """Aggregate: vehicles slower than the threshold."""
    return F.count_if(c(speed) < threshold)


def queue_metres(n, vehicle_m: float = 7.0) -> Column:
    return c(n) * vehicle_m


def travel_time(length_m, speed_kmh, limit_kmh) -> Column:
    """Seconds; never under free flow, ten times free flow at a standstill."""
    free = c(length_m) / (c(limit_kmh) / 3.6)
    return F.when(c(speed_kmh) <= 0.5, free * 10).otherwise(F.greatest(free, c(length_m) / (c(speed_kmh) / 3.6)))


def congestion_score(density_, capacity_density, speed, limit, queue, capacity) -> Column:
    crowd = clip(c(density_) / F.greatest(F.lit(1.0), c(capacity_density)), 0, 1)
    slow = F.greatest(F.lit(0.0), 1 - c(speed) / F.greatest(F.lit(1.0), c(limit)))
    queued = clip(c(queue) / F.greatest(F.lit(1.0), c(capacity)), 0, 1)
    return half_up(clip(0.4 * crowd + 0.4 * slow + 0.2 * queued, 0, 1), 3)


# Lower bounds of the levels.
LEVELS = ((0.25, "FREE_FLOW"), (0.50, "LIGHT"), (0.75, "MODERATE"), (0.90, "HEAVY"))


def congestion_level(score, last: str = "SEVERE") -> Column:
    out = F.lit(last)
    for bound, name in reversed(LEVELS):
        out = F.when(c(score) < bound, name).otherwise(out)
    return out


def feature_vector(flow_, density_, speed, occupancy_, queue, capacity, score) -> Column:
    return F.array(c(flow_) / 3600.0, c(density_) / 200.0, c(speed) / 120.0, c(occupancy_) * 1.0, c(queue) / F.greatest(F.lit(1.0), c(capacity)), c(score) * 1.0)


def road_cost(seconds, congestion, std, length_m, incident) -> Column:
    """Generalised cost of an edge."""
    return F.greatest(F.lit(1.0), c(seconds)) + 300.0 * c(congestion) + 2 * c(std) + c(length_m) / 1000.0 + F.when(c(incident), 300.0).otherwise(0.0)


# Two-sided quantiles of the normal distribution.
Z = {80: 1.282, 90: 1.645, 95: 1.960}


def interval(mean, std, level: int = 95) -> Column:
    """(lower, upper); a lower bound is never negative."""
    return F.struct(F.greatest(F.lit(0.0), c(mean) - Z[level] * c(std)).alias("lower"), (c(mean) + Z[level] * c(std)).alias("upper"))


def variation_confidence(mean, std) -> Column:
    return clip(1 - c(std) / F.greatest(F.lit(1.0), c(mean)), 0, 1)


def distance_kernel(metres, scale: float = 1000.0) -> Column:
    return F.exp(-F.pow(c(metres) / scale, 2))


def signal_cost(green_ns, current_ns, queue_ns, queue_ew, predicted_ns, predicted_ew, emergency_ns, emergency_ew, green, clearance) -> Column:
    """Cost of giving green to north-south (or else east-west) for ``green`` seconds."""
    to_ns = c(green_ns)
    unserved = F.when(to_ns, c(queue_ew) + F.greatest(F.lit(0.0), c(predicted_ew))).otherwise(c(queue_ns) + F.greatest(F.lit(0.0), c(predicted_ns)))
    served = F.when(to_ns, c(queue_ns)).otherwise(c(queue_ew))
    helped = F.when(to_ns, c(emergency_ns)).otherwise(c(emergency_ew))
    blocked = F.when(to_ns, c(emergency_ew)).otherwise(c(emergency_ns))
    emergency = F.when(blocked, 1000.0).otherwise(0.0) - F.when(helped, 1000.0).otherwise(0.0)
    switch = F.when(to_ns != c(current_ns), 5.0 * c(clearance)).otherwise(0.0)
    return unserved + 0.5 * unserved * c(green) + 10.0 * unserved / F.greatest(F.lit(1.0), served + unserved) + switch + emergency


def quality_label(status, quality) -> Column:
    return F.when(c(status).isin("OFFLINE", "ERROR"), "INVALID").when(c(status).isin("STALE", "RECONNECTING"), "STALE").when(c(quality) < 0.5, "DEGRADED").otherwise("GOOD")


def trust_label(trust) -> Column:
    return F.when(c(trust) >= 0.8, "TRUSTED").when(c(trust) >= 0.5, "SUSPECT").otherwise("UNTRUSTED")


def pixel_quality(width, height, sharp=0.5, contrast=0.5, bright=0.5, edge=0.5) -> Column:
    """Quality of a small box from supplied pixel statistics."""
    ratio = c(width) / F.greatest(F.lit(1.0), c(height))
    aspect = F.when(ratio.between(1.5, 6.0), clip(1 - F.abs(ratio - 3.5) / 3.5, 0.2, 1)).otherwise(0.05)
    size = F.least(F.lit(1.0), c(width) * c(height) / 1500.0)
    return 0.25 * c(sharp) + 0.20 * c(contrast) + 0.20 * size + 0.15 * aspect + 0.10 * c(bright) + 0.10 * c(edge)


def road_congestion(speed, limit, n, capacity, severity=0.0) -> Column:
    """Congestion of a road by its own count and limit; ``severity`` (0 to 1) of what blocks it, if anything."""
    return F.least(F.lit(1.0), 0.6 * F.greatest(F.lit(0.0), 1 - c(speed) / c(limit)) + 0.4 * c(n) / c(capacity) + 0.5 * c(severity))


def four_levels(score) -> Column:
    return F.when(c(score) < 0.25, "LOW").when(c(score) < 0.5, "MEDIUM").when(c(score) < 0.75, "HIGH").otherwise("SEVERE")


def single_forecast_spread(value) -> Column:
    """(lower, upper, std) of a forecast that stands alone: a tenth to either side."""
    lower, upper = c(value) * 0.9, c(value) * 1.1
    return F.struct(lower.alias("lower"), upper.alias("upper"), ((upper - lower) / 3.92).alias("std"))
