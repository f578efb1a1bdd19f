"""Geometry over columns: boxes, lines, polygons, distances, motion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .traffic import c

EARTH_M = 6_371_000.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Metres between two places."""
    a = F.pow(F.sin(F.radians(c(lat2) - c(lat1)) / 2), 2) + F.cos(F.radians(c(lat1))) * F.cos(F.radians(c(lat2))) * F.pow(F.sin(F.radians(c(lon2) - c(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    both = overlap(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def containment(inner: Column, outer: Column) -> Column:
    return F.coalesce(F.try_divide(overlap(inner, outer), area(inner)), F.lit(0.0))


def valid_detection(box: Column, least_area: float = 100.0, most_aspect: float = 5.0) -> Column:
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return (w > 0) & (h > 0) & (w * h >= least_area) & (F.greatest(w, h) / F.least(w, h) <= most_aspect)


def clipped(box: Column, width, height) -> Column:
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v, c(top) * 1.0))
    return F.struct(inside(box["x1"], width).alias("x1"), inside(box["y1"], height).alias("y1"), inside(box["x2"], width).alias("x2"), inside(box["y2"], height).alias("y2"))


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def crosses(ax, ay, bx, by, px, py, qx, qy) -> Column:
    """The segment a-b properly crosses the segment p-q."""
    a, b, p, q = [(c(x), c(y)) for x, y in ((ax, ay), (bx, by), (px, py), (qx, qy))]
    one = F.signum(_turn(*a, *b, *p)) * F.signum(_turn(*a, *b, *q))
    two = F.signum(_turn(*p, *q, *a)) * F.signum(_turn(*p, *q, *b))
    return (one < 0) & (two < 0)


def in_polygon(x, y, points: Column) -> Column:
    """Crossing parity over an array of (x, y); fewer than three points hold everything."""
    n = F.size(points)
    edge = lambda i: (F.get(points, i), F.get(points, F.pmod(i + 1, n)))

    def hit(odd: Column, i: Column) -> Column:
        p, q = edge(i)
        straddles = (p["y"] > c(y)) != (q["y"] > c(y))
        at = p["x"] + F.try_divide((q["x"] - p["x"]) * (c(y) - p["y"]), q["y"] - p["y"])
        return F.when(straddles & (c(x) < at), ~odd).otherwise(odd)

    return F.when(n < 3, True).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), hit))


def project(x, y, m: list[float]) -> tuple[Column, Column]:
    """A point through a 3 x 3 homography, row by row; a point at infinity stays as it is."""
    w = m[6] * c(x) + m[7] * c(y) + m[8]
    return F.when(w != 0, (m[0] * c(x) + m[1] * c(y) + m[2]) / w).otherwise(c(x)), F.when(w != 0, (m[3] * c(x) + m[4] * c(y) + m[5]) / w).otherwise(c(y))


# Directions by eighth of a turn, clockwise from east on a screen.
EIGHTHS = ("EAST", "SOUTHEAST", "SOUTH", "SOUTHWEST", "WEST", "NORTHWEST", "NORTH", "NORTHEAST")


def direction(dx, dy, least: float = 2.0) -> Column:
    turn = F.pmod(F.floor((F.degrees(F.atan2(c(dy), c(dx))) + 22.5) / 45.0), F.lit(8)).cast("int")
    return F.when(F.hypot(c(dx), c(dy)) < least, "STATIONARY").otherwise(F.get(F.array(*[F.lit(d) for d in EIGHTHS]), turn))
