"""Joins and selections over boxes in frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo


def overlapping(a: DataFrame, b: DataFrame, frame: list[str], least: float) -> DataFrame:
    """Pairs of boxes of one frame with their overlap; ``a`` and ``b``: frame, id, box."""
    pairs = a.select(*frame, F.col("id").alias("a"), F.col("box").alias("x")).join(b.select(*frame, F.col("id").alias("b"), F.col("box").alias("y")), frame)
    return pairs.withColumn("iou", geo.iou(F.col("x"), F.col("y"))).where(F.col("iou") >= least)


def owners(inner: DataFrame, outer: DataFrame, frame: list[str], least: float = 0.05) -> DataFrame:
    """The outer box that holds most of each inner one; near ties by overlap, smaller area, larger id."""
    pairs = inner.select(*frame, F.col("id").alias("inner"), F.col("box").alias("x")).join(outer.select(*frame, F.col("id").alias("outer"), F.col("box").alias("y")), frame)
    pairs = pairs.withColumn("held", geo.containment(F.col("x"), F.col("y"))).where(F.col("held") > least)
    best = F.max("held").over(Window.partitionBy(*frame, "inner"))
    order = Window.partitionBy(*frame, "inner").orderBy(geo.iou(F.col("x"), F.col("y")).desc(), geo.area(F.col("y")), F.col("outer").desc())
    return pairs.withColumn("__best", best).where("__best - held <= 0.05").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__best", "__k", "x", "y")


def dominated(boxes: DataFrame, frame: list[str], kind: str, strength: str, least: float) -> DataFrame:
    """Boxes without a stronger one of their kind that overlaps them; strength ties by smaller id."""
    b = boxes.select(*frame, kind, F.col("id").alias("__id"), F.col("box").alias("__box"), F.col(strength).alias("__s"))
    stronger = (F.col("__s") > F.col(strength)) | ((F.col("__s") == F.col(strength)) & (F.col("__id") < F.col("id")))
    same = [boxes[x] == b[x] for x in (*frame, kind)]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return boxes.join(b, cond & stronger & (geo.iou(F.col("box"), F.col("__box")) >= least), "left_anti")


def suppressed(boxes: DataFrame, frame: list[str], kind: str, strength: str, least: float = 0.85) -> DataFrame:
    """Greedy suppression: strongest first (ties: smaller id), a box goes if a kept
    one of its kind overlaps it. A frame is a small group, folded as one array."""
    rows = boxes.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct((-F.col(strength)).alias("s"), "id", F.col(kind).alias("k"), "box"))).alias("all"))
    clash = lambda kept, x: F.exists(kept, lambda y: (y["k"] == x["k"]) & (geo.iou(y["box"], x["box"]) >= least))
    kept = F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), lambda done, x: F.when(clash(done, x), done).otherwise(F.concat(done, F.array(x))))
    return rows.select(*frame, F.explode(kept).alias("x")).select(*frame, "x.id", F.col("x.k").alias(kind), (-F.col("x.s")).alias(strength), "x.box")


def assigned(scores: DataFrame, group: list[str], a: str = "a", b: str = "b", score: str = "score", least: float = 0.3) -> DataFrame:
    """Greedy one-to-one pairs, highest score first; ties by smaller ids. A group is small, folded as one array."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))))
    rows = scores.where(F.col(score) >= least).groupBy(*group).agg(pairs.alias("all"))
    used = lambda done, x: F.exists(done, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
    kept = F.aggregate(F.slice("all", 2, F.size("all")), F.slice("all", 1, 1), lambda done, x: F.when(used(done, x), done).otherwise(F.concat(done, F.array(x))))
    return rows.select(*group, F.explode(kept).alias("x")).select(*group, F.col("x.a").alias(a), F.col("x.b").alias(b), (-F.col("x.s")).alias(score))


def first_crossings(points: DataFrame, lines: DataFrame, by: list[str], at: str) -> DataFrame:
    """The first crossing of each track and line. ``lines`` is a dimension: line, px, py, qx, qy."""
    w = Window.partitionBy(*by).orderBy(at)
    steps = points.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).where("x0 is not null")
    hit = steps.join(F.broadcast(lines), geo.crosses("x0", "y0", "x", "y", "px", "py", "qx", "qy"))
    k = F.row_number().over(Window.partitionBy(*by, "line").orderBy(at))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    way = F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, "EAST").otherwise("WEST")).otherwise(F.when(dy >= 0, "SOUTH").otherwise("NORTH"))
    return hit.withColumn("way", way).withColumn("__k", k).where("__k = 1").drop("__k")




def unclaimed(claims: DataFrame, frame: list[str], order: str, kind: str, threshold: float = 0.6) -> DataFrame:
    """Claims without an earlier one of another kind in the frame that overlaps them by more than the threshold."""
    before = claims.select(*frame, F.col(order).alias("__order"), F.col(kind).alias("__kind"), F.col("box").alias("__box"))
    same = [claims[x] == before[x] for x in frame]
    hit = (F.col("__order") < claims[order]) & (F.col("__kind") != claims[kind]) & (geo.iou(F.col("__box"), claims["box"]) > threshold)
    both = same[0]
    for x in same[1:]:
        both = both & x
    return claims.join(before, both & hit, "left_anti")
