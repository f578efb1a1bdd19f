"""Questions to journeys, tracks and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folded_key(key: Column | str) -> Column:
    return F.upper(F.trim(F.col(key) if isinstance(key, str) else key))


def first_match(asked: DataFrame, key: str, rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``asked`` with the first row (by ``order``) whose key is the same but for case and
    outer blanks, as the struct ``found``; null if there is none."""
    if not order:
        raise ValueError("an order is needed to tell which match is the first")
    least = rows.groupBy(folded_key(by).alias("__key")).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("found"))
    return asked.withColumn("__key", folded_key(key)).join(least, "__key", "left").drop("__key")


def containing(journeys: DataFrame, legs: DataFrame, by: str, journey_key: str, leg_key: str, piece: str) -> DataFrame:
    """Journeys in whose key, or in that of one of whose legs, the piece stands."""
    if not piece:
        raise ValueError("a piece of text to look for is needed")
    holds = lambda k: F.contains(F.upper(F.col(k)), F.lit(piece.upper()))
    hit = legs.where(holds(leg_key)).select(by).distinct().withColumn("__hit", F.lit(True))
    return journeys.join(hit, by, "left").where(holds(journey_key) | F.col("__hit")).drop("__hit")


def sampled(rows: DataFrame, track: str, text: str, order: list[str], most: int = 30) -> DataFrame:
    """The first row of each track and the first later one with another text; of all
    these the first ``most`` by order."""
    w = Window.partitionBy(track).orderBy(*order)
    marked = rows.withColumn("__first", F.first(text).over(w)).withColumn("__at", F.row_number().over(w))
    differs = (~F.col(text).eqNullSafe(F.col("__first"))).cast("int")
    nth = F.sum(differs).over(w.rowsBetween(Window.unboundedPreceding, 0))
    picked = marked.withColumn("__n", nth).where((F.col("__at") == 1) | ((differs == 1) & (F.col("__n") == 1)))
    return picked.orderBy(*order).limit(most).drop("__first", "__at", "__n")


def active(rows: DataFrame, track: str, node: str, at: str, order: list[str], within: float) -> DataFrame:
    """(node, tracks): tracks by the node of their last row, if that is at most ``within``
    older than the newest row of all."""
    last = rows.groupBy(track).agg(F.max(F.struct(*order, node, F.col(at).alias("__at"))).alias("l")).select(F.col(f"l.{node}").alias(node), F.col("l.__at").alias("at"))
    newest = rows.agg(F.max(at).alias("newest"))  # one row
    return last.join(F.broadcast(newest), F.col("newest") - F.col("at") <= within).groupBy(node).agg(F.count("*").alias("tracks"))


def state_at(rows: DataFrame, node: str, at: str, until, order: list[str], value: str) -> DataFrame:
    """What is known of each node at a time: rows so far, the first and the last time, the last value."""
    return rows.where(F.col(at) <= until).groupBy(node).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(value, F.struct(*order)).alias("last_value"))


def ahead(rows: DataFrame, road: list[str], position: str) -> DataFrame:
    """Distance to the next larger position on the same road; null for the foremost."""
    places = rows.select(*road, position).distinct()
    gap = F.lead(position).over(Window.partitionBy(*road).orderBy(position)) - F.col(position)
    return rows.join(places.withColumn("ahead", gap), [*road, position])


#: Ranges are told apart by the power of two that holds their width, between these.
LEAST_LEVEL, MOST_LEVEL = -20, 60


def within(points: DataFrame, ranges: DataFrame, on: list[str], at: str, low: str, high: str) -> DataFrame:
    """Pairs of a range and a point of its group with low <= at <= high, the columns of both.

    Every range is as wide as it says: it lies in two bins at most of the least power of two that isn't
    narrower, and a point looks into one bin of each width that occurs (81 at most, counted first). So a key
    holds what is near in a group, not the whole group. Bounds are finite; ranges that end before they begin and nulls have no pairs."""
    width = F.greatest(F.col(high) - F.col(low), F.lit(2.0**LEAST_LEVEL))
    level = F.least(F.ceil(F.log2(width)).cast("int"), F.lit(MOST_LEVEL))
    placed = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    levels = [r[0] for r in placed.select("__level").distinct().collect()]
    size = F.pow(F.lit(2.0), F.col("__level"))
    bins = placed.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    looking = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", F.floor(F.col(at) / size))
    return bins.join(looking, [*on, "__level", "__bin"]).where(F.col(at).between(F.col(low), F.col(high))).drop("__level", "__bin")
