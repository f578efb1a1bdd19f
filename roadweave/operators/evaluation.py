"""Results against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.traffic import half_up


def truth_of_tracks(overlaps: DataFrame, track: str = "track", truth: str = "truth", score: str = "score") -> DataFrame:
    """The truth that a track meets in most frames; then the one with the highest total
    score, then the smallest. ``overlaps`` has a row for each track, truth and frame that meet;
    scores are integers, so that their sums don't depend on the order."""
    each = overlaps.groupBy(track, truth).agg(F.count("*").alias("hits"), F.sum(score).alias("total"))
    best = F.row_number().over(Window.partitionBy(track).orderBy(F.col("hits").desc(), F.col("total").desc(), truth))
    return each.withColumn("__k", best).where("__k = 1").drop("__k")


def split(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of both sides, of the left one only and of the right one only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.join(b, key).withColumn("side", F.lit("BOTH"))
        .unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("LEFT")))
        .unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("RIGHT")))
    )


def neighbours(rows: DataFrame, by: list[str], key: str, reach: int = 5) -> DataFrame:
    """(by, a, b): each key with the ``reach`` keys after it, as pairs that shouldn't match."""
    placed = rows.select(*by, key).distinct().withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    after = placed.where("__i > 1").select(*by, F.col(key).alias("b"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("__i") - reach), F.col("__i") - 1)).alias("__i"))
    return placed.select(*by, F.col(key).alias("a"), "__i").join(after, [*by, "__i"]).select(*by, "a", "b")


def verdict(said: Column, truth: Column) -> Column:
    """UNCLEAR without a truth, else CORRECT or WRONG."""
    return F.when(truth.isNull(), "UNCLEAR").when(said.eqNullSafe(truth), "CORRECT").otherwise("WRONG")


def verification(rows: DataFrame, by: list[str], verdict_col: str = "verdict", confidence: str = "confidence") -> DataFrame:
    """Counts, accuracy among the clear ones, share that passed of all, and mean confidence (an integer column)."""
    is_ = lambda name: F.count_if(F.col(verdict_col) == name)
    clear = is_("CORRECT") + is_("WRONG")
    return rows.groupBy(*by).agg(
        is_("CORRECT").alias("correct"),
        is_("WRONG").alias("wrong"),
        is_("UNCLEAR").alias("unclear"),
        half_up(F.coalesce(F.try_divide(is_("CORRECT"), clear), F.lit(0.0)), 4).alias("accuracy"),
        half_up(is_("CORRECT") / F.count("*"), 4).alias("pass_rate"),
        half_up(F.sum(confidence) / F.count(confidence), 4).alias("mean_confidence"),
    )


def dominant(rows: DataFrame, track: str, kind: str, order: list[str]) -> DataFrame:
    """(track, kind, n): the most frequent kind of a track; the one seen first wins ties."""
    each = rows.groupBy(track, kind).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__first"))
    best = F.row_number().over(Window.partitionBy(track).orderBy(F.col("n").desc(), "__first"))
    return each.withColumn("__k", best).where("__k = 1").select(track, kind, "n")


def available(rows: DataFrame, by: list[str], signals: dict[str, Column]) -> DataFrame:
    """Whether each signal is ever above 0."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.bool_or(x > 0), F.lit(False)).alias(name) for name, x in signals.items()])
