"""Event-time windows by integer arithmetic on epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.traffic import c


def epoch(ts) -> Column:
    return F.unix_seconds(c(ts).cast("timestamp"))


def tumbling(df: DataFrame, seconds: int, ts: str = "ts", out: str = "window_start") -> DataFrame:
    """Half-open windows [start, start + seconds) from multiples of the width."""
    return df.withColumn(out, (F.floor(epoch(ts) / seconds) * seconds).cast("long"))


def sliding(df: DataFrame, width: int, stride: int, origin: int | None = None, ts: str = "ts", out: str = "window_start") -> DataFrame:
    """One row for each window that holds a record. The stride may exceed the
    width, which leaves gaps; no window starts before ``origin``."""
    at = epoch(ts)
    last = F.floor(at / stride)
    first = F.floor((at - width) / stride) + 1
    rows = df.where(first <= last).withColumn(out, F.explode(F.sequence(first, last))).withColumn(out, (F.col(out) * stride).cast("long"))
    return rows if origin is None else rows.where(F.col(out) >= origin)


def spine(df: DataFrame, seconds: int, keys: list[str], ts: str = "ts", out: str = "window_start") -> DataFrame:
    """Every window between the first and the last record, for every key."""
    span = df.agg(F.min(epoch(ts)).alias("lo"), F.max(epoch(ts)).alias("hi"))
    windows = span.select(F.explode(F.sequence(F.floor(F.col("lo") / seconds), F.floor(F.col("hi") / seconds))).alias(out)).withColumn(out, (F.col(out) * seconds).cast("long"))
    # one row a key: the dimension of nodes, not the records
    return windows.join(F.broadcast(df.select(*keys).distinct()), how="cross") if keys else windows
