"""Functions for SQL users: windows as a table function, keys as scalar ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shipping import ship_package
from ..streaming import evidence


class ExpandWindows:
    """``expand_windows(ts, width, stride, t0)``: the windows [window_start, window_end) that hold a moment, seconds all.

    Windows start at multiples of the stride, none before ``t0`` (null: no bound). A stride over the width leaves
    gaps, whose moments have no window; so has a null moment."""

    def eval(self, ts: int, width: int, stride: int, t0: int) -> Iterator[tuple[int, int]]:
        if ts is None:
            return
        if width <= 0 or stride <= 0:
            raise ValueError("width and stride are positive")
        for k in range((ts - width) // stride + 1, ts // stride + 1):
            if t0 is None or k * stride >= t0:
                yield k * stride, k * stride + width


@F.pandas_udf(DoubleType())
def key_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edit distance of two keys, confusable characters at half cost, up to 2; beyond that and for nulls null."""
    return pd.Series([None if x is None or y is None else evidence.distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Make ``expand_windows`` and ``key_distance`` known to SQL in this session."""
    ship_package(spark)
    spark.udtf.register("expand_windows", F.udtf(ExpandWindows, returnType="window_start long, window_end long"))
    spark.udf.register("key_distance", key_distance)
