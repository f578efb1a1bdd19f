"""Datasets for forecasting, simple forecasters and their measures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import traffic
from ..functions.traffic import c, half_up
from ..shipping import ship_package


def dense(series: DataFrame, spine: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """A value for every step of the spine; 0 where nothing was counted."""
    return spine.join(series, [*keys, at], "left").select(*keys, at, F.coalesce(value, F.lit(0)).alias(value))


def supervised(series: DataFrame, by: str, at: str, value: str, history: int = 3, horizons: tuple[int, ...] = (1, 2, 3), segment: str | None = None) -> DataFrame:
    """Input windows x (oldest first) and targets y_h, inside one segment only."""
    keys = [by, segment] if segment else [by]
    w = Window.partitionBy(*keys).orderBy(at)
    out = series.withColumn("x", F.collect_list(value).over(w.rowsBetween(1 - history, 0)))
    for h in horizons:
        out = out.withColumn(f"y_{h}", F.lead(value, h).over(w))
    complete = F.size("x") == history
    for h in horizons:
        complete = complete & F.col(f"y_{h}").isNotNull()
    return out.where(complete)


def chronological(samples: DataFrame, at: str, train: float = 0.70, validation: float = 0.15, purge: int = 0) -> DataFrame:
    """Split by time: the first share trains, the next validates, the rest tests.
    Numbers the distinct sample times, a small table."""
    times = samples.select(at).distinct()
    n = F.count("*").over(Window.partitionBy())
    placed = times.withColumn("__i", F.row_number().over(Window.orderBy(at))).withColumn("__n", n)
    n_train = F.greatest(F.lit(1), F.floor(F.col("__n") * train))
    n_val = F.floor(F.col("__n") * validation)
    split = F.when(F.col("__i") <= n_train - purge, "train").when(F.col("__i") <= n_train, "purged").when(F.col("__i") <= n_train + n_val, "validation").otherwise("test")
    return samples.join(placed.select(at, split.alias("split")), at).where("split <> 'purged'")


def scaler(samples: DataFrame, x: str = "x") -> DataFrame:
    """Mean and deviation of the training windows, each value counted once for every window that covers it."""
    each = samples.where("split = 'train'").select(F.explode(x).alias("v"))
    std = F.stddev_samp("v")
    return each.agg(F.avg("v").alias("mean"), F.when(F.coalesce(std, F.lit(0.0)) <= 1e-6, 1.0).otherwise(std).alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def scaled(value: Column, method: str = "zscore") -> Column:
    """A value on the scale of ``scaler``'s columns; null stays null."""
    if method == "zscore":
        return (value - F.col("mean")) / F.col("std")
    if method == "minmax":
        return (value - F.col("low")) / F.greatest(F.lit(1e-6), F.col("high") - F.col("low"))
    return value


def persistence(x: Column) -> Column:
    return F.element_at(x, -1).cast("double")


def moving_average(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def _partial_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products' sums of one partition's vectors, a row for each of their places."""
    total = None
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            x = np.nan_to_num(flat).reshape(batch.num_rows, -1)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])


def gram_sums(samples: DataFrame, vector: Column) -> DataFrame:
    """(i, j, s): the sums over all rows of the products of places i <= j, from 0, of a vector of one length.

    Every partition multiplies its vectors as a matrix and hands on one matrix; these are added up
    by place. Missing values count as 0; null vectors are left out."""
    ship_package(samples.sparkSession)
    rows = samples.select(vector.cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    parts = rows.mapInArrow(_partial_gram, "i int, sums array<double>")
    return parts.select("i", F.posexplode("sums").alias("j", "s")).where("i <= j").groupBy("i", "j").agg(F.sum("s").alias("s"))


def gram(samples: DataFrame, inputs: list[Column], targets: list[Column]) -> np.ndarray:
    """``gram_sums`` of a leading 1, the inputs and the targets as a matrix: the only thing that reaches the driver."""
    columns = [F.lit(1.0), *[c(v).cast("double") for v in inputs], *[c(v).cast("double") for v in targets]]
    out = np.zeros((len(columns), len(columns)))
    for r in gram_sums(samples, F.array(*columns)).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def ridge(samples: DataFrame, inputs: list[Column], targets: list[Column], alpha: float = 1.0) -> np.ndarray:
    """Weights of every target, (1 + inputs) x targets; the bias isn't penalised."""
    g, k = gram(samples, inputs, targets), len(inputs) + 1
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0.0
    return np.linalg.solve(g[:k, :k] + penalty, g[:k, k:])


def linear(inputs: list[Column], weights: np.ndarray) -> Column:
    return sum((float(w) * c(x) for w, x in zip(weights[1:], inputs, strict=True)), F.lit(float(weights[0])))


#: Forecasters by name: array of history -> forecast.
FORECASTERS = {"persistence": persistence, "moving_average": moving_average}


def register_forecaster(name: str, forecast) -> None:
    """Add a forecaster (Column of history -> Column) to every comparison."""
    FORECASTERS[name] = forecast


def predictions(samples: DataFrame, horizons: tuple[int, ...] = (1, 2, 3), extra: dict[str, dict[int, Column]] | None = None) -> DataFrame:
    """Long form: one row for each sample, horizon and model, with truth and forecast."""
    rows = []
    for h in horizons:
        for name, f in FORECASTERS.items():
            rows.append(F.struct(F.lit(h).alias("horizon"), F.lit(name).alias("model"), F.col(f"y_{h}").cast("double").alias("actual"), f(F.col("x")).alias("predicted")))
        for name, by_h in (extra or {}).items():
            rows.append(F.struct(F.lit(h).alias("horizon"), F.lit(name).alias("model"), F.col(f"y_{h}").cast("double").alias("actual"), by_h[h].alias("predicted")))
    keep = [x for x in samples.columns if x != "x" and not x.startswith("y_")]
    return samples.select(*keep, F.explode(F.array(*rows)).alias("p")).select(*keep, "p.*")


def errors(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", mape: str = "nonzero", epsilon: float = 5.0) -> DataFrame:
    """MAE, RMSE, MAPE and bias; rows with a null are masked. MAPE skips small
    truths (``small``), zeros (``nonzero``), or clamps its denominator (``clamped``)."""
    e = F.col(predicted) - F.col(actual)
    a = F.abs(F.col(actual))
    share = {"small": F.when(a > 0.01, F.abs(e) / a), "nonzero": F.when(a > 0, F.abs(e) / a), "clamped": F.abs(e) / F.greatest(a, F.lit(epsilon))}[mape]
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), half_up(F.avg(F.abs(e)), 6).alias("mae"), half_up(F.sqrt(F.avg(e * e)), 6).alias("rmse"), half_up(100 * F.avg(share), 4).alias("mape"), half_up(F.avg(e), 6).alias("bias"))


def best_models(measured: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The model with the lowest MAE; the first in ``order`` wins ties."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return measured.groupBy(*by).agg(F.min_by("model", F.struct("mae", place)).alias("best_model"), F.min("mae").alias("mae"))


def calibration(df: DataFrame, by: list[str], level: int = 95) -> DataFrame:
    """Coverage and mean width of intervals mean -+ z * std, and the gap between mean deviation and mean error."""
    b = traffic.interval("predicted", "std", level)
    rows = df.withColumn("__b", b)
    inside = F.when(F.col("actual").between(F.col("__b.lower"), F.col("__b.upper")), 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(half_up(F.avg(inside), 6).alias("picp"), half_up(F.avg(F.col("__b.upper") - F.col("__b.lower")), 6).alias("mpiw"), half_up(F.abs(F.avg("std") - F.avg(F.abs(F.col("actual") - F.col("predicted")))), 6).alias("ece"))


def ensemble(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation over models."""
    return df.groupBy(*by).agg(half_up(F.avg("predicted"), 6).alias("predicted"), half_up(F.stddev_pop("predicted"), 6).alias("std"), F.first("actual").alias("actual"))


def monte_carlo(df: DataFrame, by: list[str], base: str = "predicted", draws: int = 20, spread: float = 0.1, seed: int = 42) -> DataFrame:
    """Mean, deviation and interval of ``draws`` noisy copies of a forecast.

    A draw is normal by the hash of its row's key, its number and the seed, so it is the same however the table is split."""
    draw = df.select(*by, F.col(base), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("__draw"))
    name = F.md5(F.concat_ws("|", *[F.col(x).cast("string") for x in by], F.col("__draw").cast("string"), F.lit(str(seed))).cast("binary"))
    share = lambda at: (F.conv(F.substring(name, at, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    normal = F.sqrt(-2.0 * F.log(share(1))) * F.cos(2.0 * math.pi * share(13))
    noisy = draw.withColumn("v", F.col(base) * (1 + normal * spread))
    out = noisy.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.withColumn("bounds", traffic.interval("mean", "std"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, deviation, extremes and the 95 % interval of the mean."""
    v = F.col(value)
    mean, std, n = F.avg(v), F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.count(v)
    half = 1.96 * std / F.sqrt(n)
    return df.groupBy(*by).agg(n.alias("n"), half_up(mean, 4).alias("mean"), half_up(F.median(v), 4).alias("median"), half_up(std, 4).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), half_up(mean - half, 4).alias("ci_low"), half_up(mean + half, 4).alias("ci_high"))


def travel_measures(df: DataFrame, by: list[str], seconds: str, hours: float = 1.0) -> DataFrame:
    """Mean, median, 95th percentile and longest travel time, and throughput an hour."""
    s = F.col(seconds)
    return df.groupBy(*by).agg(half_up(F.avg(s), 2).alias("mean_s"), half_up(F.median(s), 2).alias("median_s"), half_up(F.percentile(s, 0.95), 2).alias("p95_s"), F.max(s).alias("max_s"), half_up(F.count(s) / hours, 2).alias("throughput"))


def improvement(before, after, lower_is_better: bool = True) -> Column:
    """Percent; 0 for a baseline of 0."""
    gain = c(before) - c(after) if lower_is_better else c(after) - c(before)
    return half_up(F.coalesce(F.try_divide(100.0 * gain, c(before)), F.lit(0.0)), 2)
