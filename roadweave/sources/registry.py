"""Source registry, hash ledger and classification counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.traffic import half_up, trust_label


def verified(shown: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Compare hashes with the ledger: VERIFIED, FAILED, or REGISTERED where the key is new."""
    status = F.when(F.col("registered").isNull(), "REGISTERED").when(F.col("registered") == F.col("hash"), "VERIFIED").otherwise("FAILED")
    return shown.join(ledger, key, "left").withColumn("status", status)


def new_entries(shown: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """What a ledger lacks, to be appended to it."""
    return shown.join(ledger, key, "left_anti").select(key, F.col("hash").alias("registered"))


def with_trust(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Trust and provenance columns of each row's source; the registry has one row a source."""
    return df.join(registry.select(key, "trust"), key, "left").withColumn("trust_label", trust_label(F.coalesce("trust", F.lit(0.0)))).withColumn("provenance", F.lit("OBSERVED"))


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """TP, FN, FP, TN, precision, recall and F1."""
    n = lambda t, s: F.count_if(t & s)
    c = df.agg(n(truth, said).alias("tp"), n(truth, ~said).alias("fn"), n(~truth, said).alias("fp"), n(~truth, ~said).alias("tn"))
    ratio = lambda a, b: half_up(F.try_divide(a, b), 4)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
