"""Evidence fusion of noisy keys: consensus, votes, and the fused identity of a table's tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..streaming import evidence


def variant_consensus(obs: DataFrame, keys: list[str]) -> DataFrame:
    """The best text of a frame's variants: highest confidence plus a little for each
    further vote; a longer text within 0.10 that holds the winner in order replaces it."""
    votes = obs.groupBy(*keys, F.col("norm_text").alias("text")).agg((F.max("ocr_conf") + 0.005 * (F.count("*") - 1)).alias("score"), F.max("ocr_conf").alias("conf"), F.count("*").alias("votes"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("score", "votes", "text", "conf")).alias("b"))
    pairs = votes.join(best, keys)
    longer = (F.length("text") > F.length("b.text")) & (F.col("conf") >= F.col("b.conf") - 0.10) & text.is_subsequence("b.text", "text")
    pick = F.when(longer, F.struct(F.length("text").alias("n"), "score", "text"))
    out = pairs.groupBy(*keys, "b").agg(F.max(pick).alias("l"))
    return out.select(*keys, F.coalesce("l.text", "b.text").alias("text"), F.coalesce("l.score", "b.score").alias("score"))


def voted(members: DataFrame, keys: list[str]) -> DataFrame:
    """Character vote: the length and then each position with the most evidence."""
    size = members.groupBy(*keys, F.length("norm_text").alias("n")).agg(F.sum("score").alias("w")).groupBy(*keys).agg(F.max_by("n", F.struct("w", "n")).alias("n"))
    chars = members.join(size, keys).where(F.length("norm_text") == F.col("n")).select(*keys, "score", F.posexplode(F.split("norm_text", "")).alias("at", "ch"))
    best = chars.groupBy(*keys, "at", "ch").agg(F.sum("score").alias("w"), F.max("score").alias("m")).groupBy(*keys, "at").agg(F.max_by("ch", F.struct("w", "m", "ch")).alias("ch"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ch"))), lambda s: s["ch"]), "").alias("voted"))


def fused(obs: DataFrame) -> DataFrame:
    """The identity of each track with its agreement, confidence and status, after its last reading.

    ``obs``: track_id, frame_id, variant, seq, norm_text, ocr_conf, valid_conf, quality."""
    last = evidence.fused_table(evidence.readings(obs))
    return last.select("track_id", "key", "score", "agreement", "confidence", "status", "cluster_frames", F.col("frames").alias("all_frames"))
