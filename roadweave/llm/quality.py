"""Quality rules: countable features and a hashed n-gram log-likelihood ratio.

Everything is DataFrame expressions. One pass counts the hashed words and word
pairs of the raw corpus (all texts) and of the trusted texts among them; the
counts of ``PLACES`` hashed places, half of them for words and half for pairs, are
the two multinomials. The second pass gives every text its base features and the
mean log ratio of its n-grams, and keeps it if no base rule fails and the mean is
at the threshold or above. The threshold comes from texts that are known to be
good but weren't counted as trusted: ``MARGIN`` times the spread between their
median and their ``LOW`` quantile below that quantile.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, refuse_clash

#: Hashed places, half for words and half for pairs.
PLACES = 1 << 16
#: Bytes of a trusted id in memory, by which the list of all of them is broadcast or shuffled.
ID_BYTES = 64
#: One of so many trusted texts isn't counted but sets the threshold.
HELD_OUT = 4
#: The low quantile of the held-out texts' scores, and how far under it the threshold lies.
LOW, MARGIN = 0.01, 0.5
#: Weight of the raw distribution in the trusted one, in n-grams.
SMOOTHING = 4096.0
#: Base rules: fewest words, and the largest share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = r"(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++"
_LINE = r"(?<![^\n])[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*+"


def normal(text: Column) -> Column:
    """Words joined by single spaces; null has none."""
    return F.coalesce(F.trim(F.regexp_replace(text, _SPACE, " ")), F.lit(""))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(norm, " "))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(hashes: Column, places: int) -> Column:
    """Places of the words and of the pairs of neighbours; a pair is hashed from its words' hashes."""
    half = F.lit(places // 2)
    pair = lambda a, b: (F.pmod(F.xxhash64(a, b), half) + half + F.when(b.isNull(), None).otherwise(0)).cast("int")
    return F.concat(F.transform(hashes, lambda x: F.pmod(x, half).cast("int")), F.filter(F.zip_with(hashes, F.slice(hashes, 2, F.size(hashes) + 1), pair), lambda x: x.isNotNull()))


def repeated_words(norm: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, compared as strings.

    A text whose windows have different hashes repeats none. Others sort their
    windows, with their places, so that equal ones are neighbours.
    """
    of_three = lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2))
    differ = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    none = F.element_at(F.transform(F.array(F.transform(F.slice(hashes, 1, F.greatest(F.lit(0), F.size(hashes) - 2)), of_three)), differ), 1)
    windows = F.regexp_extract_all(norm, F.lit(_WINDOW), F.lit(1))
    inside = lambda s: F.filter(s, lambda x, i: (x["w"] == F.get(s, i + 1)["w"]) | (x["w"] == F.get(s, i - 1)["w"]))
    covered = lambda s: F.size(F.array_distinct(F.flatten(F.transform(inside(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    sorted_ = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    return F.when(none, F.lit(0)).otherwise(F.element_at(F.transform(F.array(sorted_), covered), 1)).cast("long")


def chosen(trusted: DataFrame, id_col: str = "doc_id", held_out: int = HELD_OUT) -> DataFrame:
    """(__id, __held): every trusted id, and whether one only sets the threshold."""
    order = F.xxhash64(F.col("__id").cast("string"))
    ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    return ids.select("__id", (F.pmod(F.xxhash64(order), F.lit(held_out)) == 0).alias("__held"))


def log_ratios(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_trusted / p_raw) of every place, 0 where the corpus has none or
    nothing is trusted. ``ids``: see ``chosen``."""
    rows = docs.select(F.col(id_col).alias("__id"), normal(F.col(text_col).cast("string")).alias("norm")).join(ids, "__id", "left")
    rows = _once(rows.select("__held", hashed(words_of(F.col("norm"))).alias("hashes")), hashes=F.col("hashes"))
    each = rows.select((~F.col("__held")).alias("good"), F.explode(_places(F.col("hashes"), places)).alias("place"))
    counts = each.groupBy("place").agg(F.count("*").alias("raw"), F.count_if("good").alias("good")).toArrow()  # ``places`` rows at most
    place, raw, good = (counts.column(k).to_numpy() for k in ("place", "raw", "good"))
    out = np.zeros(places)
    if good.sum():
        p = raw / raw.sum()
        out[place] = np.log((good + smoothing * p) / (good.sum() + smoothing) / p)
    return out.round(3).tolist()


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row: what is used above a generator
    isn't put in place of each of its uses, as it would be above a projection."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[x.alias(name) for name, x in columns.items()]))))


def _facts(docs: DataFrame, weights: Column, text_col: str, places: int) -> DataFrame:
    """(__doc, __text, norm, hashes, n_words, mean_ratio) of every row."""
    text = F.coalesce(F.col("__doc")[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("__doc")).withColumn("__text", text).withColumn("norm", normal(F.col("__text")))
    rows = _once(rows, norm=F.col("norm"))
    rows = _once(rows.withColumn("hashes", hashed(words_of(F.col("norm")))), hashes=F.col("hashes"))
    ratio = F.aggregate(_places(F.col("hashes"), places), F.lit(0.0), lambda total, place: total + F.get(weights, place))
    mean = F.when(F.size("hashes") > 0, ratio / (2 * F.size("hashes") - 1)).otherwise(0.0)
    return rows.select("__doc", "__text", "norm", "hashes", F.size("hashes").cast("long").alias("n_words"), F.round(mean, 6).alias("mean_ratio"))


def threshold(docs: DataFrame, ids: DataFrame, weights: Column, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES, low: float = LOW, margin: float = MARGIN) -> float:
    """The least mean log ratio of a kept text: see the head of the module. Without
    held-out texts of enough words everything passes."""
    held = docs.join(ids.where("__held").select(F.col("__id").alias(id_col)), id_col, "left_semi")
    scores = _facts(held, weights, text_col, places).where(F.col("n_words") >= LEAST_WORDS)
    found = scores.agg(F.percentile("mean_ratio", [low, 0.5]).alias("q")).first()["q"]
    return -math.inf if not found else round(found[0] - margin * (found[1] - found[0]), 6)


def assess(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "quality", least: float | None = None, places: int = PLACES, held_out: int = HELD_OUT, smoothing: float = SMOOTHING) -> DataFrame:
    """All columns of ``docs`` and a struct ``out``: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, mean_ratio and kept. ``trusted`` holds
    the ids of trusted texts, ``least`` a threshold instead of the one derived.

    Null or empty text: no words, mean_ratio 0, base_failed (too few words). Every
    row is judged for itself, so repeated rows get equal verdicts. A very long
    text is judged whole. Without any trusted text the ratio is 0 and keeps
    everything. A column named ``out`` that ``docs`` already has is an error. An
    empty table gives none.
    """
    refuse_clash(docs, out)
    ids = broadcast_if_small(materialize(chosen(trusted, id_col, held_out), "trusted"), ID_BYTES)
    weights = F.from_json(F.lit(json.dumps(log_ratios(docs, ids, id_col, text_col, places, smoothing), separators=(",", ":"))), "array<double>")
    if least is None:
        least = threshold(docs, ids, weights, id_col, text_col, places)
    text = F.col("__text")
    lines = F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))
    facts = _facts(docs, weights, text_col, places).select(
        "__doc",
        "n_words",
        F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("norm"), F.col("hashes")).alias("n_repeat_words"),
        "mean_ratio",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    good = F.lit(True) if least == -math.inf else F.col("mean_ratio") >= least
    facts = facts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "mean_ratio", "kept"]
    return facts.select("__doc.*", F.struct(*fields).alias(out))


def keep_good(docs: DataFrame, trusted: DataFrame, **names) -> DataFrame:
    """``docs`` without the rows that the rules reject: null and empty texts go, as they
    have too few words; repeated rows stay or go together."""
    judged = assess(docs, trusted, out="__quality", **names).withColumn("__keep", F.col("__quality.kept")).drop("__quality")
    return _once(judged, __keep=F.col("__keep")).where("__keep").drop("__keep")
