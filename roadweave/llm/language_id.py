"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (of all lengths in
``ORDERS``, a blended spectrum) present in both, over the root of the product of
the numbers present in each. Landmark texts span the Nyström approximation: a
text's features are its kernel values with the landmarks, whitened by their own
kernel matrix. One ridge regression for each language against the rest is fitted
on these features. Every whole text is scored, a block of texts at a time, by
matrix products.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, ship_package

#: Lengths of the n-grams, in bytes; each has a table of so many hashed places.
ORDERS, PLACES = (2, 3, 4), 1 << 14
#: The bounded sample: labelled texts a language, and landmarks a language among them.
SAMPLE, LANDMARKS = 300, 16
RIDGE = 1e-2
#: Texts that are scored together.
TOGETHER = 64
_MAYBE_LETTER = re.compile(r"[^\W\d_]+")
_WIDTH = PLACES * len(ORDERS)


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter by Unicode; signs such as the superscript two aren't."""
    return any(c.isalpha() for m in _MAYBE_LETTER.finditer(text) for c in m[0])


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    return table


_LOWER = _lower()


def presence(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Set ``out[i, place]`` for every n-gram of text i. A text shorter than an n-gram has none."""
    low = _LOWER[data]
    code = low.copy()
    n = len(low)
    for order in range(2, max(ORDERS) + 1):
        if n < order:
            return
        code = (code[: n - order + 1] << np.uint32(8)) | low[order - 1 :]
        if order not in ORDERS:
            continue
        place = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (PLACES.bit_length() - 1))).astype(np.int64) + ORDERS.index(order) * PLACES
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1] - order + 1
            if b > a:
                out[i, place[a:b]] = 1


def kernel_rows(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), _WIDTH), np.uint8)
    for row, data, offsets in blocks(texts):
        presence(data, offsets, out[row : row + len(offsets) - 1])
    return out


@dataclass
class Model:
    languages: list[str]
    #: Places that any landmark has, and the map from presence there to scores.
    weights: np.ndarray  # float32[_WIDTH, languages]
    bias: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.int64)))
        return (rows.astype(np.float32) @ self.weights) / norm[:, None].astype(np.float32) + self.bias


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features and one ridge regression a language. The features are
    linear in the kernel values, and these in the presence rows, so the whole
    map from presence to scores folds into one matrix."""
    names = sorted(set(languages))
    rows = kernel_rows(pa.array(texts, pa.string()))
    norm = np.sqrt(np.maximum(1, rows.sum(axis=1, dtype=np.int64))).astype(np.float64)
    label = np.array([names.index(x) for x in languages])
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(names))])
    marks = rows[chosen].astype(np.float64) / norm[chosen, None]
    within = marks @ marks.T
    values, vectors = np.linalg.eigh(within)
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.concatenate([(r.astype(np.float64) @ marks.T) @ whiten for r in np.array_split(rows, max(1, len(rows) // 256))]) / norm[:, None]
    mean = features.mean(axis=0)
    centred = features - mean
    target = (label[:, None] == np.arange(len(names))[None, :]).astype(np.float64)
    prior = target.mean(axis=0)
    solved = np.linalg.solve(centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1]), centred.T @ (target - prior))
    return Model(names, (marks.T @ (whiten @ solved)).astype(np.float32), (prior - mean @ solved).astype(np.float32))


def sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str, each: int = SAMPLE) -> list[tuple[str, str]]:
    """Up to ``each`` (text, language) a language, those with the smallest hashes of
    their ids. Ids alone are ranked, with a limit kept in every partition before
    anything is shuffled; the chosen ones, a bounded list, are broadcast to the texts."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.select("lang", "id").withColumn("at", at).where(F.col("at") <= each)
    found = rows.join(F.broadcast(chosen.groupBy("lang", "id").agg(F.min("at").alias("at"))), ["lang", "id"]).groupBy("lang", "id").agg(F.min("at").alias("at"), F.min("text").alias("text"))
    return [(r["text"], r["lang"]) for r in sorted(found.toLocalIterator(), key=lambda r: (r["lang"], r["at"]))]


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, each: int = SAMPLE) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``.

    Learns from ``train`` (default: the rows of ``docs`` that aren't held out) with
    non-null text and language, ``each`` texts a language at most; languages,
    sources and ids take no part in a prediction. lang_pred is ``und`` with score
    0 if the text is null or has no letter, or if there was nothing to learn
    from; score is the winning share of the non-negative one-versus-rest outputs.
    Repeated rows get equal results; an empty table gives none. Very long texts are
    scored whole. Extra columns of ``docs``, whatever their names, take no part.
    """
    spark = docs.sparkSession
    ship_package(spark)
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("string")) % 5 == 0
    held_out = F.coalesce(held_out, F.lit(False))
    learned = sample(train if train is not None else docs.where(~held_out), lang_col, text_col, id_col, each)
    model = spark.sparkContext.broadcast(fit(*map(list, zip(*learned, strict=True))) if learned else None)  # bounded by places and languages

    def predict(batches):
        for batch in batches:
            texts, m = batch.column(2), model.value
            names, best = [], []
            for at in range(0, len(texts), TOGETHER):
                some = texts.slice(at, TOGETHER)
                letters = [t is not None and has_letter(t) for t in some.to_pylist()]
                if m is None:
                    names += ["und"] * len(some)
                    best += [0.0] * len(some)
                    continue
                s = np.maximum(m.scores(kernel_rows(some)), 0)
                top = s.argmax(axis=1)
                share = s[np.arange(len(s)), top] / np.maximum(s.sum(axis=1), 1e-9)
                for ok, k, p in zip(letters, top.tolist(), share.tolist(), strict=True):
                    names.append(m.languages[k] if ok else "und")
                    best.append(min(1.0, max(0.0, p)) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {id_type}, held_out boolean, lang_pred string, score double")
