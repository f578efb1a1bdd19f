"""Benchmark decontamination with an FM-index per training shard.

A shard is one Arrow record batch of documents inside a task. Its words become
ids of the benchmark's vocabulary; stretches of benchmark words long enough to
hold a window are joined, with separators, to the sequence that is indexed:
suffix order, Burrows-Wheeler transform, wavelet matrix for ranks, and sampled
suffix positions. Every benchmark window is then searched backward, all windows
at once, and its occurrences are located and merged to removal spans.

A word outside the benchmark's vocabulary can be in no window, and neither can
a stretch shorter than the shortest window, so leaving them out of the index
loses nothing. Index and search need memory in proportion to one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, blocks, code_points, refuse_clash, ship_package

#: Words of a window.
WINDOW = 10
#: The benchmark is searched in blocks of items with at most so many bytes of text, one broadcast each.
BLOCK_OF_ITEMS = 32 << 20
#: Every so many positions of a shard keep their place in the text.
SAMPLE_EVERY = 8

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False), False),
    ]
)


class Windows:
    """The distinct windows of a block of items, over the vocabulary of the block."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        split = Words(ALNUM)
        hashes, owners = [], []
        texts = pa.array([t for _, t in items], pa.string())
        for row, data, offsets in blocks(texts):
            starts, ends, counts = split.spans(data, offsets)
            owned = np.split(split.hashes(data, starts, ends), np.cumsum(counts)[:-1])
            for k, words in enumerate(owned):
                if len(words):
                    hashes.append(words)
                    owners.append(row + k)
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        #: By length: word ids (2 and up) of each distinct window, and its items.
        found: dict[int, dict[bytes, set[str]]] = {}
        for words, owner in zip(hashes, owners, strict=True):
            ids = (np.searchsorted(self.vocabulary, words) + 2).astype(np.int32)
            n = min(size, len(ids))
            for window in np.lib.stride_tricks.sliding_window_view(ids, n):
                found.setdefault(n, {}).setdefault(window.tobytes(), set()).add(items[owner][0])
        self.by_length = {n: (np.array([np.frombuffer(k, np.int32) for k in own]), [sorted(v) for v in own.values()]) for n, own in found.items()}
        self.shortest = min(self.by_length, default=0)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of words, 0 for others."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.near[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 2, 0)
        return out


class FMIndex:
    """Backward search over a sequence of ids from 1 up; 0 is the end mark."""

    def __init__(self, ids: np.ndarray, sample_every: int = SAMPLE_EVERY):
        text = np.append(ids, 0).astype(np.int64)
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.append(False, np.diff(text[order]) != 0))
        width = 1
        while rank[order[-1]] < n - 1:
            key = rank * n + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            rank = np.zeros(n, np.int64)
            rank[order] = np.cumsum(np.append(False, np.diff(key[order]) != 0))
            width *= 2
        del rank
        bwt = text[order - 1].astype(np.int32)
        top = int(text.max()) + 1
        self.n = n
        #: Ids smaller than each id in the text.
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=top)))
        self.levels = max(1, int(top - 1).bit_length())
        #: Ones before each place of each level, and zeros of each level.
        self.ones, self.zeros = [], []
        row = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt = bwt
        self.sampled = order % sample_every == 0
        self.sample_rank = np.append(0, np.cumsum(self.sampled, dtype=np.int32))
        self.samples = order[self.sampled]

    def ranks(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each id stands before row ``at`` of the transform."""
        low = np.zeros(len(at), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((ids >> level) & 1).astype(bool)
            ones = self.ones[k]
            at = np.where(one, self.zeros[k] + ones[at], at - ones[at])
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern, one pattern a row."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        known = (patterns < len(self.smaller) - 1).all(axis=1)
        high[~known] = 0
        live = np.flatnonzero(known)
        for column in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            ids = patterns[live, column].astype(np.int64)
            low[live] = self.smaller[ids] + self.ranks(ids, low[live])
            high[live] = self.smaller[ids] + self.ranks(ids, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled row, count the steps."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            hit = self.sampled[here]
            out[open_[hit]] = self.samples[self.sample_rank[here[hit]]] + steps
            open_, here = open_[~hit], here[~hit]
            ids = self.bwt[here]
            rows[open_] = self.smaller[ids] + self.ranks(ids, here)
            steps += 1
        return out % self.n


def scan_texts(texts: pa.Array, windows: Windows, split: Words) -> dict[str, list]:
    """FOUND's columns for each text of one shard."""
    n = len(texts)
    n_words = np.zeros(n, np.int64)
    seqs, docs, begins, ends_ = [], [], [], []
    least = windows.shortest
    for row, data, offsets in blocks(texts):
        starts, ends, counts = split.spans(data, offsets)
        n_words[row : row + len(counts)] = counts
        if not least or not len(starts):
            continue
        ids = windows.ids(split.hashes(data, starts, ends))
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = ids > 0
        edge = np.ones(len(ids), bool)
        edge[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(edge)
        length = np.diff(np.append(begin, len(ids)))
        keep = np.repeat(inside[begin] & (length >= least), length)
        if not keep.any():
            continue
        points = code_points(data)
        at = np.flatnonzero(keep)
        # a separator stands before each stretch
        new = np.flatnonzero(edge[at])
        put = lambda values, fill: np.insert(values, new, fill)
        seqs.append(put(ids[at], 1))
        docs.append(put(doc[at] + row, -1))
        base = points[offsets[doc[at]]]
        begins.append(put(points[starts[at]] - base, 0))
        ends_.append(put(points[ends[at]] - base, 0))
    out = {"n_words": n_words, "n_hit": np.zeros(n, np.int64), "items": [[] for _ in range(n)], "spans": [[] for _ in range(n)]}
    if not seqs:
        return out
    seq, doc, begin, end = (np.concatenate(x) for x in (seqs, docs, begins, ends_))
    index = FMIndex(seq)
    change = np.zeros(len(seq) + 1, np.int64)
    owned: dict[int, set[str]] = {}
    for size, (patterns, items) in windows.by_length.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        if not len(hit):
            continue
        rows = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = index.locate(rows)
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        pairs = np.unique(np.stack([doc[at], np.repeat(hit, many)]), axis=1)
        for d, w in zip(*pairs.tolist(), strict=True):
            owned.setdefault(d, set()).update(items[w])
    covered = np.cumsum(change[:-1]) > 0
    np.add.at(out["n_hit"], doc[covered], 1)
    for d, own in owned.items():
        out["items"][d] = sorted(own)
    if not owned:
        return out
    at = np.flatnonzero(covered)
    # neighbouring covered words of one text merge to a span
    joined = np.zeros(len(at), bool)
    joined[1:] = np.diff(at) == 1
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(at)) - 1
    for d, b, e in zip(doc[at[first]].tolist(), begin[at[first]].tolist(), end[at[last]].tolist(), strict=True):
        out["spans"][d].append({"start": b, "end": e})
    return out


_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_OF_ITEMS) -> Iterator[list[tuple[str, str]]]:
    """The stated items in blocks of bounded size; items without text are left out."""
    block, size = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col))
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, out: str = "found") -> DataFrame:
    """All columns of ``docs`` and a struct column ``out``: n_words, n_hit (words
    inside any occurrence of a window), items (ids, sorted as strings) and the
    merged removal spans (code points, end exclusive).

    Null or empty text: no words, nothing found. Every row is treated for
    itself, so repeated rows and ids give repeated results. A benchmark item without
    an id or a text is left out, as no id could be reported. A very long text is
    indexed whole. A column named ``out`` that ``docs`` already has is an error. An
    empty table gives no rows, an empty benchmark
    finds nothing. A benchmark over ``BLOCK_OF_ITEMS`` is searched block by
    block and the findings are merged in place.
    """
    spark = docs.sparkSession
    refuse_clash(docs, out)
    ship_package(spark)
    result, found = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text")), []
    for k, block in enumerate(item_blocks(benchmark, item_col, item_text_col) if benchmark is not None else []):
        result = _with_block(result, spark.sparkContext.broadcast(Windows(block, window)), f"found_{k}")
        found.append(F.col(f"found_{k}"))
    if not found:
        result = _with_block(result, spark.sparkContext.broadcast(Windows([], window)), "found_0")
        found.append(F.col("found_0"))
    return result.select("row.*", _merged(found).alias(out))


def _with_block(df: DataFrame, shared, name: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, FOUND)])

    def shard(batches):
        split = Words(ALNUM)
        for batch in batches:
            got = scan_texts(batch.column(batch.schema.get_field_index("text")), shared.value, split)
            columns = [pa.array(got["n_words"]), pa.array(got["n_hit"]), pa.array(got["items"], pa.list_(pa.string())), pa.array(got["spans"], _FOUND_ARROW.field("spans").type)]
            found = pa.StructArray.from_arrays(columns, fields=list(_FOUND_ARROW))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return df.mapInArrow(shard, schema)


def _merged(found: list[Column]) -> Column:
    """Findings of several blocks as one; covered words are counted anew from the spans of all blocks only where two blocks hit one text."""
    if len(found) == 1:
        return found[0]
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[c["items"] for c in found]))))
    spans = F.array_sort(F.flatten(F.array(*[c["spans"] for c in found])))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    merged = F.aggregate(
        spans,
        empty,
        lambda done, x: F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    hits = F.aggregate(merged, F.lit(0).cast("long"), lambda n, s: n + F.size(F.regexp_extract_all(F.lower(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), F.lit(word), F.lit(0))))
    alone = sum((F.when(c["n_hit"] > 0, 1).otherwise(0) for c in found[1:]), F.when(found[0]["n_hit"] > 0, 1).otherwise(0)) <= 1
    single = sum((c["n_hit"] for c in found[1:]), found[0]["n_hit"])
    return F.struct(found[0]["n_words"].alias("n_words"), F.when(alone, single).otherwise(hits).alias("n_hit"), items.alias("items"), merged.alias("spans"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs.

    Texts that are null or empty, and all if the benchmark is empty, stay; repeated
    rows stay or go together.
    """
    return annotate(docs, benchmark, out="__found", **names).where(F.col("__found.n_hit") == 0).drop("__found")


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts; null stays null."""
    found = annotate(docs, benchmark, text_col=text_col, out="__found", **names)
    keep = F.aggregate(
        F.col("__found.spans"),
        F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.struct(F.concat(done["t"], F.substring(F.col(text_col), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))).alias("t"), s["end"].alias("at")),
        lambda done: F.concat(done["t"], F.substring(F.col(text_col), (done["at"] + 1).cast("int"), F.length(text_col))),
    )
    return found.withColumn(text_col, F.when(F.col("__found.n_hit") > 0, keep).otherwise(F.col(text_col))).drop("__found")
