"""Repeated passages by content-defined chunks.

1. A gear hash rolls over the bytes of a text; a chunk ends where the hash of the
   last ``WINDOW`` bytes is the least of all within ``REACH`` bytes on either side,
   so that the same passage is cut alike wherever it stands, and an insertion shifts
   no cut beyond its neighbourhood. Such ends are ``REACH`` + 1 bytes apart at least
   and seldom over three times as much, so a passage loses little before its first
   and after its last common end. A chunk without an end for long is cut at a fixed
   length. The rolling hash is taken for all positions at once: the hash over 2k bytes
   is that over the last k plus the shifted one over the k before.
2. Digests of chunks are counted over the whole corpus, pre-aggregated; those that occur
   once go, and so do stretches of the others that are too short for a passage.
3. Every place that is left gets the hashes of the next 1, 2, 4 and 8 chunks. Sorted by
   these, in range partitions, a place stands next to the places with which it has the most
   chunks in common. It is linked with both its neighbours, over so many chunks as agree.
4. Links of one text with one other text at one distance that touch or overlap make a
   passage. So a passage as a whole occurs at the other place too: chunks that are shared
   with different texts are never joined to one that stands nowhere else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, Words, blocks, code_points, materialize, mix64, ship_package, whole_groups

#: Bytes that the rolling hash sees, and to how many on either side an end's hash is compared.
WINDOW, REACH = 8, 11
#: Most bytes of a chunk.
MOST_CHUNK = 2048
#: Fewest code points of a passage for which a document is reported: over 50 words of one letter or more, and the gaps.
LEAST_RUN = 101
#: A chunk's length is held in so many bits beside its start.
LENGTH_BITS = 12
#: Numbers of chunks whose hashes a place is sorted by.
STEPS = (1, 2, 4, 8)

_GEAR = (mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)
_HASHED = Words(NOT_SPACE, lower=False)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at each position (fewer at the start)."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the last ``width`` values at each position (fewer at the start)."""
    low, done = h.copy(), 1
    while done < width:
        step = min(done, width - done)
        low[step:] = np.minimum(low[step:], low[:-step])
        done += step
    return low


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of chunks (exclusive) of consecutive texts, each text's end among them."""
    n = len(data)
    h = gear_hashes(data)
    h[:-1][(data[1:] & 0xC0) == 0x80] = np.iinfo(h.dtype).max  # no end inside a code point
    low = _least(h, REACH)
    inner = h[REACH : n - REACH]
    ends = np.flatnonzero((inner < low[REACH - 1 : n - REACH - 1]) & (inner <= low[2 * REACH :])) + REACH + 1
    text = np.searchsorted(offsets, ends - 1, side="right") - 1
    # all that was compared lies in one text
    ends = ends[(ends - offsets[text] >= WINDOW + REACH) & (ends + REACH <= offsets[text + 1])]
    ends = np.union1d(ends, offsets[1:])
    ends = ends[ends > 0]
    starts = np.append(0, ends[:-1])
    long = np.flatnonzero(ends - starts > MOST_CHUNK)
    if len(long):
        more = []
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for at in range(s + MOST_CHUNK, e, MOST_CHUNK):
                while at > s and (data[at] & 0xC0) == 0x80:
                    at -= 1
                more.append(at)
        ends = np.union1d(ends, np.array(more, np.int64))
    return ends


def _chunked(batches):
    for batch in batches:
        for row, data, offsets in blocks(batch.column(2)):
            if not len(data):
                continue
            ends = cuts(data, offsets)
            starts = np.append(0, ends[:-1])
            digests = _HASHED.hashes(data, starts, ends).view(np.int64)
            points = code_points(data)
            text = np.searchsorted(offsets, starts, side="right") - 1
            begin = points[starts] - points[offsets[text]]
            at = (begin << LENGTH_BITS) | (points[ends] - points[starts])
            take = pa.array(text + row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at), pa.array(digests)], names=["row", "id", "at", "digest"])


def _looked_ahead(least: int):
    """Rows of shared chunks, sorted by text and place: hashes and code points of the next
    1, 2, 4 and 8 chunks that stand side by side (0 code points: there aren't so many)."""

    def run(batches):
        for table in whole_groups(batches, "row"):
            row, at = table["row"].to_numpy(), table["at"].to_numpy()
            start, n = at >> LENGTH_BITS, at & ((1 << LENGTH_BITS) - 1)
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            run_of = np.cumsum(new) - 1
            end = start + n
            keep = pa.array(((end[last] - start[first]) >= least)[run_of])
            hashes, lengths = [table["digest"].to_numpy().astype(np.int64).view(np.uint64)], [n]
            place = np.arange(len(at))
            for k in STEPS[1:]:
                there = place + k - 1 <= last[run_of]
                half, more = hashes[-1], np.zeros(len(at), np.uint64)
                more[: max(0, len(at) - k // 2)] = half[k // 2 :]
                hashes.append(np.where(there, mix64(half * np.uint64(0x9E3779B97F4A7C15) + mix64(more + np.uint64(k))), np.uint64(0)))
                lengths.append(np.where(there, end[np.minimum(place + k - 1, len(at) - 1)] - start, 0))
            columns = [table["row"].combine_chunks(), table["id"].combine_chunks(), table["at"].combine_chunks(), *[pa.array(h.view(np.int64)) for h in hashes], *[pa.array(x.astype(np.int32)) for x in lengths]]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "at", *_HASHES, *_LENGTHS]).filter(keep)

    return run


_HASHES, _LENGTHS = [f"h{k}" for k in STEPS], [f"n{k}" for k in STEPS]
_LINK, _EDGE = 0, 1


def _linked(batches):
    """Places sorted by their hashes: links (row, id, start, n, partner, away) of neighbours, both ways,
    and the first and last place of the partition."""
    names = ["kind", "row", "id", "start", "n", "partner", "away", "last", *_HASHES, *_LENGTHS]
    held = first = None

    def edge(batch: pa.RecordBatch, last: int):
        own = [batch.column(k) for k in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays([pa.array([_EDGE], pa.int32()), own[0], own[1], pa.array(own[2].to_numpy() >> LENGTH_BITS), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([last], pa.int32()), *own[3:]], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        first = first or edge(batch.slice(0, 1), 0)
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        held = batch.slice(batch.num_rows - 1)
        if table.num_rows < 2:
            continue
        agree, length = np.ones(table.num_rows - 1, bool), np.zeros(table.num_rows - 1, np.int32)
        for h, n in zip(_HASHES, _LENGTHS, strict=True):
            hashes, points = table[h].to_numpy(), table[n].to_numpy()
            agree &= (hashes[1:] == hashes[:-1]) & (points[1:] > 0) & (points[:-1] > 0)
            length = np.where(agree, points[:-1], length)
        i = np.flatnonzero(length > 0)
        if not len(i):
            continue
        own, other = np.concatenate([i, i + 1]), np.concatenate([i + 1, i])
        row, start = table["row"].to_numpy(), table["at"].to_numpy() >> LENGTH_BITS
        nothing = [pa.nulls(len(own), pa.int32()), *[pa.nulls(len(own), pa.int64())] * len(STEPS), *[pa.nulls(len(own), pa.int32())] * len(STEPS)]
        ids = table["id"].combine_chunks().take(pa.array(own))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), _LINK, np.int32)), pa.array(row[own]), ids, pa.array(start[own]), pa.array(np.tile(length[i], 2)), pa.array(row[other]), pa.array(start[other] - start[own]), *nothing], names=names)
    if held is not None:
        yield first
        yield edge(held, 1)


def _places(rows: DataFrame, least: int) -> DataFrame:
    """Places of chunks that occur twice or more, in stretches of ``least`` code points or more."""
    kind = rows.schema["id"].dataType.simpleString()
    chunks = materialize(rows.mapInArrow(_chunked, f"row bigint, id {kind}, at bigint, digest bigint"), "chunks")
    # a digest's rows are pre-aggregated in every task; a common chunk's join can be split
    common = materialize(chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "common")
    shared = chunks.join(common, "digest").select("row", "id", "at", "digest").repartition("row").sortWithinPartitions("row", "at")
    columns = ", ".join([f"row bigint, id {kind}, at bigint", *[f"{h} bigint" for h in _HASHES], *[f"{n} int" for n in _LENGTHS]])
    return materialize(shared.mapInArrow(_looked_ahead(least), columns), "places")


def _links(places: DataFrame) -> DataFrame:
    """(row, id, start, n, partner, away): n code points from start on stand in text ``partner`` too, ``away`` further on."""
    kind = places.schema["id"].dataType.simpleString()
    order = [*_HASHES, F.col("id").asc_nulls_last(), "row", "at"]
    dealt = places.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ", ".join([f"kind int, row bigint, id {kind}, start bigint, n int, partner bigint, away bigint, last int", *[f"{h} bigint" for h in _HASHES], *[f"{n} int" for n in _LENGTHS]])
    found = materialize(dealt.mapInArrow(_linked, columns).withColumn("part", F.spark_partition_id()), "links")
    names = ["row", "id", "start", "n", "partner", "away"]
    # across partitions: the last place of one and the first of the next; two rows a partition
    edges = found.where(F.col("kind") == _EDGE)
    w = Window.orderBy("part", "last")
    after = edges.select("*", *[F.lead(c).over(w).alias(f"{c}_") for c in ("row", "id", "start", "last", *_HASHES, *_LENGTHS)]).where("last = 1 and last_ = 0")
    length, agree = F.lit(0), F.lit(True)
    for h, n in zip(_HASHES, _LENGTHS, strict=True):
        agree = agree & (F.col(h) == F.col(f"{h}_")) & (F.col(n) > 0) & (F.col(f"{n}_") > 0)
        length = F.when(agree, F.col(n)).otherwise(length)
    after = after.withColumn("n", length).where("n > 0")
    there = after.select("row", "id", "start", "n", F.col("row_").alias("partner"), (F.col("start_") - F.col("start")).alias("away"))
    back = after.select(F.col("row_").alias("row"), F.col("id_").alias("id"), F.col("start_").alias("start"), "n", F.col("row").alias("partner"), (F.col("start") - F.col("start_")).alias("away"))
    return found.where(F.col("kind") == _LINK).select(*names).unionByName(there).unionByName(back)


def _matched(links: DataFrame, least: int) -> DataFrame:
    """(row, id, start, end) of the longest passages: links with one partner at one distance that touch or
    overlap are one, and a passage within another of its text goes."""
    links = links.withColumn("end", F.col("start") + F.col("n"))
    w = Window.partitionBy("row", "partner", "away").orderBy("start")
    new = F.col("start") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = links.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("row", "partner", "away", "run").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= least)
    before = Window.partitionBy("row").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(-1))).where("end > covered").select("row", "id", "start", "end")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _passages(rows: DataFrame, least: int) -> DataFrame:
    """(row, id, start, end, removed, cut) of the passages of (row, id, text)."""
    places = _places(rows, least)
    found = materialize(_matched(_links(places), least), "passages")
    # the first occurrence of every chunk in order of id, row and place stays
    first = materialize(places.groupBy(F.col("h1").alias("digest")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")).alias("f")).select("digest", F.col("f.row").alias("row_"), F.col("f.at").alias("at_")), "first")
    again = places.withColumnRenamed("h1", "digest").join(first, "digest").where("row <> row_ or at <> at_").select("row", F.shiftright("at", LENGTH_BITS).alias("start"), (F.shiftright("at", LENGTH_BITS) + F.col("n1")).alias("end"))
    again = again.join(found.select("row").distinct(), "row", "left_semi")
    # passages of a text begin and end in the same order: a chunk lies in one if it does in the last that has begun
    nothing = F.lit(None).cast("bigint")
    both = found.select("row", "id", "start", "end", F.lit(0).alias("chunk")).unionByName(again.select("row", nothing.cast(found.schema["id"].dataType).alias("id"), "start", "end", F.lit(1).alias("chunk")))
    w = Window.partitionBy("row").orderBy("start", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("chunk") == 0, F.struct("id", "start", "end")), ignorenulls=True).over(w)
    held = both.withColumn("passage", own).where("chunk = 0 or end <= passage.end")
    cut = F.array_sort(F.collect_list(F.when(F.col("chunk") == 1, F.struct("start", "end"))))
    each = held.groupBy("row", F.col("passage.start").alias("start")).agg(F.first("passage.id").alias("id"), F.first("passage.end").alias("end"), F.sum(F.when(F.col("chunk") == 1, F.col("end") - F.col("start")).otherwise(0)).alias("removed"), cut.alias("cut"))
    return each.select("row", "id", "start", "end", "removed", "cut")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(row, id, start, end, removed) of every repeated passage of ``least`` code points
    or more, in code points. As a whole it stands at another place too, in another text or
    in the same one. A passage that lies within a longer one has no row.

    removed counts the code points of chunks that occurred before, in order of
    id; the first occurrence stays. A passage that one text repeats counts like
    one that several texts share. Null, empty and clean texts have no rows here.
    Rows with one id are texts of their own, in the order in which they are read.
    Very long texts are cut and compared like others. Extra columns of ``docs``,
    whatever their names, take no part. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    return _passages(_numbered(docs, id_col, text_col), least).select("row", "id", "start", "end", "removed")


def repeated_documents(docs: DataFrame, least: int = LEAST_RUN, **names) -> DataFrame:
    """One row for each text with passages of ``least`` code points: id, n_passages, repeated and
    removed code points, and the passages as start:end, comma-joined."""
    found = repeated_passages(docs, least=least, **names)
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    own = found.groupBy("row").agg(F.first("id").alias("id"), F.count("*").alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_chars"), F.sum("removed").alias("removed_chars"), spans.alias("spans"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return own.select("id", "n_passages", "repeated_chars", "removed_chars", text.alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_RUN) -> DataFrame:
    """``docs`` with the chunks of repeated passages cut out of their texts wherever
    they occurred before; the first occurrence stays, in order of id (a null one last).

    Null texts stay null, and empty and clean ones as they are. Equal rows are texts of
    their own: the first of them keeps its passages, the others lose all that
    can be cut. All columns return, whatever their names; an empty table gives an empty one."""
    ship_package(docs.sparkSession)
    held = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "held")
    rows = held.select("row", F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].cast("string").alias("text"))
    cut = _passages(rows, least).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("cut"))).alias("cut"))
    text = F.col("doc")[text_col].cast("string")
    part = lambda at, n: F.substring(text, (at + 1).cast("int"), n.cast("int"))
    kept = F.aggregate(
        "cut",
        F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.struct(F.concat(done["t"], part(done["at"], s["start"] - done["at"])).alias("t"), s["end"].alias("at")),
        lambda done: F.concat(done["t"], part(done["at"], F.length(text))),
    )
    changed = F.when(F.col("cut").isNotNull(), kept).otherwise(text)
    return held.join(cut, "row", "left").select(*[changed.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
