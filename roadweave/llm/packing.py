"""Best-fit decreasing packing of documents into sequences of bounded length.

The pieces to pack have integer lengths of at most the capacity, so the whole
corpus is described by how many pieces there are of each length: at most
``capacity`` numbers. Best-fit decreasing runs over these counts with a segment
tree over remaining capacities: the tightest open bin for a length is found in
logarithmic time, and bins in the same state are filled together, in the order
in which one document after the other would fill them. The result is a plan of
runs, bounded by the capacity alone. Which piece takes which place in a run
follows from its rank in descending order of length; ranks come from a range
partitioning and the prefix sums of its partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship_package
from .encode import encoder
from .token_files import chunks

CAPACITY = 4096
END_ID = 1


class SegmentTree:
    """Counts of open bins by remaining capacity; finds the least capacity at or above one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        i = at + self.size
        while i:
            self.total[i] += n
            i >>= 1

    def first(self, least: int) -> int | None:
        i = least + self.size
        if self.total[i]:
            return least
        while i > 1:
            if not i & 1 and self.total[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.total[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of the best-fit decreasing packing of ``counts[length]`` pieces.

    Pieces are numbered in descending order of length. Run i takes the numbers
    from ``first[i]`` on (up to the next run's), ``each[i]`` to a bin, into the
    bins from ``bin[i]`` on, from offset ``offset[i]`` on.
    """
    tree = SegmentTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}
    first, bins, each, offsets = [], [], [], []
    number, bin_ = 0, 0

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            groups.setdefault(room, []).append((start, n))
            tree.add(room, n)

    def fill(start: int, room: int, n: int, per: int, length: int) -> None:
        nonlocal number
        first.append(number)
        bins.append(start)
        each.append(per)
        offsets.append(capacity - room)
        number += n * per
        put(room - per * length, start, n)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.first(length)
            if room is None:
                per = capacity // length
                start, n = bin_, -(-left // per)
                room, bin_ = capacity, bin_ + n
            else:
                start, n = groups[room].pop()
                tree.add(room, -n)
                per = room // length
            full, rest = divmod(left, per)
            if full >= n:
                fill(start, room, n, per, length)
                left -= n * per
                continue
            if full:
                fill(start, room, full, per, length)
            if rest:
                fill(start + full, room, 1, rest, length)
                full += 1
            if room < capacity:
                put(room, start + full, n - full)
            left = 0
    return {"first": np.array(first, np.int64), "bin": np.array(bins, np.int64), "each": np.array(each, np.int64), "offset": np.array(offsets, np.int64), "bins": np.int64(bin_)}


def _cut(vocabulary: str, kind: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        e = encoder(vocabulary, kind)
        end = np.array([end_id], e.dtype).tobytes()
        for batch in batches:
            row = 0
            for texts in chunks(batch.column(2)):
                take, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, raw in enumerate(e.encode(texts)):
                    ids = np.frombuffer(raw + end, e.dtype)
                    for i, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        take.append(row + k)
                        piece.append(i)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                        if with_ids:
                            kept.append(own.astype(np.int64))
                row += len(texts)
                at = pa.array(take, pa.int64())
                columns = {"row": batch.column(0).take(at), "id": batch.column(1).take(at), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def pack(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start (its document's ids before it), length,
    ids_crc32, sequence_id, offset (its place there) and, asked for, ids.

    A document is its ids and the end id; only longer ones than ``capacity`` are
    cut, into pieces of ``capacity``, the last one shorter. Null or empty text:
    the end id alone. Repeated rows are documents of their own; ids may be null
    or repeated. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    pieces = materialize(rows.mapInArrow(_cut(vocabulary, kind, end_id, capacity, with_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity))  # bounded by the capacity

    # number the pieces in descending order of length: place in the partition plus the partition's base
    dealt = pieces.select("row", "piece", "length").repartitionByRange(F.col("length").desc(), "row", "piece").sortWithinPartitions(F.col("length").desc(), "row", "piece")

    def numbered(batches):
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "place"])
            at += batch.num_rows

    placed = materialize(dealt.mapInArrow(numbered, "row bigint, piece int, length bigint, place bigint").withColumn("part", F.spark_partition_id()), "placed")
    bases, base = {}, 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        bases[r["part"]] = base
        base += r["n"]

    def assigned(batches):
        p = runs.value
        for batch in batches:
            part = batch.column(4).to_numpy()
            own = np.unique(part)
            starts = np.array([bases[x] for x in own.tolist()], np.int64)
            number = batch.column(3).to_numpy() + starts[np.searchsorted(own, part)]
            run = np.searchsorted(p["first"], number, side="right") - 1
            within = number - p["first"][run]
            sequence = p["bin"][run] + within // p["each"][run]
            offset = p["offset"][run] + within % p["each"][run] * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sequence), pa.array(offset)], names=["row", "piece", "sequence_id", "offset"])

    places = placed.mapInArrow(assigned, "row bigint, piece int, sequence_id bigint, offset bigint")
    return pieces.join(places, ["row", "piece"]).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of ``pack(..., with_ids=True)``: each sequence's ids, joined in order.
    A group holds ``capacity`` ids at most."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return own.select("sequence_id", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids"))
