"""Exact line deduplication that returns bitmaps.

1. One pass over the texts: every line's key as a 128-bit hash with its document and place.
2. The hashes are range-partitioned and sorted by hash, document and place together, so
   that a line which a third of all texts hold is split over many partitions.
3. Each partition is streamed once: within a run of one hash, lines of any document but
   the first are dropped. Only the run that a partition starts with may have begun
   before; its first document's lines wait for the least document of that hash among the
   runs at the edges of partitions (two rows a partition at most).
4. The dropped places of a document become one compressed bitmap. Texts aren't moved until
   bitmaps are applied to them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, ship_package

#: Fewest code points of a key that is compared at all.
LEAST_KEY = 10
#: Lines that one output batch holds.
LINES = 1 << 16
#: Bytes that a bitmap's row takes in a broadcast table, by and large.
BITMAP_ROW = 256

_SPACE = b" \t\n\x0b\x0c\r"
_DROPPED, _WAITING, _EDGE = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """A line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least


def _hashed(least: int):
    def run(batches):
        for batch in batches:
            texts, owner, places, digests = batch.column(2), [], [], []

            def made(batch=batch, owner=owner, places=places, digests=digests):
                take = pa.array(owner, pa.int32())
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.int32())],
                    names=["h1", "h2", "id", "tag", "place"],
                )

            for i, text in enumerate(texts):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < least:
                    continue
                for place, line in enumerate(raw.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, least):
                        owner.append(i)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(key))
                        if len(owner) >= LINES:
                            yield made()
                            owner.clear(), places.clear(), digests.clear()
            if owner:
                yield made()

    return run


def _same_as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it; null equals null."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    both_null = pc.and_(now.is_null(), before.is_null())
    return pc.or_(pc.equal(now, before).fill_null(False), both_null).to_numpy(zero_copy_only=False)


def _streamed(batches):
    """First occurrences of a partition sorted by hash, document and place."""
    last = None  # hash and document of the row before, the first document of its run, whether another followed, whether it is the partition's first run
    head = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2, ids = batch.column(0), batch.column(1), batch.column(2)
        a, b = h1.to_numpy(), h2.to_numpy()
        new_run, same_id = np.ones(n, bool), np.zeros(n, bool)
        new_run[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        same_id[1:] = _same_as_before(ids)
        at_start = (int(a[0]), int(b[0]))
        changed_before = in_head = False
        if last is not None and last[0] == at_start:
            new_run[0], same_id[0] = False, ids[0].as_py() == last[1]
            changed_before, in_head = last[3], last[4]
        changes = np.cumsum(~new_run & ~same_id)
        run = np.cumsum(new_run)  # 0: the run of the batch before goes on
        starts = np.flatnonzero(new_run)
        dropped = np.where(run == 0, changed_before | (changes > 0), changes > np.append(0, changes[starts])[run])
        if head is None:
            head, in_head = (at_start, ids[0].as_py()), True
            waiting = run == 1
        else:
            waiting = (run == 0) & in_head
        waiting &= ~dropped
        for kind, mask in ((_DROPPED, dropped), (_WAITING, waiting)):
            if mask.any():
                kept = batch.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(kept.num_rows, kind, np.int32)), *kept.columns], names=["kind", "h1", "h2", "id", "tag", "place"])
        goes_on = len(starts) == 0
        first = last[2] if goes_on else ids[int(starts[-1])].as_py()
        last = ((int(a[-1]), int(b[-1])), ids[n - 1].as_py(), first, bool(dropped[-1]), in_head and (goes_on or run[-1] == 1 and head[0] == (int(a[-1]), int(b[-1]))))
        id_type = ids.type
    if head is not None:
        edges = {head[0]: head[1]}
        edges.setdefault(last[0], last[2])
        k = len(edges)
        yield pa.RecordBatch.from_arrays(
            [pa.array([_EDGE] * k, pa.int32()), pa.array([h[0] for h in edges], pa.int64()), pa.array([h[1] for h in edges], pa.int64()), pa.array(list(edges.values()), id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())],
            names=["kind", "h1", "h2", "id", "tag", "place"],
        )


def encode_bitmap(dropped: list[int]) -> bytes:
    """A compressed bitmap with 0 at dropped places, padded with ones to whole bytes;
    lines beyond its end are kept."""
    bits = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def decode_bitmap(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of ``n`` lines is kept; without a bitmap all are."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n]
        keep[: len(bits)] = bits
    return keep


def _encoded(batches):
    for batch in batches:
        places = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in places], pa.int64()), pa.array([encode_bitmap(x) for x in places], pa.binary())], names=["id", "tag", "n_dropped", "bitmap"])


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_KEY) -> DataFrame:
    """(id, tag, n_dropped, bitmap) of every document that loses lines.

    A document is an id; ``tag`` is the hash of a row's text, so that rows with one id and
    different texts have bitmaps of their own, and equal rows share one. Keys of
    ``least`` code points or more that two ids hold lose their lines in all but the
    smallest (a null id counts as the largest), where every line of it stays.
    Null or empty text is one empty line, which is never dropped. An empty table gives
    no rows; extra columns take no part. A text is split whole, however long.
    """
    ship_package(docs.sparkSession)
    rows = _tagged(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    lines = materialize(rows.mapInArrow(_hashed(least), f"h1 bigint, h2 bigint, id {kind}, tag bigint, place int"), "lines")
    order = ["h1", "h2", F.col("id").asc_nulls_last(), "tag", "place"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInArrow(_streamed, f"kind int, h1 bigint, h2 bigint, id {kind}, tag bigint, place int"), "found")
    edges = found.where(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.min("id").alias("first"))
    waiting = found.where(F.col("kind") == _WAITING).join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
    dropped = found.where(F.col("kind") == _DROPPED).select("id", "tag", "place").unionByName(waiting.select("id", "tag", "place"))
    places = dropped.groupBy("id", "tag").agg(F.collect_set("place").alias("places"))
    return materialize(places.mapInArrow(_encoded, f"id {kind}, tag bigint, n_dropped bigint, bitmap binary"), "bitmaps")


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, bitmap) of every row of ``docs``."""
    held = docs.select(F.struct("*").alias("doc"))
    text = F.col("doc")[text_col].cast("string")
    held = held.select("doc", F.col("doc")[id_col].alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))
    own = broadcast_if_small(bitmaps, BITMAP_ROW).select(F.col("id").alias("id_"), F.col("tag").alias("tag_"), "bitmap")
    return held.join(own, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")), "left").select("doc", "id", "text", "bitmap")


def _kept(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the text that is left."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    keep = decode_bitmap(bitmap, len(lines))
    return len(lines), int(len(lines) - keep.sum()), b"\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)


def _reported(batches):
    for batch in batches:
        out = []
        for text, bitmap in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            n, gone, left = _kept(text.as_buffer().to_pybytes() if text.is_valid else b"", bitmap)
            out.append((n, gone, hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]], names=["id", "n_lines", "n_dropped", "kept_sha256"])


def report(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row of ``docs``, its bitmap applied."""
    ship_package(docs.sparkSession)
    rows = _with_bitmaps(docs, bitmaps, id_col, text_col).select("id", "text", "bitmap")
    return rows.mapInArrow(_reported, f"id {rows.schema['id'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_sha256 string")


def deduplicated(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, with the dropped lines gone from the texts. Null stays null."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def left(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([t if b is None or t is None else _kept(t.encode(), b)[2].decode() for t, b in zip(texts, bitmaps, strict=True)], dtype=object)

    rows = _with_bitmaps(docs, bitmaps, id_col, text_col)
    text = F.when(F.col("bitmap").isNotNull(), left("text", "bitmap")).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
