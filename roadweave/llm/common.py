"""Helpers that several operators share: the shared folder, written tables,
and vectorised word splitting over Arrow buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at once. A longer single text is taken alone.
BLOCK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is taken in local mode only; on a
    cluster that is an error, since no local folder is seen by all executors.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    base = context.getConf().get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage: a lost executor costs no recomputation of what stands before,
    and several readers share one pass over the input.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A counted table is broadcast to its join up to so many bytes; a longer one is shuffled.
MAX_BROADCAST = 32 << 20


def broadcast_if_small(written: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its rows are counted and found few."""
    return F.broadcast(written) if written.count() * row_bytes <= MAX_BROADCAST else written


def refuse_clash(docs: DataFrame, out: str) -> None:
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table already has a column {out}; name another one")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the Python workers of ``spark``."""
    import shutil

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top in paths or getattr(spark.sparkContext, "_roadweave_shipped", False):
        return
    name = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), name), "zip", top, name)
    spark.sparkContext.addPyFile(made)
    spark.sparkContext._roadweave_shipped = True


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows sorted by the number columns ``keys`` as tables of whole groups; one group and
    one batch are held at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        changed = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            column = table[key].to_numpy()
            changed |= column[1:] != column[:-1]
        ends = np.flatnonzero(changed)
        if len(ends):
            yield table.slice(0, int(ends[-1]) + 1)
            table = table.slice(int(ends[-1]) + 1)
        held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``most`` bytes."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upper_to_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_AS_IS, _LOWERED = np.arange(256, dtype=np.uint8), _upper_to_lower()
#: The first 0 to 8 bytes of a little-endian 64-bit number.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of up to so many bytes are hashed from their bytes as numbers, longer ones one by one.
SHORT_WORD = 16


class Words:
    """Splits blocks of UTF-8 text into words given as a table of word bytes."""

    def __init__(self, is_word: np.ndarray, lower: bool = True):
        self.is_word = is_word
        self.case = _LOWERED if lower else _AS_IS

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the number of words in each text."""
        mask = self.is_word[data]
        n = len(mask)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        before = np.zeros(n, bool)
        before[1:] = mask[:-1]
        first = offsets[:-1]
        before[first[first < n]] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.zeros(n, bool)
        after[:-1] = mask[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        ends = np.flatnonzero(mask & ~after) + 1
        counts = np.diff(np.searchsorted(starts, offsets))
        return starts, ends, counts

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first eight and the next eight of each word's (lower-cased) bytes as
        numbers, and the padded bytes. With its length they are a short word itself."""
        padded = np.zeros(len(data) + SHORT_WORD, np.uint8)
        np.take(self.case, data, out=padded[: len(data)])
        at = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        n = ends - starts
        low = at[starts] & _FIRST_BYTES[np.minimum(n, 8)]
        high = at[np.minimum(starts + 8, len(data) + 8)] & _FIRST_BYTES[np.clip(n - 8, 0, 8)]
        return low, high, padded

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's (lower-cased) bytes, mixed so that no
        structure of words makes equal ones: 64 random bits, in effect."""
        low, high, padded = self.numbers(data, starts, ends)
        n = ends - starts
        out = mix64(mix64(low + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + high * np.uint64(0xC2B2AE3D27D4EB4F))
        long = np.flatnonzero(n > SHORT_WORD)
        if len(long):
            raw = padded.data
            out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
        return out


def byte_table(kept) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(kept)] = True
    return table


#: Words of the shingle and quality contracts: anything but space and \t..\r.
NOT_SPACE = byte_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of the decontamination contract: letters and digits in ASCII, all beyond ASCII.
ALNUM = byte_table(b for b in range(256) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte position (length + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
