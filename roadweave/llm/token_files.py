"""Token-ID files: flat unsigned integers and 64-bit document offsets.

A folder holds, for partition k in ascending order of document id,
``part-k.bin`` (ids, little-endian unsigned, 16 or 32 bits), ``part-k.idx``
(64-bit offsets within the part, one more than documents), ``part-k.doc``
(64-bit document ids) and ``manifest.json`` (width, and each part's documents,
ids and base). A part's base is the prefix sum of the ids of the parts before
it, so a document's place in the whole is base + offset. Files appear by an
atomic rename, so a task that runs twice leaves the same files.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package
from .encode import encoder

#: Characters of text that are encoded at once.
CHUNK_CHARS = 2 << 20
#: Stands for a null document id in ``part-k.doc``; such documents come first.
NULL_ID = -(1 << 63)


def chunks(texts: pa.Array, most: int = CHUNK_CHARS):
    """Lists of consecutive texts (null: empty) of about ``most`` characters."""
    held, size = [], 0
    for text in texts:
        value = text.as_py() or ""
        held.append(value)
        size += len(value)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _write_part(folder: str, vocabulary: str, kind: str, end_id: int):
    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, path = pafs.FileSystem.from_uri(folder)
        names = {x: f"{path}/part-{part:06d}.{x}" for x in ("bin", "idx", "doc")}
        e = encoder(vocabulary, kind)
        end = np.array([end_id], e.dtype).tobytes()
        at, docs = 0, 0
        files = {x: fs.open_output_stream(f"{n}.{attempt}") for x, n in names.items()}
        files["idx"].write(np.zeros(1, "<i8").tobytes())
        for batch in batches:
            row = 0
            for texts in chunks(batch.column(1)):
                encoded = e.encode(texts)
                lengths = np.array([len(x) for x in encoded], np.int64) // e.dtype.itemsize + 1
                files["bin"].write(b"".join(x + end for x in encoded))
                files["idx"].write((at + np.cumsum(lengths)).astype("<i8").tobytes())
                files["doc"].write(batch.column(0).slice(row, len(texts)).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                at, docs, row = at + int(lengths.sum()), docs + len(texts), row + len(texts)
        for x, f in files.items():
            f.close()
            fs.move(f"{names[x]}.{attempt}", names[x])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([docs], pa.int64()), "ids": pa.array([at], pa.int64()), "width": pa.array([e.dtype.itemsize], pa.int32())})

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, kind: str = "byte", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every whole text and write the files; returns the manifest.

    Null or empty text: the end id alone. Null ids come first; rows with equal
    ids stand in the order of their texts' hashes and can lie in several parts.
    An empty table leaves empty parts. Only the parts' counts reach the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    counts = dealt.mapInArrow(_write_part(folder, vocabulary, kind, end_id), "part int, docs bigint, ids bigint, width int").collect()
    base, parts = 0, []
    for r in sorted(counts, key=lambda r: r.part):
        parts.append({"part": r.part, "docs": r.docs, "ids": r.ids, "base": base})
        base += r.ids
    manifest = {"width": counts[0].width if counts else 2, "ids": base, "parts": parts}
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of a part: memory-mapped on a file system that
    the worker mounts, else read from the store."""
    fs, path = pafs.FileSystem.from_uri(folder)
    local = isinstance(fs, pafs.LocalFileSystem)

    def load(name: str, kind: str) -> np.ndarray:
        name = f"{path}/part-{part:06d}.{name}"
        if local:
            return np.memmap(name, dtype=kind, mode="r") if os.path.getsize(name) else np.zeros(0, kind)
        with fs.open_input_file(name) as f:
            return np.frombuffer(f.readall(), kind)

    return load("bin", f"<u{width}"), load("idx", "<i8"), load("doc", "<i8")


def _read_part(folder: str, width: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, docs = open_part(folder, part, width)
                for row in range(0, len(docs), 4096):
                    own = offsets[row : row + 4097]
                    values = [ids[a:b].astype("<u4") for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    here = np.asarray(docs[row : row + 4096])
                    columns = {
                        "doc_id": pa.array(here, pa.int64(), mask=here == NULL_ID),
                        "start": pa.array(base + np.asarray(own[:-1]), pa.int64()),
                        "n_tokens": pa.array(np.diff(own), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(v.tobytes()) for v in values], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([v.astype(np.int64) for v in values], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, asked for, ids) of every document of a folder.

    start counts the ids of all documents before it; ids_crc32 is over the ids
    as little-endian unsigned 32-bit integers.
    """
    ship_package(spark)
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.readall())
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    parts = [(p["part"], p["base"]) for p in manifest["parts"] if p["docs"]]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)), "part int, base bigint")
    return rows.mapInArrow(_read_part(folder, manifest["width"], with_ids), schema)
