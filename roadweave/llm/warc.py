"""WARC archives compressed with Zstandard and a dictionary.

An archive starts with a skippable frame that holds the dictionary; then comes
one frame for each record, so that a record can be read without the others. The
dictionary of an archive is trained on its own first records, a sample of
bounded size. Equal payloads are stored once: the record of the smallest page id
is the response, the others are revisits that name it.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package

# Frame marks and the revisit profile of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads under so many bytes are always stored in full.
LEAST_SHARED = 100
#: The dictionary is trained on the first records of an archive, up to so many bytes of payload, to a size of at most so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
LEVEL = 3


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ArchiveError("a record doesn't start with WARC/1.1 or its headers don't end")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ArchiveError(f"bad or repeated header {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"no header {name}")
    if not headers["content-length"].isdigit():
        raise ArchiveError("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"content-length is {n}, {len(rest) - 4} bytes follow")
    return headers, rest[:n]


def train(samples: list[bytes]) -> bytes:
    """A dictionary; where the samples are too few to train one, their first bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    def __init__(self, out, samples: list[bytes]):
        raw = train(samples)
        self.out = out
        held = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(held)) + held)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)

    def write(self, headers: list[tuple[str, str]], block: bytes) -> None:
        self.out.write(self.compressor.compress(record(headers, block)))


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive: the dictionary from the leading skippable frame, which
    may itself be compressed, then one frame for each record."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE_MAGIC:
        raise ArchiveError("the archive doesn't start with a dictionary frame")
    size = struct.unpack("<II", head)[1]
    raw = source.read(size)
    if len(raw) != size:
        raise ArchiveError("the dictionary frame is cut short")
    if raw[:4] == ZSTD_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    left = b""
    while True:
        left = left or source.read(1 << 20)
        if not left:
            return
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame can't be decoded: {e}") from e
            if frame.eof:
                left = frame.unused_data
                break
            left = source.read(1 << 20)
            if not left:
                raise ArchiveError("the last frame is cut short")
        yield parse(b"".join(parts))


def _write_archive(folder: str, date: str):
    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, path = pafs.FileSystem.from_uri(folder)
        name = f"{path}/part-{part:06d}.warc.zst"

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        source, first, size = rows(), [], 0
        for row in source:
            first.append(row)
            size += len(row[2] or "")
            if size >= SAMPLE_BYTES:
                break
        n = 0
        with fs.open_output_stream(f"{name}.{attempt}", compression=None) as out:
            writer = Writer(out, [r[2].encode() for r in first if r[2]])
            for some in (first, source):
                for page, url, html, digest, refers_to in some:
                    payload = (html or "").encode()
                    headers = [
                        ("WARC-Type", "response" if refers_to is None else "revisit"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{url}')}>"),
                        ("WARC-Date", date),
                        *([("WARC-Target-URI", "".join(c for c in url if c.isprintable()))] if url else []),
                        ("WARC-Payload-Digest", f"sha256:{digest}"),
                        *([("X-Page-Id", str(page))] if page is not None else []),
                        ("X-Payload-Length", str(len(payload))),
                        *([("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []),
                    ]
                    writer.write(headers, payload if refers_to is None else b"")
                    n += 1
        fs.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": pa.array([n], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Write one archive for each partition; returns their names.

    Null html: an empty payload. Of records with equal payloads of at least
    ``LEAST_SHARED`` bytes, those with the smallest id are responses (several if
    that id repeats), the others revisits; without any id all are responses. An
    empty table gives no archives.
    """
    spark = pages.sparkSession
    ship_package(spark)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    # the smallest id of a digest is pre-aggregated; the join by digest splits where one is very common
    first = rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min("id").alias("first_id"))
    refers_to = F.when((F.octet_length("html") >= LEAST_SHARED) & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    marked = rows.join(first, "digest", "left").select("id", "url", "html", "digest", refers_to.alias("refers_to"))
    written = marked.mapInArrow(_write_archive(folder, date), "part int, records bigint").collect()  # one row a partition
    return [f"part-{r.part:06d}.warc.zst" for r in sorted(written) if r.records]


def _read_archive(folder: str, with_payload: bool):
    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for headers, block in read_records(source):
                        kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                        n = int(headers["x-payload-length"])
                        if kind == "response":
                            if len(block) != n or hashlib.sha256(block).hexdigest() != said:
                                raise ArchiveError(f"{name}: the payload of {headers['warc-record-id']} doesn't match its length or digest")
                        elif kind != "revisit" or block or "x-refers-to-page-id" not in headers:
                            raise ArchiveError(f"{name}: {headers['warc-record-id']} is no valid revisit")
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), n, said, kind, number("x-refers-to-page-id"), block if with_payload and kind == "response" else None))
                        if len(rows) == 512:
                            yield _batch(rows, with_payload)
                            rows = []
                if rows:
                    yield _batch(rows, with_payload)

    return run


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    kinds = kinds if with_payload else kinds[:-1]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=False)], names=[n for n, _ in kinds])


def read_archives(spark: SparkSession, folder: str, names: list[str], with_payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to and, asked for,
    payload) of every record; a malformed archive raises ``ArchiveError``.

    A response's length and digest are computed from its payload and compared
    with its headers; a revisit's are those that its headers say of the payload.
    """
    ship_package(spark)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(n,) for n in names], len(names)), "name string")
    return rows.mapInArrow(_read_archive(folder, with_payload), schema)


def records_of(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    return list(read_records(io.BytesIO(raw)))
