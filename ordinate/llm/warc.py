"""Dictionary-compressed web archives (``.warc.zst``).

Each archive file starts with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from records of that file; every record after it is
a frame of its own, compressed with the dictionary, so a reader can seek to any
record.  Equal payloads are stored once: the one with the largest page id is the
``response``, the others are ``revisit`` records that name it.

Files are written through Spark's own writer, so any file system that Spark
knows will do: one row is one frame, and the row separator is an empty skippable
frame, which decoders of Zstandard pass over.

Scale: roles are decided on narrow rows (ids and digests); only the payloads of
responses move, once, to meet their role in the partition that becomes their
archive.  Records of an archive come in the order of a hash, so the first
``sample_bytes`` that the dictionary is built from are a random sample of it.  A task holds that
sample and one record; a reader holds one archive, so ``archive_bytes`` bounds
its memory.

Edge cases: a null payload is an empty one; rows repeated with one page id and
payload give one response and revisits to it; a null page id sorts below all
others and stays null; a null or odd URL is left out or percent-encoded; an
archive with too few or too uniform records for a dictionary has none; an empty
table writes no archive; extra columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_list, checkpointed, map_arrow, numbered, shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame, which parts the frames in a file.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
_FRAME_MAGIC = 0xFD2FB528


def payload(html: Column) -> Column:
    return F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))


def roles(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """From (page_id, url, body): one row for each record, with digest, bytes, copy, record_type and refers_to."""
    kinds = pages.groupBy("page_id", "url", F.sha1("body").alias("digest"), F.length("body").cast("bigint").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    kinds = checkpointed(kinds)
    tops = kinds.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("top"))
    records = numbered(kinds.join(tops, ["digest", "bytes"], "left"), "n", "copy")
    single = F.col("top").isNull()
    first = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")) & (F.col("copy") == 1)
    response = single | first
    return records.select(
        "page_id", "url", "digest", "bytes", "copy",
        F.when(response, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        F.when(~response, F.col("top.page_id")).alias("refers_to"),
        F.when(~response, F.col("top.url")).alias("refers_url"),
    )


def _key(digest: Column) -> Column:
    """Names a row by its id, URL and payload."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "url"), F.lit("null")), digest))


def record_id(page_id: int | None, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((page_id, url, copy)).encode()).digest())}>"


def make_record(page_id, url, copy, kind, digest: bytes, size: int, body: bytes, refers_to, refers_url, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (body if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_SAFE)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, refers_url, 1)}")
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(map(chr, range(33, 127)))


def build_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=3)
    except zstandard.ZstdError:  # too few or too uniform samples
        return None


def _frames(records: Iterator[bytes], sample_bytes: int, dictionary_bytes: int, level: int) -> Iterator[bytes]:
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= sample_bytes:
            break
    if not held:
        return
    trained = build_dictionary(held, dictionary_bytes)
    if trained is not None:
        raw = trained.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    tool = zstandard.ZstdCompressor(level=level, dict_data=trained) if trained else zstandard.ZstdCompressor(level=level)
    for record in held:
        yield tool.compress(record)
    del held
    for record in records:
        yield tool.compress(record)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, archive_bytes: int = 16 << 20, sample_bytes: int = 1 << 20, dictionary_bytes: int = 32 << 10, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write every row of pages as a record of an archive below path."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload(F.col(html)).alias("body"))
    records = checkpointed(roles(rows, least_bytes=least_bytes))
    total = records.agg(F.coalesce(F.sum(F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(0) + 600), F.lit(0)).alias("b")).first()["b"]
    files = max(1, math.ceil(total / archive_bytes))
    records = records.withColumn("key", _key(F.col("digest"))).repartition(files, "key")
    bodies = rows.withColumn("key", _key(F.sha1("body"))).select("key", "body")
    if not records.where("copy > 1").isEmpty():
        # Repeated rows meet in one group, so that a payload is attached once.
        bodies = bodies.distinct()
    body = F.when(F.col("record_type") == "response", F.col("body")).alias("body")
    names = ["page_id", "url", "digest", "bytes", "copy", "record_type", "refers_to", "refers_url"]
    # The partitions of the join are the archives; it sorts them by the digest, so their first records are a random sample.
    dealt = records.join(bodies.repartition(files, "key").hint("merge"), "key").select(*names, body)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records_of() -> Iterator[bytes]:
            for batch in batches:
                get = {n: (binary_list if n == "body" else pa.Array.to_pylist)(batch.column(n)) for n in batch.schema.names}
                for p, u, c, k, d, s, b, r, ru in zip(*[get[n] for n in ("page_id", "url", "copy", "record_type", "digest", "bytes", "body", "refers_to", "refers_url")], strict=True):
                    yield make_record(p, u, c, k, bytes.fromhex(d), s, b or b"", r, ru, date)

        held, size = [], 0
        for frame in _frames(records_of(), sample_bytes, dictionary_bytes, level):
            held.append(frame)
            size += len(frame)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    out = map_arrow(dealt, frames, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.mode("overwrite").option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    _rename(spark, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Give the files the archive suffix, and drop those of tasks that had no record."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen() == 0:
            fs.delete(status.getPath(), False)
        elif name.startswith("part-") and name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.zst"))


def iter_records(archive: bytes) -> Iterator[bytes]:
    """The records of one archive, in order."""
    view, at, tool = memoryview(archive), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC:
                tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        if magic != _FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        frame, parts = (tool or zstandard.ZstdDecompressor()).decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 16384]
            if not len(piece):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    stated = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != stated or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": stated, "payload_digest": digest, "record_type": kind, "refers_to": number("Refers-To-Page-ID"), "payload": body if kind == "response" else None}


def read_archives(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """One row for each record below path; payload only if asked for."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for record in iter_records(batch.column(0)[i].as_buffer()):
                    row = parse_record(record)
                    rows.append(row if payloads else row | {"payload": None})
                    size += len(record) if payloads else 200
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
                if rows:
                    yield flush(rows)

    return map_arrow(files, parse, schema)


def archive_folder(spark: SparkSession, name: str) -> str:
    """A path for a fresh folder that driver and executors share; it goes when the application ends."""
    return f"{shared_folder(spark, name)}/files"
