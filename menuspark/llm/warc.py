"""WARC archives: one gzip member per record, written as .warc.gz files and read back.

Tasks stream records into files of the given folder, one record in memory at a time, and close a file
after ``ARCHIVE_BYTES``. A file's name is new in every attempt, and it counts only once the manifest,
a table written with Spark's commit protocol, names it; so what lost executors and repeated attempts
leave behind is never read. The folder must lie in a store that Arrow's file systems open (local and
mounted paths, hdfs, s3, gs, abfs).

The reader is sequential. It feeds a stream in small pieces to one decompressor per gzip member,
frames each record by its Content-Length, and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuspark.storage import hadoop_path, materialize, scratch_path, sized

#: Payloads of at least this many bytes may be revisits of an equal one.
REVISIT_LEAST = 0
#: Uncompressed payload bytes after which a new archive begins.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
#: Rows of whole payloads that one Arrow batch holds.
ROWS_AT_ONCE = 512
#: Payload bytes of the records that the reader hands on at once.
BATCH_BYTES = 4 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    """A stream that is not a whole sequence of sound records."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    payload: bytes = field(default=b"", repr=False)

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, row: int = 0) -> str:
    return f"<urn:menuspark:page:{'' if page_id is None else page_id}:{row}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:menuspark:page:(-?[0-9]+):[0-9]+>", urn or "")
    return int(found[1]) if found else None


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def page_record(page_id: int | None, url: str | None, payload: bytes, row: int = 0, refers_to: str | None = None) -> bytes:
    """A response with its whole payload, or a revisit that names the response and carries none."""
    head = _HTTP % len(payload)
    block = head if refers_to else head + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_urn(page_id, row)),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    return member(headers, block)


def info_record(name: str) -> bytes:
    block = b"software: menuspark\r\nformat: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:menuspark:archive:{name}>"), ("WARC-Filename", name), ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Type", "application/warc-fields")], block)


def members(stream: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The content of each gzip member of ``stream``, decompressed piece by piece."""
    pending = b""
    while True:
        pending = pending or stream.read(read_bytes)
        if not pending:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not pending:
                pending = stream.read(read_bytes)
                if not pending:
                    raise WarcError("the stream ends inside a gzip member")
            try:
                parts.append(unpacker.decompress(pending))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            pending = unpacker.unused_data if unpacker.eof else b""
        yield b"".join(parts)


def parse(raw: bytes) -> Record:
    """One record: version line, headers, a block of exactly Content-Length bytes, two line ends."""
    at = raw.find(b"\r\n\r\n")
    if at < 0 or not raw.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    headers = {}
    for line in raw[:at].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode().strip().lower()] = value.decode().strip()
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no usable Content-Length") from e
    block, tail = raw[at + 4 : at + 4 + length], raw[at + 4 + length :]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError("the block is not as long as Content-Length says")
    record = Record(headers, block)
    if "application/http" in headers.get("content-type", ""):
        record.payload = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    return record


def verify(record: Record) -> None:
    """Compare the digests that a record names with those of what it carries."""
    named = record.headers.get("warc-block-digest")
    if named and named != "sha1:" + sha1_base32(record.block):
        raise WarcError(f"block digest of {record.headers.get('warc-record-id')} differs")
    named = record.headers.get("warc-payload-digest")
    if named and record.kind == "response" and named != "sha1:" + sha1_base32(record.payload):
        raise WarcError(f"payload digest of {record.headers.get('warc-record-id')} differs")


def read(stream: BinaryIO, read_bytes: int = READ_BYTES) -> Iterator[Record]:
    """The verified records of a .warc.gz stream, one in memory at a time."""
    for raw in members(stream, read_bytes):
        record = parse(raw)
        verify(record)
        yield record


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_least: int = REVISIT_LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` into .warc.gz files of ``folder``; returns the manifest
    (path, records, responses, payload_bytes).

    Of rows with equal payloads of at least ``revisit_least`` bytes the one with the smallest id (null
    ids last; of repeated rows one) is the response and the others revisit it. A null payload is empty.
    Only the named columns are read. The groups come from a narrow table of digests; a payload moves
    only if the table of groups that have copies is too large to broadcast.
    """
    spark = pages.sparkSession
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    narrow = source.filter(F.octet_length("payload") >= revisit_least).select("digest", F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row").alias("at"))
    groups = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("at").alias("first")).filter("n > 1")
    copied = materialize(groups.select("digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")), "warc-copied")
    marked = source.join(sized(copied, copied.count(), 160), "digest", "left").select("page_id", "url", "payload", "row", "first_id", "first_row")

    fs, root = hadoop_path(spark, folder)
    fs.mkdirs(root)
    folder = fs.makeQualified(root).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        attempt, made = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        out, tally = None, {}
        for batch in batches:
            for page_id, url, payload, row, first_id, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, made = f"pages-{attempt}-{made:06d}.warc.gz", made + 1
                    out, tally = store.open_output_stream(f"{at}/{name}", compression=None), {"path": f"{folder}/{name}", "records": 0, "responses": 0, "payload_bytes": 0}
                    out.write(info_record(name))
                again = first_row is not None and first_row != row
                out.write(page_record(page_id, url, payload, row, record_urn(first_id, first_row) if again else None))
                tally["records"] += 1
                tally["responses"] += not again
                tally["payload_bytes"] += len(payload)
                if tally["payload_bytes"] >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([tally])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([tally])

    manifest = materialize(marked.mapInArrow(run, "path string, records long, responses long, payload_bytes long"), "warc-manifest", ROWS_AT_ONCE)
    records, responses = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("responses"), F.lit(0))).first()
    revisits = copied.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    if records - responses != revisits:
        raise RuntimeError("row numbers changed between two readings of the pages")
    return manifest


def read_archives(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The response and revisit records of .warc.gz files: (page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload). Every record is verified; a damaged one fails the query. A
    revisit's length and digest are those of the full payload, its own payload is null. A task streams
    its files one after another and holds a record, and ``BATCH_BYTES`` of payloads, at a time."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = opened(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for record in read(stream):
                        if record.kind not in ("response", "revisit"):
                            continue
                        h, again = record.headers, record.kind == "revisit"
                        length = int(h.get("x-payload-length") or len(record.payload))
                        rows.append((page_of(h.get("warc-record-id")), h.get("warc-target-uri"), length, h.get("warc-payload-digest", "").removeprefix("sha1:"), record.kind, page_of(h.get("warc-refers-to")) if again else None, None if again else record.payload))
                        size += len(record.payload)
                        if size >= BATCH_BYTES or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    files = max(1, paths.count())
    return paths.select(F.col(path_col).alias("path")).repartition(files).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all .warc.gz files below ``path``; only their names go through Spark's reader."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return read_archives(listed.select("path"))


def unmatched_revisits(records: DataFrame) -> DataFrame:
    """The revisits among read records whose response is missing or has another payload digest."""
    responses = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.filter("record_type = 'revisit' AND refers_to IS NOT NULL").join(responses, ["refers_to", "payload_digest"], "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_least: int = REVISIT_LEAST) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc-archives")
    return read_archives(write_archives(pages, folder, id_col, url_col, payload_col, revisit_least))
