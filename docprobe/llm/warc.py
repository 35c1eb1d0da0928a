"""WARC archives of web pages: one gzip member a record, and a sequential reader that checks framing and digests.

The reader goes through an archive from front to back. It feeds compressed bytes to one zlib decompressor a member, piece by piece; takes the
header up to its blank line, then exactly ``Content-Length`` bytes of block, then the two line ends and the end of the member; and holds
the digests of block and payload against the header's. A cut, padded or changed archive is an error, never a shorter result.

Pages whose payloads are equal are stored once: the one with the largest id is a ``response``, the others are ``revisit`` records that
name it and carry only the HTTP header. Equal payloads are found by SHA-256 over narrow rows; only groups of two or more meet the pages again,
crowded ones by a broadcast of bounded size. Archives are written by the tasks that read the pages (no shuffle of payloads beyond
that join), about ``ARCHIVE_BYTES`` each, through the library's file writer with commit and abort; they are read back as Spark's binary files.

Defined results: a null html is an empty payload; rows that share their group's largest id are responses all of them, and a page without an
id refers to its group's response or, if no page of the group has an id, is one itself; a null url is left out of the record; line ends in a url are percent-encoded;
an empty table gives no archives and no rows; long payloads are one record, read in pieces; other columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprobe.llm.common import join_groups, map_rows, stored
from docprobe.sources.files import write_files
from docprobe.sources.scratch import fresh

VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A finished archive is at least so long, and longer by at most one record.
ARCHIVE_BYTES = 8_000_000
#: Compressed bytes that the reader feeds at a time, and the most it takes from the decompressor at a time.
PIECE = 1 << 16
HTTP, END = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", b"\r\n\r\n"
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _named(name: str | None) -> int | None:
    text = (name or "")[len("<urn:page:") : -1]
    return int(text) if text else None


def member(kind: str, fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    text = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, END])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A page's response, or the revisit that names the response with an equal payload."""
    fields = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head = HTTP % len(payload)
    if refers_to is None:
        return member("response", fields, head + payload)
    return member("revisit", [*fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(refers_to))], head)


class _Member:
    """The bytes of one gzip member of a stream, by incremental decompression; what follows it stays in ``rest``."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.rest, self.held, self.zip = stream, rest, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompresses a piece into ``held``; False at the member's end."""
        if self.zip.eof:
            return False
        given = self.zip.unconsumed_tail or self.rest or self.stream.read(PIECE)
        got, self.rest = self.zip.decompress(given, PIECE), b""
        if not given and not got and not self.zip.eof:
            raise ValueError("archive ends within a record")
        self.held += got
        if self.zip.eof:
            self.rest = self.zip.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        at = self.held.find(mark)
        while at < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError("record without the end of its header")
            at = self.held.find(mark, seen)
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("record shorter than its Content-Length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def close(self) -> None:
        tail = b""
        while len(tail) <= len(END) and (self.held or self.more()):
            tail, self.held = tail + self.held, b""
        if tail != END:
            raise ValueError("record longer than its Content-Length")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record, in order, framing and digests checked."""
    rest = stream.read(PIECE)
    while rest:
        one = _Member(stream, rest)
        version, _, lines = one.until(END).partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        pairs = (line.partition(":") for line in lines.decode("utf-8").split("\r\n"))
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        length = fields.get("content-length", "")
        if not length.isdigit():
            raise ValueError("record without a Content-Length")
        sha, parts = hashlib.sha1(), []
        for part in one.take(int(length)):
            sha.update(part)
            parts.append(part)
        one.close()
        if fields.get("warc-block-digest", "").removeprefix("sha1:") != base64.b32encode(sha.digest()).decode():
            raise ValueError(f"block digest of {fields.get('warc-record-id')} does not fit")
        yield fields, b"".join(parts)
        rest = one.rest or stream.read(PIECE)


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``READ`` from a response or revisit record; a response's payload is held against its digest and the HTTP header's length."""
    head, _, payload = block.partition(END)
    lengths = [int(v) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")) if k.strip().lower() == b"content-length"]
    want = fields["warc-payload-digest"].removeprefix("sha1:")
    if len(lengths) != 1:
        raise ValueError("HTTP header without a Content-Length")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != lengths[0] or digest(payload) != want):
        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
    return _named(fields["warc-record-id"]), fields.get("warc-target-uri"), lengths[0], want, kind, _named(fields.get("warc-refers-to")), payload.decode() if kind == "response" else None


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the largest id with an equal payload of ``least_bytes`` or more, null for that page itself."""
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    key = F.sha2("html", 256)
    long = rows.where(F.octet_length("html") >= least_bytes).select("page_id", key.alias("key"))
    groups = stored(long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top")).where("n > 1"), "warc-repeated")
    met = join_groups(rows.withColumn("key", key), groups, ["key"], rows.count(), F.coalesce("page_id", F.lit(0)))
    return met.select("page_id", "url", "html", F.when(~F.col("group.top").eqNullSafe(F.col("page_id")), F.col("group.top")).alias("refers_to"))


def archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """name, content: the archives that each task makes of its rows (page_id, url, html, refers_to). Pages carry no time of their own: ``date`` is every record's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        about = member("warcinfo", [("WARC-Record-ID", f"<urn:archive:{task}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        out, held = [], 0
        for batch in batches:
            for page_id, url, html, to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                out.append(page_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"", to.as_py(), date))
                held += len(out[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"name": pa.array([f"pages-{task:05d}-{k:05d}.warc.gz"]), "content": pa.array([b"".join([about, *out])], pa.binary())})
                    out, held, k = [], 0, k + 1
        if out:
            yield pa.RecordBatch.from_pydict({"name": pa.array([f"pages-{task:05d}-{k:05d}.warc.gz"]), "content": pa.array([b"".join([about, *out])], pa.binary())})

    return map_rows(rows, run, "name string, content binary")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """The pages as ``*.warc.gz`` files in a new folder."""
    write_files(archives(with_responses(pages, least_bytes), archive_bytes), path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The page records of all archives of a folder (columns of ``READ``; html is null for revisits)."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in records(pa.BufferReader(content.as_buffer())):
                    if fields["warc-type"] in ("response", "revisit"):
                        rows.append(page_of(fields, block))
                        held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    return map_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content"), run, READ)


def write_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back from archives of the pages."""
    path = fresh(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
