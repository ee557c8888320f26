"""WARC archives: one gzip member per record, read back sequentially with digests verified.

Archives are written by Spark's own text writer, so that the commit protocol covers them wherever the folder is: a
member ends with the high byte of its length, which is 0 below 16 MiB, and that byte is the writer's separator. Longer
records are followed by an empty member, which ends with 0 as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Payload bytes meant for an archive, and the least payload for which a copy is written as a revisit.
ARCHIVE_BYTES, REVISIT_BYTES = 32 << 20, 1000
_EMPTY = gzip.compress(b"", mtime=0)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that is cut short, badly framed or whose digest differs."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_sha1: str = ""
    payload: bytes | None = None


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _line(text: object) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(text))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of refers_to without the payload."""
    digest = _b32(hashlib.sha1(payload).digest())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    whole = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    member = gzip.compress(whole, mtime=0)
    return member if member[-1] == 0 else member + _EMPTY


def _member_pieces(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member an iterator of its decompressed pieces; each must be used up before the next."""
    rest = stream.read(_CHUNK)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces(inflate: zlib._Decompress = inflate) -> Iterator[bytes]:
            nonlocal rest
            while not inflate.eof:
                if not rest:
                    raise WarcError("the archive ends within a record")
                try:
                    out = inflate.decompress(rest, _CHUNK)
                except zlib.error as error:
                    raise WarcError(f"not a gzip member: {error}") from error
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail or stream.read(_CHUNK)
                if out:
                    yield out
            rest = rest or stream.read(_CHUNK)

        yield pieces()


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines if x)}


class _Cursor:
    """Reads lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, b""

    def fill(self) -> bool:
        got = next(self.pieces, None)
        self.buffer += got or b""
        return got is not None

    def head(self) -> list[bytes]:
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                raise WarcError("no end of headers")
        lines, self.buffer = self.buffer[:at].split(b"\r\n"), self.buffer[at + 4 :]
        return lines

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.fill():
                raise WarcError(f"{n} bytes of the content are missing")
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece


def read_records(stream: BinaryIO, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive, one member after the other, in bounded memory unless payloads are asked for.

    Content-Length frames the block; block digest, and payload digest of responses, must agree.
    """
    for pieces in _member_pieces(stream):
        cursor = _Cursor(pieces)
        if not cursor.fill():
            continue
        first, *lines = cursor.head()
        if not first.startswith(b"WARC/1."):
            raise WarcError(f"not a record: {first[:40]!r}")
        record = Record(_headers(lines))
        left = int(record.headers["content-length"])
        block, payload, kept, http = hashlib.sha1(), hashlib.sha1(), [], b""
        inside = False
        for piece in cursor.take(left):
            block.update(piece)
            if not inside:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                record.http, piece, inside = _headers(http[:at].split(b"\r\n")[1:]), http[at + 4 :], True
            payload.update(piece)
            record.payload_bytes += len(piece)
            if payloads:
                kept.append(piece)
        if b"".join(cursor.take(4)) != b"\r\n\r\n" or cursor.buffer or cursor.fill():
            raise WarcError("the record goes on after its content")
        if _b32(block.digest()) != record.headers.get("warc-block-digest"):
            raise WarcError(f"block digest differs: {record.headers.get('warc-record-id')}")
        if record.headers["warc-type"] == "response":
            if _b32(payload.digest()) != record.headers.get("warc-payload-digest"):
                raise WarcError(f"payload digest differs: {record.headers.get('warc-record-id')}")
            if record.payload_bytes != int(record.http.get("content-length", record.payload_bytes)):
                raise WarcError(f"payload length differs: {record.headers.get('warc-record-id')}")
            record.payload_sha1 = payload.hexdigest()
            record.payload = b"".join(kept) if payloads else None
        else:
            record.payload_bytes = int(record.http["content-length"])
            record.payload_sha1 = base64.b32decode(record.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        yield record


def _written(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """(archive, value): the records of a task with the number of the archive that each goes to, by the bytes before it."""
    total = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part = batch.slice(lo, 100)
            records, numbers = [], []
            for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                records.append(record_bytes(*row)[:-1])
                numbers.append(total // archive_bytes)
                total += len(records[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(records, pa.binary())], ["archive", "value"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    number = lambda urn: None if not urn or urn == "<urn:page:None>" else int(urn[len("<urn:page:") : -1])
    for batch in batches:
        for content in batch.column("content"):
            rows = [(number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_sha1, r.headers["warc-type"], number(r.headers.get("warc-refers-to"))) for r in read_records(io.BytesIO(content.as_buffer()))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a record per row of pages(page_id, url, html) below path, each file a valid series of gzip members.

    A null html is an empty payload. Of rows with equal payloads of at least revisit_bytes, those with the largest
    page_id are responses and the others revisit it; null page_ids count as smallest. An archive ends with the record that
    brings it to archive_bytes, so that it fits in a reader's memory however long the pages are. Other columns are not
    read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    # Size and digest decide equality; sizes keep short payloads apart from long ones.
    known = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    copies = known.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    copies = materialize(copies.where("n > 1 and winner is not null").select("digest", "size", "winner"), "copies")
    marked = known.join(copies, ["digest", "size"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")))
    records = marked.select("page_id", "url", "payload", "refers_to").mapInArrow(partial(_written, archive_bytes=archive_bytes), "archive int, value binary")
    records.select("archive", F.col("value").cast("string")).write.partitionBy("archive").option("lineSep", "\x00").text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
w AS (SELECT digest, n, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY ALL)
SELECT page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN winner IS NULL OR page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM p LEFT JOIN w USING (digest, n)
"""
