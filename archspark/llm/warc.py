"""WARC archives with deduplicated payloads, and a splittable reader.

Writing: payload digests are grouped; of equal payloads of at least ``min_bytes`` the page with the largest id is written as
``response``, the others as ``revisit`` that name it. Only digests of repeated payloads are joined back. Every task writes files of
one gzip member per record, and gives a file its name when it is complete.

Reading: files are cut into byte ranges. A task looks for gzip magic in its range, takes a place for a member only if it inflates to a
WARC header with type and length, then follows the chain of members, and owns the records that start in its
range, reading past its end to finish the last one.

Defined results: a null payload is an empty one; a null id never names a response while another id has the payload; rows that
repeat the largest id are all responses; a null url is left out; control characters and blanks in urls are percent-encoded;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm.common import open_fs, raw_texts, slices, staged

GZIP_MAGIC = b"\x1f\x8b\x08"
RECORD_URN = "urn:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; the HTTP header carries the length of the full payload, for revisits too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: quote(m[0]), url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Add ``keeper``: the largest id of the pages with this payload, where that is another page."""
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    long_enough = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= min_bytes
    narrow = pages.filter(long_enough).select("page_id", digest.alias("digest"))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    repeated = staged(groups.filter("n > 1 and keeper is not null").select(F.col("digest").alias("kept_digest"), "keeper"), "warc-repeated")
    joined = pages.withColumn("digest", F.when(long_enough, digest)).join(repeated, F.col("digest") == F.col("kept_digest"), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("keeper")).alias("keeper"))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    file_bytes: int = 256 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives; returns the written manifest (name, size, records)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_fs(folder)
        task, files, out, size, records = TaskContext.get().partitionId(), 0, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["name", "size", "records"])

        for part in slices(batches, 64):
            for page_id, url, payload, keeper in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw_texts(part.column(2)), part.column(3).to_pylist()):
                if out is None:
                    name, size, records = f"{task:06d}-{files:04d}.warc.gz", 0, 0
                    temporary = f"{base}/.{name}-{uuid.uuid4().hex}.tmp"
                    out, files = fs.open_output_stream(temporary), files + 1
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record(page_id, url, payload, base32_sha1(payload), keeper, keeper is not None, date)
                size += out.write(pack.compress(data) + pack.flush())
                records += 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(with_originals(rows, min_bytes).mapInArrow(run, "name string, size bigint, records bigint"), "warc-manifest")


class Member:
    """Inflates the gzip member at a place of a file, reading on as needed."""

    def __init__(self, source, at: int, buffer: bytes, buffer_at: int):
        self.source, self.inflate, self.plain = source, zlib.decompressobj(31), bytearray()
        self.next_read, self.pending = buffer_at + len(buffer), memoryview(buffer)[at - buffer_at :]
        self.fed = at

    def until(self, wanted) -> bool:
        """Inflate until ``wanted(plain)`` or the end of the member; False if the member breaks off."""
        while not self.inflate.eof and not wanted(self.plain):
            if not len(self.pending):
                self.source.seek(self.next_read)
                self.pending = memoryview(self.source.read(READ))
                self.next_read += len(self.pending)
                if not len(self.pending):
                    return False
            take, self.pending = self.pending[:16384], self.pending[16384:]
            try:
                self.plain += self.inflate.decompress(take)
            except zlib.error:
                return False
            self.fed += len(take) - len(self.inflate.unused_data)
        return True


def parse_header(plain: bytearray) -> tuple[dict[str, str], int] | None:
    """Fields and the place of the block, if this is the header of a WARC record."""
    end = plain.find(b"\r\n\r\n")
    if end < 0 or not plain.startswith(b"WARC/1."):
        return None
    lines = plain[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def read_range(source, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records whose member starts in [start, end)."""
    source.seek(start)
    buffer = source.read(min(end + len(GZIP_MAGIC) - 1, size) - start)
    at = start
    while True:
        at = buffer.find(GZIP_MAGIC, at - start)
        if at < 0 or start + at >= end:
            return
        at += start
        member = Member(source, at, buffer, start)
        found = parse_header(member.plain) if member.until(lambda p: b"\r\n\r\n" in p or not b"WARC/1.".startswith(bytes(p[:7]))) else None
        if not found:
            at += 1
            continue
        fields, block_at = found
        if not member.until(lambda p: False):
            raise ValueError(f"the record at {at} breaks off or is damaged")
        block = bytes(member.plain[block_at : block_at + int(fields["content-length"])])
        if len(block) < int(fields["content-length"]):
            raise ValueError(f"the record at {at} is shorter than it says")
        yield at, fields, block
        at = member.fed
        if at >= end:
            return


def page_of(urn: str | None) -> str | None:
    found = re.fullmatch(rf"<{RECORD_URN}(.*)>", urn or "")
    return found[1] or None if found else None


def read_archives(spark: SparkSession, folder: str, files: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """One row per record: page (id as text), url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest.

    ``files`` has name and size. A payload that doesn't match its digest is an error.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    n = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1  # tasks; else adaptive execution joins small rows
    ranges = files.filter("size > 0").select("name", "size", F.explode(starts).alias("first")).repartitionByRange(n, "name", "first")
    names = ["page", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for part in batches:
            for name, size, first in zip(*(part.column(c).to_pylist() for c in ("name", "size", "first"))):
                rows = []
                with fs.open_input_file(f"{base}/{name}") as source:
                    for _, fields, block in read_range(source, first, min(first + range_bytes, size), size):
                        rows.append(parsed(fields, block))
                        if len(rows) == 64:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    schema = "page string, url string, record_type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"
    return ranges.mapInArrow(run, schema)


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't match its digest")
    n = len(payload) if kind == "response" or not length else int(length[1])
    return (
        page_of(fields.get("warc-record-id")),
        fields.get("warc-target-uri"),
        kind,
        page_of(fields.get("warc-refers-to")),
        payload if kind == "response" else None,
        n,
        digest,
    )
