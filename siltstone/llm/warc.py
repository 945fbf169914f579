"""WARC archives: write records, index them first, then read selected ones by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.files import read_range, write_file
from siltstone.store import Table, new_folder

# Fixed value: the profile URI of revisit records with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    min_revisit_bytes: int = 1000
    file_bytes: int = 32 << 20  # a file is closed once it is this large
    gap_bytes: int = 64 << 10  # unselected bytes that a coalesced read may span
    read_bytes: int = 8 << 20  # a coalesced read ends once it is this long
    broadcast_rows: int = 500_000  # repeated payloads whose digests (80 bytes) tasks hold; beyond them the join shuffles the payloads
    date: str = "1970-01-01T00:00:00Z"  # pages carry no date


def _uri(url: str) -> str:
    """The URL with control characters, spaces and non-ASCII as percent escapes."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _info(date: str) -> bytes:
    block = b"software: siltstone\r\nformat: WARC File Format 1.0\r\n"
    head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def _writer(folder: str, p: WarcParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, rows = bytearray(), []

        def flush():
            name = f"{uuid.uuid4().hex}.warc.gz"  # of this attempt alone, which the index then names
            write_file(f"{folder}/{name}", bytes(data))
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            arrays.insert(1, pa.array([name] * len(rows), pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names=["page_id", "file", "offset", "length", "url", "digest", "record_type"])

        for batch in batches:
            for page_id, url, html, digest, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if not data:
                    data += _info(p.date)
                one = record(page_id, url, html, refers_to, revisit, p.date)
                rows.append((page_id, len(data), len(one), url, digest, "revisit" if revisit else "response"))
                data += one
                if len(data) >= p.file_bytes:
                    yield flush()
                    data, rows = bytearray(), []
        if rows:
            yield flush()

    return run


@dataclass(frozen=True)
class Archive:
    folder: str
    index: DataFrame  # page_id, file, offset, length, url, digest, record_type
    params: WarcParams


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", params: WarcParams = WarcParams()) -> Archive:
    """Write one record per row and index it.

    A null html is an empty payload, a null url an empty one. Of equal payloads of at least
    `min_revisit_bytes` the largest page_id is the response; every row of that id is (repeated rows too),
    all other rows refer to it. A null page_id is never preferred. An empty table writes nothing.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    p = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("html")
    ).withColumn("digest", F.sha1("html"))
    large = p.where(F.octet_length("html") >= params.min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    shared = Table(large.where("n > 1 and keep is not null").select(F.col("digest").alias("d2"), "keep"), "repeated-payloads").df
    # Payloads stay in their tasks: only digests are shuffled, as long as the repeated ones are known to be few.
    shared = F.broadcast(shared) if shared.count() <= params.broadcast_rows else shared
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("keep")) & F.col("keep").isNotNull(), F.lit(False))
    rows = p.join(shared, F.col("digest") == F.col("d2"), "left").select(
        "page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("keep")).alias("refers_to")
    )
    folder = new_folder(spark, "warc")
    return Archive(folder, Table(rows.mapInArrow(_writer(folder, params), INDEX), "warc-index").df, params)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(folder: str, p: WarcParams):
    def decode(name: str, run: list[tuple]):
        start = run[0][1]
        data = read_range(f"{folder}/{name}", start, run[-1][1] + run[-1][2] - start)
        out = []
        for _, offset, length, url in run:
            head, block = parse(data[offset - start : offset - start + length])
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.decode().rsplit("Content-Length: ", 1)[1])
            digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            kind, refers_to = head["WARC-Type"], None
            if kind == "response":
                if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the payload does not match its digest")
            else:
                payload, refers_to = None, int(head["WARC-Refers-To"].removeprefix("<urn:page:")[:-1])
            ident = head["WARC-Record-ID"].removeprefix("<urn:page:")[:-1]
            out.append((int(ident) if ident else None, url, size, digest, kind, refers_to, payload))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if ranges:
                    end = ranges[-1][1] + ranges[-1][2]
                    if row[0] != ranges[0][0] or row[1] - end > p.gap_bytes or end - ranges[0][1] >= p.read_bytes:
                        yield decode(ranges[0][0], ranges)
                        ranges = []
                ranges.append(row)
        if ranges:
            yield decode(ranges[0][0], ranges)

    return run


def read_records(archive: Archive, selected: DataFrame | None = None) -> DataFrame:
    """Read the records of the given index rows (default: all), checking each response against its digest.

    Returns page_id, url, payload_bytes and payload_digest (of the full payload), record_type, refers_to,
    and payload (null for revisits).
    """
    rows = (archive.index if selected is None else selected).select("file", "offset", "length", "url")
    dealt = rows.repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(archive.folder, archive.params), RECORDS)
