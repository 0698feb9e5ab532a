"""Legacy ARC archives converted to WARC, and both read back by length.

An ARC file starts with a version block that names its version and the fields
of the header line before each record; version 1 lines hold URL, IP, date,
type and length, version 2 lines also result code, checksum, location, offset
and file name.  The declared length, never the content, says where a record
ends.  The converter turns each record into a WARC/1.1 record: identifier and
digests from the content, ISO date from the 14 digits, ``response`` for the
first of equal payloads (at least ``min_bytes`` long, smallest id first) and
``revisit`` for the others, which refer to it and repeat no payload.

Archives are files in a shared folder, written with Spark's text sink
(records are valid UTF-8) and read with its binary source, one file a row.  A
file is closed after ``FILE_CHUNKS`` chunks of about ``CHUNK`` bytes (a longer
record is a chunk of its own), and readers inflate it as a stream, so a worker
holds one compressed file and one chunk.  Every converted record carries its
row's id in an extension field, since a URL need not be unique.

Nulls: null html is an empty payload, a null URL is written as ``-``.  Rows
with a null id come after all others.  Repeated rows are records each, and
alike: all of the smallest id are responses.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch

ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Revisits held in a broadcast at most; beyond it they are joined.
BROADCAST_REVISITS = 100_000
#: Bytes of records in one chunk, and chunks in one file.
CHUNK, FILE_CHUNKS = 1 << 20, 64
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def version_block(version: int, name: str) -> bytes:
    """The first record of an ARC file."""
    fields = ARC_V1 if version == 1 else ARC_V2
    body = f"{version} 0 newsloom\n{fields}\n".encode()
    return f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, block: bytes, name: str, mime: str = "text/html") -> bytes:
    """A header line and a block of the given version."""
    url = _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"
    if version == 1:
        return f"{url} 0.0.0.0 {date} {mime} {len(block)}\n".encode() + block
    return f"{url} 0.0.0.0 {date} {mime} 200 - - 0 {name} {len(block)}\n".encode() + block


def _stream(data: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(data) if isinstance(data, bytes) else data


def read_arc(data: bytes | BinaryIO) -> Iterator[dict]:
    """The records of an ARC file: the version block's fields name the header's."""
    data, fields = _stream(data), None
    while raw := data.readline():
        line = raw.rstrip(b"\r\n")
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        size = int(parts[-1])
        block = data.read(size)
        if len(block) < size:
            raise ValueError(f"ARC record is cut short: {line[:200]!r}")
        if line.startswith(b"filedesc://"):
            fields = block.split(b"\n")[1].decode().split(" ")
            continue
        if fields is None or len(parts) < len(fields):
            raise ValueError(f"ARC header line does not fit the version block: {line[:200]!r}")
        cut = len(parts) - len(fields) + 1  # old writers left blanks in URLs
        yield dict(zip(fields, [" ".join(parts[:cut]), *parts[cut:]], strict=True)) | {"block": block}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, the raw head and the body of an HTTP message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return {}, b"", block
    fields = dict(x.decode("utf-8", "replace").split(":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields.items()}, head + mark, body


def warc_date(digits: str) -> str:
    """ISO date of ARC's digits; missing ones are those of the start of the period."""
    d = (re.sub(r"\D", "", digits) + "00000101000000"[len(re.sub(r"\D", "", digits)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    """A record's identifier, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def warc_record(arc: dict, refers_to: tuple[str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``refers_to``: key and URL of the first equal one."""
    fields, head, body = http_parts(arc["block"])
    digest, date, key = base32_sha1(body), warc_date(arc["Archive-date"]), fields.get("x-row-id", "")
    block = head if refers_to else arc["block"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(arc['URL'], date, digest, key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {arc['URL']}",
        f"WARC-IP-Address: {arc['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Row-Id: {key}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        other, url = refers_to
        lines[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(url, date_of(other), digest, other)}", f"WARC-Refers-To-Target-URI: {url}", f"X-Refers-To-Row-Id: {other}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def date_of(key: str) -> str:
    """The tables have no crawl time: all captures are of one instant."""
    return warc_date("20240101000000")


def read_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower case) and block of each record of a WARC file."""
    data = _stream(data)
    while raw := data.readline():
        if not raw.strip(b"\r\n"):
            continue
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {raw[:200]!r}")
        fields = {}
        while line := data.readline().rstrip(b"\r\n"):
            k, mark, v = line.decode("utf-8", "replace").partition(":")
            if mark:
                fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = data.read(size)
        if len(block) < size:
            raise ValueError(f"WARC record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def _write(lines: DataFrame, path: str) -> None:
    """Chunks of text as compressed files of bounded size."""
    lines.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def _files(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.format("binaryFile").load(path).select("content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[BinaryIO]:
    """The archives of binary rows, inflated as they are read."""
    for batch in batches:
        for raw in batch.column(0):
            yield io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw.as_buffer())), 1 << 18)


def _runs(items: Iterable[Any], size: Callable[[Any], int], most: int) -> Iterator[list]:
    """Items in runs of about ``most`` bytes, in order."""
    held, total = [], 0
    for x in items:
        n = size(x)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += n
    if held:
        yield held


def _chunk(parts: list[bytes], between: bytes = b"") -> pa.RecordBatch:
    """One row of text."""
    return pa.record_batch([pa.array([between.join(parts)], pa.binary()).cast(pa.string())], ["value"])


def _table(rows: Iterable[tuple], names: list[str], types: list[pa.DataType], most: int = 5000) -> Iterator[pa.RecordBatch]:
    """Small rows in batches."""
    held: list[tuple] = []
    for x in rows:
        held.append(x)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def write_arc(pages: DataFrame, path: str, version: int = 1) -> None:
    """ARC files of (page_id, url, html); the id is in the block's HTTP head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-v{version}.arc"

        def records() -> Iterator[bytes]:
            for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
                for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = (html or "").encode()
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Row-Id: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                    yield arc_record(version, url or "-", "20240101000000", block, name)

        for n, parts in enumerate(_runs(records(), len, CHUNK)):
            # the writer opens a new file after every FILE_CHUNKS rows
            yield _chunk(([version_block(version, name)] if n % FILE_CHUNKS == 0 else []) + parts, b"\n")

    _write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value string"), path)


def arc_payloads(spark_df: DataFrame, path: str, min_bytes: int) -> DataFrame:
    """row_id, url, digest and bytes of each record of the ARC files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for archive in _opened(batches):
                for arc in read_arc(archive):
                    fields, _, body = http_parts(arc["block"])
                    yield int(fields["x-row-id"]) if fields.get("x-row-id") else None, arc["URL"], base32_sha1(body), len(body)

        yield from _table(rows(), ["row_id", "url", "digest", "bytes"], [pa.int64(), pa.string(), pa.string(), pa.int64()])

    return _files(spark_df, path).mapInArrow(run, "row_id long, url string, digest string, bytes long").where(F.col("bytes") >= min_bytes)


def convert(pages: DataFrame, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Convert the ARC files at ``arc`` to WARC files at ``warc``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payloads = scratch.save(arc_payloads(pages, arc, min_bytes), "payloads")
    first = payloads.groupBy("digest", "bytes").agg(F.min(F.struct(F.col("row_id").isNull().alias("last"), F.col("row_id").alias("id"), F.col("url").alias("u"))).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # copies may be a third of all records: both sides are salted
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    named = payloads.withColumn("salt", F.pmod(F.xxhash64("row_id", "url"), F.lit(16)).cast("int")).join(first, ["digest", "bytes", "salt"])
    revisits = named.where(~F.col("row_id").eqNullSafe(F.col("f.id"))).select(_key("row_id").alias("key"), "digest", _key("f.id").alias("to_key"), F.col("f.u").alias("to_url"))
    revisits = scratch.save(revisits.distinct(), "revisits")

    if revisits.count() <= BROADCAST_REVISITS:
        held = spark.sparkContext.broadcast({(r["key"], r["digest"]): (r["to_key"], r["to_url"]) for r in revisits.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for archive in _opened(batches):
                for parts in _runs((warc_record(x, held.value.get(row_key(x["block"]))) for x in read_arc(archive)), len, CHUNK):
                    yield _chunk(parts)

        _write(_files(pages, arc).mapInArrow(run, "value string"), warc)
        return

    fields = ("URL", "IP-address", "Archive-date", "block")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in _opened(batches):
            for rows in _runs(((*row_key(x["block"]), *(x[f] for f in fields)) for x in read_arc(archive)), lambda r: len(r[5]) + 200, CHUNK):
                yield pa.record_batch([pa.array(c, pa.binary() if i == 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], ["key", "digest", "url", "ip", "date", "block"])

    def join_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for a in range(0, batch.num_rows, 200) for r in batch.slice(a, 200).to_pylist())
        for parts in _runs((warc_record(dict(zip(fields, (r["url"], r["ip"], r["date"], r["block"]), strict=True)), None if r["to_key"] is None else (r["to_key"], r["to_url"])) for r in rows), len, CHUNK):
            yield _chunk(parts)

    rows = _files(pages, arc).mapInArrow(split, "key string, digest string, url string, ip string, date string, block binary")
    joined = rows.join(revisits, ["key", "digest"], "left").select("url", "ip", "date", "block", "to_key", "to_url")
    _write(joined.mapInArrow(join_out, "value string"), warc)


def _key(column: str):
    """A row's id as text, empty if null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(block: bytes) -> tuple[str, str]:
    """Id field and payload digest of an ARC record's block."""
    fields, _, body = http_parts(block)
    return fields.get("x-row-id", ""), base32_sha1(body)


def read_back(pages: DataFrame, warc: str) -> DataFrame:
    """row_id, payload_bytes, payload_digest, record_type, refers_to of the WARC files at ``warc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for archive in _opened(batches):
                for fields, block in read_warc(archive):
                    head, _, body = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    response = fields["warc-type"] == "response"
                    if response and base32_sha1(body) != digest:
                        raise ValueError(f"payload digest of {fields['warc-record-id']} does not fit")
                    to = fields.get("x-refers-to-row-id")
                    yield int(fields["x-row-id"]) if fields.get("x-row-id") else None, len(body) if response else int(head["content-length"]), digest, fields["warc-type"], int(to) if to else None

        yield from _table(rows(), ["row_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])

    return _files(pages, warc).mapInArrow(run, "row_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, min_bytes: int = 0, version: int = 1) -> DataFrame:
    """Pages written to ARC, converted to WARC and read back; one row for each page."""
    scratch = Scratch(pages.sparkSession, "archive")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc, version)
    convert(pages, arc, warc, min_bytes)
    return read_back(pages, warc)
