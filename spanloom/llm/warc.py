"""WARC archives of pages: written as records with revisits, read back by a salvage reader.

Writing: each record is a gzip member of its own; Spark's own text writer lays members end to end. Of equal payloads of
at least `least` bytes the one with the smallest page_id is stored, others are revisits of it.

Reading: a record must have a version line, headers, a length that fits, a closing blank line and a payload that matches
its digest. After a failed check the reader searches for the next valid gzip member or version line, recovers the
records behind it and logs the bytes between as a gap (file, start, end, reason), which count as quarantined.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 100
#: Bytes of records, before compression, that one row of the writer holds, and rows of a file: together they bound a file.
ROW_BYTES = 1 << 20
PER_FILE = 128
VERSION = b"WARC/1.1\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP headers."""
    return block.partition(b"\r\n\r\n")[2]


def _record_at(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record that begins at a version line, the end of it and what is wrong with it."""
    line = _VERSION.match(data, at)
    if not line:
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, "headers without end"
    headers: dict[str, str] = {}
    for row in data[line.end() : head].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None, at, "malformed header"
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return None, at, "no length"
    end = head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "length does not fit"
    block = data[head + 4 : end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha256:") and hashlib.sha256(payload_of(block)).hexdigest() != digest[7:]:
        return None, at, "payload digest differs"
    return Record(headers, block), end + 4, ""


def _plain(data: bytes, base: int = 0) -> Iterator[Record | Gap]:
    at, bad, why = 0, -1, ""
    while at < len(data):
        record, end, reason = _record_at(data, at)
        if record:
            if bad >= 0:
                yield Gap(base + bad, base + at, why)
                bad = -1
            yield record
            at = end
            continue
        if bad < 0:
            bad, why = at, reason
        following = _VERSION.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad >= 0:
        yield Gap(base + bad, base + len(data), why)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive, compressed member by member or as a whole or not at all, and the gaps between them.

    Gaps are in bytes of the archive; those inside a compressed member that unpacks only in part or holds bad records
    cover the member and are named so.
    """
    at, bad, why = 0, -1, ""
    while at < len(data):
        if data.startswith(_MEMBER, at):
            unpack = zlib.decompressobj(31)
            out, reason, step, place = [], "", 1 << 16, at
            while not unpack.eof and place < len(data):
                before = unpack.copy()
                try:
                    out.append(unpack.decompress(data[place : place + step]))
                except zlib.error:
                    reason = "member is damaged"
                    out.extend(_up_to_damage(before, data[place : place + step]))
                    break
                place += step
            if not unpack.eof and not reason:
                reason = "member is cut off"
            found = list(_plain(b"".join(out)))
            if reason and found and isinstance(found[-1], Record):
                found.pop()  # nothing behind it shows the damage, so it may be in there
            if reason and not any(isinstance(x, Record) for x in found):
                bad, why = (at, reason) if bad < 0 else (bad, why)
                at = _next_start(data, at + 1)
                continue
            if bad >= 0:
                yield Gap(bad, at, why)
                bad = -1
            end = _next_start(data, at + 1) if reason else min(place, len(data)) - len(unpack.unused_data)
            for x in found:
                yield x if isinstance(x, Record) else Gap(at, end, f"in member: {x.reason}")
            if reason and not any(isinstance(x, Gap) for x in found):
                yield Gap(at, end, reason)
            at = end
            continue
        record, end, reason = _record_at(data, at)
        if record:
            if bad >= 0:
                yield Gap(bad, at, why)
                bad = -1
            yield record
            at = end
            continue
        bad, why = (at, reason) if bad < 0 else (bad, why)
        at = _next_start(data, at + 1)
    if bad >= 0:
        yield Gap(bad, len(data), why)


def _up_to_damage(unpack, data: bytes) -> Iterator[bytes]:
    """What a step that fails as a whole gives byte by byte."""
    try:
        for k in range(len(data)):
            yield unpack.decompress(data[k : k + 1])
    except zlib.error:
        return


def _next_start(data: bytes, at: int) -> int:
    version, member = _VERSION.search(data, at), data.find(_MEMBER, at)
    return min([x for x in (version.start() if version else -1, member) if x >= 0], default=len(data))


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to rows of gzip members that lack a closing zero byte, which the writer adds as the end of a line.

    A member ends in its record's length, little-endian, hence in a zero byte below 16 MB; behind longer ones an empty
    member stands, which does.
    """
    def row(members: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(members)
        whole = whole if whole.endswith(b"\0") else whole + _member(b"")
        return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["value"])

    members, size = [], 0
    for batch in batches:
        for record in batch.column("value"):
            data = record.as_py()
            members.append(_member(data))
            size += len(data)
            if size >= ROW_BYTES:
                yield row(members)
                members, size = [], 0
    if members:
        yield row(members)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, per_file: int = PER_FILE) -> None:
    """Write one record per row of pages (page_id, url, html) to gzip archives in a new folder that Spark can write.

    Damage to an archive costs the records whose members it hits. A file holds at most `per_file` rows of members, each
    ROW_BYTES of records and what the last of them goes beyond.

    A null html is an empty payload, a null url an own URN; line breaks in a url are dropped. A null page_id is written
    as an empty one; it never is the one that others refer to, unless no copy has an id.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), r"[\r\n]", "").alias("url"),
                        "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    first = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    told = rows.join(first, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    end = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), end, end)
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))

    def header(name: str, value) -> list:
        return [F.lit(f"{name}: "), value, end]

    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record = F.concat(
        F.lit(VERSION.decode()), *header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        *header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), ident, F.lit(">"))), *header("WARC-Target-URI", F.col("url")),
        *header("WARC-Date", F.lit("1970-01-01T00:00:00Z")), *header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        *header("X-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("revisit"), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\n"),
        )).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), end, end, block, end,
    )
    packed = told.select(F.concat(record, end).cast("binary").alias("value")).mapInArrow(_pack, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "gap_start", "gap_end", "reason"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def ident(value: str | None) -> str | None:
        m = re.fullmatch(r"<urn:page:(.*)>", value or "")
        return m[1] if m and m[1] else None

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for k in range(batch.num_rows):
            path, rows, size = batch.column("path")[k].as_py(), [], 0
            for x in salvage(batch.column("content")[k].as_py()):
                if isinstance(x, Gap):
                    rows.append((path, *[None] * 7, x.start, x.end, x.reason))
                else:
                    h, kind = x.headers, x.headers.get("warc-type")
                    payload = payload_of(x.block) if kind == "response" else None
                    length = len(payload) if payload is not None else int(h.get("x-payload-length") or 0)
                    rows.append((path, ident(h.get("warc-record-id")), length, h.get("warc-payload-digest", "").removeprefix("sha256:"), kind,
                                 ident(h.get("warc-refers-to")), h.get("warc-target-uri"), payload, None, None, None))
                    size += len(payload or b"")
                if len(rows) >= 1000 or size > 4 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of the archives in a folder. A gap has a reason and no record_type. A file, bounded when it is written, is
    unpacked by one task; nothing is shuffled.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(
        _read, "file string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, "
        "payload binary, gap_start long, gap_end long, reason string",
    )


def archive_report(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write pages to archives, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    One row per row of pages, also for repeated ones. An empty table gives an empty table.
    """
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, folder).filter("record_type is not null").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
