"""ARC to WARC conversion, WARC writing and reading.

The converter reads legacy ARC archives: the first record (``filedesc://``)
names the version, whose field list says how the URL lines of all records are
parsed (version 1: five fields, version 2: ten); the declared length, never a
search for a separator, delimits the content.  For each record it synthesises a
WARC record: a name-based URN, an ISO timestamp from the 14 digits, a type from
the URL scheme and content, and SHA-1 digests in base 32.

Payloads that are equal in full (grouped by SHA-256 and length) are stored once,
in the record with the smallest id; the others become revisit records.  The
groups are found on digests, which are pre-aggregated, so a payload that a third
of all records share costs one row per task.

Archives are files in the shared folder, written by Spark's own committer.  Each
record is a gzip member of its own (a record over 8 MiB, several), as WARC readers
expect.  A segment, one ARC archive and its warcinfo record, is closed at
``segment_bytes`` or ``segment_records``; a file holds ``segments_per_file`` of them,
so neither a row nor a file grows with the input beyond the largest records.  The
reader unpacks member by member and parses record by record.

ARC lines must have a date.  Pages without one (no ``date_col``, or a null in it)
get a synthetic date counted from their id.  Null payloads are empty payloads; null
URLs are empty URLs.  Records without an id are never revisits.  Records that
repeat an id and payload are all of the same type.  An empty table gives no
records.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.llm.storage import new_path, shuffle_cleanup, small_batches

#: Field lists of the two ARC versions (fixed values of the format).
ARC_FIELDS = {
    b"1": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"],
    b"2": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset", b"Filename", b"Archive-length"],
}
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SEPARATOR = b"\r\n\r\n"
MEMBER_BYTES = 8 << 20


class ArcError(ValueError):
    """A malformed ARC header line or length."""


@dataclass
class ArcRecord:
    fields: dict[bytes, bytes]
    content: bytes
    offset: int


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""

    def to_bytes(self) -> bytes:
        """The record without its closing separator."""
        lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url_token(url: str | None) -> bytes:
    return quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]|").encode() or b"-"


def write_arc(name: str, version: int, records: Iterator[tuple[str | None, str, str, bytes]]) -> bytes:
    """An ARC archive of (url, 14-digit date, content type, content) records."""
    out = io.BytesIO()

    def line(url: bytes, date: str, kind: str, size: int) -> bytes:
        if version == 1:
            return b"%s 0.0.0.0 %s %s %d\n" % (url, date.encode(), kind.encode(), size)
        return b"%s 0.0.0.0 %s %s 200 - - %d %s %d\n" % (url, date.encode(), kind.encode(), out.tell(), name.encode(), size)

    about = b"%d 0 flowlattice\n%s\n" % (version, b" ".join(ARC_FIELDS[b"%d" % version]))
    out.write(line(f"filedesc://{name}".encode(), "20000101000000", "text/plain", len(about)) + about + b"\n")
    for url, date, kind, content in records:
        out.write(line(_url_token(url), date, kind, len(content)) + content + b"\n")
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC archive; the version's field list parses every header line."""
    at, names = 0, None
    while at < len(data):
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ArcError(f"header line without end at byte {at}")
        values = data[at:stop].rstrip(b"\r").split(b" ")
        if names is None:
            if not values[0].startswith(b"filedesc://"):
                raise ArcError("the first record must be a filedesc")
            about = data[stop + 1 :].split(b"\n", 2)
            version = about[0].split(b" ")[0]
            if version not in ARC_FIELDS:
                raise ArcError(f"unknown ARC version {version!r}")
            names = ARC_FIELDS[version]
        if len(values) != len(names):
            raise ArcError(f"{len(values)} fields at byte {at}, {len(names)} expected")
        fields = dict(zip(names, values, strict=True))
        try:
            size = int(fields[b"Archive-length"])
        except ValueError:
            raise ArcError(f"bad length at byte {at}") from None
        content = data[stop + 1 : stop + 1 + size]
        if size < 0 or len(content) != size:
            raise ArcError(f"record at byte {at} is cut short")
        yield ArcRecord(fields, content, at)
        at = stop + 1 + size
        if data[at : at + 1] == b"\n":
            at += 1


def split_http(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """(headers in lower case, payload) of an HTTP response, or None."""
    if not content.startswith(b"HTTP/"):
        return None
    head, _, payload = content.partition(b"\r\n\r\n")
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in pairs}, payload


def timestamp(digits: bytes) -> str:
    """ISO 8601 of an ARC date; shorter dates are filled up to the start of their period."""
    full = digits.decode("ascii", "replace")
    if not full.isdigit() or not 4 <= len(full) <= 14:
        raise ArcError(f"bad date {digits!r}")
    full += "00000101000000"[len(full) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def convert(arc: bytes, archive: str, refers_to: dict[str, str] | None = None, id_header: str = "x-record-name") -> Iterator[WarcRecord]:
    """The WARC records equivalent to an ARC archive.

    A record's name is its HTTP header ``id_header`` or its place.  ``refers_to``
    maps "name digest" of a record that repeats a payload to the original's name.
    """
    for record in read_arc(arc):
        url = record.fields[b"URL"].decode("utf-8", "replace")
        date = timestamp(record.fields[b"Archive-date"])
        http = split_http(record.content)
        name = http[0].get(id_header) if http else None
        headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(name or f"{archive}#{record.offset}"), "WARC-Date": date}
        if url.startswith("filedesc://"):
            headers |= {"WARC-Type": "warcinfo", "WARC-Filename": archive, "Content-Type": "application/warc-fields"}
            yield WarcRecord(headers, f"software: flowlattice\r\nconformsTo: WARC 1.0\r\nconverted-from: ARC {record.content[:1].decode()}\r\n".encode())
            continue
        headers["WARC-Target-URI"] = url
        if record.fields[b"IP-address"] != b"0.0.0.0":
            headers["WARC-IP-Address"] = record.fields[b"IP-address"].decode("latin-1")
        if http is None:
            headers |= {"WARC-Type": "resource", "Content-Type": record.fields[b"Content-type"].decode("latin-1"), "WARC-Block-Digest": f"sha1:{sha1_base32(record.content)}"}
            yield WarcRecord(headers, record.content)
            continue
        headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1_base32(http[1])}"}
        block = record.content
        original = (refers_to or {}).get(f"{name} {sha1_base32(http[1])}")
        if original is not None:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE.decode(), "WARC-Refers-To": record_id(original), "X-Refers-To-Name": original}
            block = block[: len(block) - len(http[1])]
        headers["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
        yield WarcRecord(headers, block)


def members(record: bytes) -> Iterator[bytes]:
    """The gzip members of a record: one, or several where it is longer than ``MEMBER_BYTES``."""
    for at in range(0, max(1, len(record)), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield packer.compress(record[at : at + MEMBER_BYTES]) + packer.flush()


def unpacked(data: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The text of gzip members that stand one after another, piece by piece."""
    reader = zlib.decompressobj(31)
    for at in range(0, len(data), step):
        rest = bytes(data[at : at + step])
        while rest:
            yield reader.decompress(rest)
            rest = b""
            if reader.eof:
                rest, reader = reader.unused_data, zlib.decompressobj(31)


def read_warc(pieces: Iterator[bytes]) -> Iterator[WarcRecord]:
    """Records of a WARC archive that comes in pieces, delimited by their declared lengths."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        looked = 0
        while (stop := held.find(SEPARATOR, looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more():
                if held:
                    raise ValueError("a record's header is cut short")
                return
        first, *lines = held[:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC version in {first[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        end = stop + 4 + int(headers.pop("Content-Length"))
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != SEPARATOR:
            raise ValueError("a record's block is cut short")
        block = bytes(held[stop + 4 : end])
        del held[: end + 4]
        yield WarcRecord(headers, block)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the records whose payload a smaller id has too."""
    keyed = pages.where(f"n_bytes >= {min_bytes}").select("page_id", "digest")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    return keyed.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _capture_date(i: int | None) -> str:
    day, second = divmod(abs(i or 0), 86_400)
    return f"{2000 + day // 336 % 100:04d}{1 + day // 28 % 12:02d}{1 + day % 28:02d}{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, min_bytes: int = 0,
    segment_bytes: int = 16 << 20, segment_records: int = 500, segments_per_file: int = 16,
) -> str:
    """Pages as legacy ARC segments, converted and written as WARC files of gzip members; returns the folder.

    ``date_col`` holds 14 digits.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    date = F.lit(None).cast("string") if date_col is None else F.col(f"`{date_col}`").cast("string")
    keyed = small_batches(pages).select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"), date.alias("date"))
    keyed = keyed.withColumn("digest", F.sha2("body", 256)).withColumn("n_bytes", F.length("body"))
    joined = keyed.join(revisits(keyed, min_bytes), ["page_id", "digest"], "left").select("page_id", "url", "body", "date", "refers_to")

    def segment(number: int, rows: list[tuple]) -> bytes:
        name = f"segment-{TaskContext.get().partitionId()}-{number}.arc"
        contents, refers = [], {}
        for i, _, payload, _, first in rows:
            shown = "" if i is None else f"X-Record-Name: {i}\r\n"
            contents.append(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{shown}\r\n".encode() + payload)
            if first is not None:
                refers[f"{i} {sha1_base32(payload)}"] = str(first)
        lines = ((url, day or _capture_date(i), "text/html", content) for (i, url, _, day, _), content in zip(rows, contents, strict=True))
        arc = write_arc(name, 1 + number % 2, lines)
        return b"".join(m for w in convert(arc, name, refers) for m in members(w.to_bytes() + SEPARATOR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.append(tuple(v.as_py() for v in row))
                size += len(held[-1][2])
                if size >= segment_bytes or len(held) >= segment_records:
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([segment(number, held)], pa.binary())})
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment(number, held)], pa.binary())})

    folder = new_path(spark, "warc")
    # a member ends with its length, below 2**24, so its last byte is zero: the text sink writes it as line end
    value = F.expr("CAST(substring(segment, 1, length(segment) - 1) AS STRING)").alias("value")
    records = joined.mapInArrow(run, "segment binary").select(value)
    with shuffle_cleanup(spark):
        records.write.option("lineSep", "\0").option("maxRecordsPerFile", segments_per_file).text(folder)
    return folder


RECORDS_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string, record_id string"


def read_archives(spark, folder: str) -> DataFrame:
    """One row per response or revisit record of the archives in a folder.

    A response's length and digest are taken from its payload and must agree with
    its headers; a revisit's come from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in read_warc(unpacked(memoryview(content.as_buffer()))):
                    kind = record.headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = split_http(record.block)
                    digest = record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    if kind == "response" and (sha1_base32(payload) != digest or len(payload) != size):
                        raise ValueError(f"record {record.headers['WARC-Record-ID']} does not match its digest")
                    name, other = http.get("x-record-name"), record.headers.get("X-Refers-To-Name")
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                    rows.append((name and int(name), size, digest, kind, other and int(other), record.headers["WARC-Target-URI"], record.headers["WARC-Date"], record.headers["WARC-Record-ID"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, RECORDS_SQL)
