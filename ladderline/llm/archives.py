"""Legacy ARC archives to WARC.

ARC files start with a version block that names the fields of all header lines in the file; a record
is a header line with those fields, the last one the declared length, and that many bytes. Both
versions of the header line are read. A record becomes a WARC record with what ARC lacks: an
identifier made from its content, an ISO timestamp, a type, block and payload digests. Of responses
with equal payloads one is kept whole, the others become revisits of it.

Files go through Spark's own writers and readers only, so they may lie in any file system it knows:
one gzip stream per task, records ended by the blank lines that the format asks for. Files are read
as whole bytes and parsed by declared lengths, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_batches
from ladderline.session import new_path

MIN_REVISIT_BYTES = 1000
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_CRLF = b"\r\n"
_CHUNK = 1 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard one for URLs
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "20200101000000"
_RECORDS = ("page_id long, url string, date string, content_type string, http binary, payload binary, "
            "payload_bytes long, payload_digest string, record_id string")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
                    ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_id", pa.string())])


def _field(value: str) -> str:
    """A header field holds no blanks and isn't empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value) or "-"


def version_block(version: int, name: str) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 ladderline\n{_V1 if version == 1 else _V2}\n".encode()
    tail = f"{len(body)}" if version == 1 else f"200 - - 0 {_field(name)} {len(body)}"
    return f"filedesc://{_field(name)} 0.0.0.0 {_DATE} text/plain {tail}\n".encode() + body


def arc_record(version: int, url: str, date: str, block: bytes, name: str) -> bytes:
    tail = f"{len(block)}" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - 0 {_field(name)} {len(block)}"
    return f"{_field(url)} 0.0.0.0 {date} text/html {tail}\n".encode() + block


def write_arc(pages: DataFrame, path: str) -> None:
    """`pages` (page_id, url, html) as ARC files, odd tasks in version 2, even ones in version 1.

    The page's id is a header of the archived response, as ARC has no field for one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"

        def rows() -> Iterator[tuple]:
            yield (version_block(version, name),)
            for batch in batches:
                for page_id, url, html in zip(*batch.columns):
                    payload, number = html.as_py() or b"", page_id.as_py()
                    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}"]
                    head += [] if number is None else [f"X-Page-Id: {number}"]
                    head += [] if url.as_py() is None else ["X-Page-Url: " + base64.b64encode(url.as_py().encode()).decode()]
                    block = "\r\n".join(head).encode() + b"\r\n\r\n" + payload
                    yield (arc_record(version, url.as_py() or "", _DATE, block, name),)

        yield from arrow_batches(rows(), pa.schema([("value", pa.binary())]), weigh=lambda r: len(r[0]))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    # text files hold bytes as they come; a record ends with a line end
    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "gzip").option("lineSep", "\n").text(path))


class Bytes:
    """Reads lines and counted bytes from gzip data without unpacking it whole."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held = memoryview(data), 0, bytearray()
        self.packed = data[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31)
        self.start = 0

    def _more(self) -> bool:
        if self.start > _CHUNK:
            del self.held[:self.start]
            self.start = 0
        if not self.packed:
            part = self.data[self.at:self.at + _CHUNK]
            self.at += len(part)
            self.held += part
            return bool(part)
        while True:
            if self.unpack.eof:  # files may be several gzip members in a row
                rest = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
                source = rest
            elif self.unpack.unconsumed_tail:
                source = self.unpack.unconsumed_tail
            else:
                source = b""
            if not source:
                part = self.data[self.at:self.at + (_CHUNK >> 2)]
                self.at += len(part)
                source = bytes(part)
                if not source:
                    return False
            found = self.unpack.decompress(source, _CHUNK)
            if found:
                self.held += found
                return True

    def line(self) -> bytes | None:
        """Up to the next newline, without it; None at the end."""
        searched = self.start
        while (end := self.held.find(b"\n", searched)) < 0:
            before = len(self.held) - self.start
            if not self._more():
                rest = bytes(self.held[self.start:])
                self.start = len(self.held)
                return rest or None
            searched = self.start + before
        found = bytes(self.held[self.start:end])
        self.start = end + 1
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) - self.start < n and self._more():
            pass
        found = bytes(self.held[self.start:self.start + n])
        if len(found) < n:
            raise ValueError(f"the archive ends {n - len(found)} bytes before a declared length")
        self.start += n
        return found


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file as fields by the names of its own version block, with `block`."""
    source, names = Bytes(data), None
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if parts[0].startswith("filedesc://"):
            body = source.take(int(parts[-1])).decode("utf-8", "replace").split("\n")
            names = [x.lower() for x in body[1].split()]
            continue
        if names is None or len(parts) != len(names):
            raise ValueError(f"not a header line of this archive's version: {line[:80]!r}")
        found = dict(zip(names, parts))
        yield found | {"block": source.take(int(found["archive-length"]))}


def _http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head, payload and headers of an archived response; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, _, payload = block.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return head + b"\r\n\r\n", payload, headers


def _iso(date: str) -> str:
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(spark: SparkSession, arc_path: str, payloads: bool = True) -> DataFrame:
    """WARC fields of every ARC record below `arc_path`; with `payloads` also its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for data in batch.column(0):
                    for record in parse_arc(data.as_py()):
                        head, payload, headers = _http(record["block"])
                        digest = hashlib.sha1(payload).hexdigest()
                        page_id = int(headers["x-page-id"]) if "x-page-id" in headers else None
                        name = f"{page_id} {record['url']} {record['archive-date']} {digest}"
                        yield (page_id, record["url"], _iso(record["archive-date"]), record["content-type"],
                               head if payloads else None, payload if payloads else None, len(payload), digest,
                               f"urn:uuid:{uuid.uuid5(_NAMESPACE, name)}")

        yield from arrow_batches(rows(), _ARROW, weigh=lambda r: len(r[5] or b"") + 200)

    return spark.read.format("binaryFile").load(arc_path).select("content").mapInArrow(run, _RECORDS)


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(row: dict) -> bytes:
    """One WARC record without the two line ends after it."""
    revisit = row["refers_to"] is not None
    block = row["http"] if revisit else row["http"] + row["payload"]
    fields = [
        "WARC/1.1", "WARC-Type: " + ("revisit" if revisit else "response"), f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {row['date']}", f"WARC-Target-URI: {row['url']}",
        "WARC-Block-Digest: " + _base32(hashlib.sha1(block).hexdigest()), "WARC-Payload-Digest: " + _base32(row["payload_digest"]),
    ]
    if revisit:
        fields += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{row['refers_to_id']}>", f"X-Refers-To-Page: {row['refers_to']}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """`records` (columns of `converted`, refers_to, refers_to_id) as WARC files, each with a warcinfo record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            info = b"software: ladderline\r\nformat: WARC File Format 1.1\r\n"
            part = TaskContext.get().partitionId()
            fields = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'info {part}')}>",
                      f"WARC-Date: {_iso(_DATE)}", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}", "", ""]
            yield ("\r\n".join(fields).encode() + info,)
            for batch in batches:
                names = batch.schema.names
                for values in zip(*batch.columns):
                    yield (warc_record({k: v.as_py() for k, v in zip(names, values)}),)

        yield from arrow_batches(rows(), pa.schema([("value", pa.binary())]), weigh=lambda r: len(r[0]))

    (records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of one WARC file."""
    source = Bytes(data)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record start: {line[:80]!r}")
        headers = {}
        while (line := source.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.take(int(headers["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id of the archives' pages.

    A response's size and digest are taken from its payload and must agree with its header; a
    revisit's are those it states.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for data in batch.column(0):
                    for headers, block in parse_warc(data.as_py()):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        _, payload, http = _http(block)
                        stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"payload digest of {headers['warc-record-id']} is wrong")
                        url = http.get("x-page-url")
                        yield (int(http["x-page-id"]) if "x-page-id" in http else None,
                               base64.b64decode(url).decode() if url is not None else None,
                               len(payload) if kind == "response" else int(http["content-length"]), stated, kind,
                               int(headers["x-refers-to-page"]) if "x-refers-to-page" in headers else None,
                               headers["warc-record-id"].strip("<>"))

        yield from arrow_batches(rows(), schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = MIN_REVISIT_BYTES) -> None:
    """ARC files below `arc_path` as WARC files in `warc_path`.

    Of records with equal payloads of `least` bytes or more, that with the largest page_id stays a
    response. Records without a page_id stay responses. Only ids and digests are grouped; the first
    pass reads no payload into Spark.
    """
    keys = converted(spark, arc_path, payloads=False).where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = (
        keys.groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "top")
    )
    records = converted(spark, arc_path)
    joined = records.join(first, (records["payload_digest"] == first["_digest"]) & (records["payload_bytes"] == first["_bytes"]), "left")
    again = F.col("page_id").isNotNull() & (F.col("record_id") != F.col("top.record_id"))
    write_warc(joined.select(*records.columns, F.when(again, F.col("top.page_id")).alias("refers_to"),
                             F.when(again, F.col("top.record_id")).alias("refers_to_id")), warc_path)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back; see `read_warc`.

    Null html is an empty payload, a null url stays null, a null page_id is never a revisit. Rows
    that repeat a page_id and its html have one record id; each stays, all of them the response where
    theirs is the largest id. Other columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
