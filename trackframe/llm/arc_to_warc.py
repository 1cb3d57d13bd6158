"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block that tells which fields the header
line of a record has; a record is such a line, the declared number of bytes
and a new line.  The converter reads the fields of either version, cuts blocks
by their declared lengths and makes up what WARC asks for and ARC lacks:
record identifiers (from the archive's fields, so that a second run gives the
same), timestamps, types and digests.  The version block becomes a warcinfo
record, an HTTP message a response (or a revisit of one), anything else a
resource.  Archives are written through Spark's
text writer, one value a file, whose line separator is the last byte; so they
may lie in any file system that Spark knows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm.storage import new_path

#: Fields of a header line by version, as the formats define them.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_SAFE = "".join(map(chr, range(0x21, 0x7F)))
_CRLF = b"\r\n"


def _url(url: str | None) -> str:
    """A URL that fits a header line: blanks, controls and other characters are percent-encoded; null is a dash."""
    return quote(url, safe=_SAFE) if url else "-"


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} {0 if version == 1 else 1} trackframe\n{' '.join(FIELDS[version])}\n\n"
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    head += " 200 - - 0 " + name if version == 2 else ""
    return f"{head} {len(body)}\n{body}\n".encode()


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    """One ARC record around a block (the HTTP message)."""
    head = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", "-", "-", str(offset), name]
    return f"{' '.join(head)} {len(block)}\n".encode() + block + b"\n"


def http_message(payload: bytes, page: int | None) -> bytes:
    """A payload as a crawler would have stored it, with the page's id in a header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
    return (head + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n").encode() + payload


def write_arc(pages: DataFrame, path: str, file_bytes: int = 16 << 20, date: str = "20080430204825") -> None:
    """(page_id, url, html) -> ARC files, of versions 1 and 2 in turn, gzip-compressed.

    A null html has an empty payload, a null url a dash.  A file is closed
    after the record that brings it to ``file_bytes``.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        out: list[bytes] = []
        size = version = 0
        name = ""

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["file"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html = (batch.column(c)[k].as_py() for c in range(3))
                if not out:
                    version, name = 1 + (part + seq) % 2, f"pages-{part}-{seq}.arc"
                    out = [version_block(version, name, date)]
                    size = len(out[0])
                out.append(arc_record(version, _url(url), date, http_message((html or "").encode(), page), size, name))
                size += len(out[-1])
                if size >= file_bytes:
                    yield closed()
                    out, seq = [], seq + 1
        if out:
            yield closed()

    packed = pages.select("page_id", "url", "html").mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def unpacked(content: bytes) -> tuple[bytes, str | None]:
    """The bytes of an archive, whether whole or of gzip members, and what is wrong after them; one pass, however many members."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out = []
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
            while some := f.read1(1 << 20):
                out.append(some)
    except (EOFError, OSError, zlib.error) as e:
        return b"".join(out), f"a damaged gzip file: {e}"
    return b"".join(out), None


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of an ARC file, its version block first (``URL`` is filedesc://...): fields by name, offset and block.

    Which fields a header line has is read from the version block; the URL
    is what comes before the last ones, so that blanks in it do no harm.  A
    length that is not a number or reaches beyond the file raises ValueError,
    and so does a version block that does not name the fields.
    """
    data, wrong = unpacked(content)
    at, fields, archive = 0, None, ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        n = len(fields) if fields else (10 if len(line.split(" ")) >= 10 else 5)
        parts = line.rsplit(" ", n - 1)
        if end < 0 or len(parts) != n or not re.fullmatch(r"[0-9]{1,18}", parts[-1]) or end + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"no ARC record at byte {at}: {line[:80]!r}")
        block = data[end + 1 : end + 1 + int(parts[-1])]
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file starts with its version block")
            lines = block.split(b"\n")
            fields, archive = lines[1].decode().rstrip("\r").split(" ") if len(lines) > 1 else [], parts[0]
            if not {"URL", "Archive-date", "Archive-length"} <= set(fields):
                raise ValueError("the version block names no fields of URL, date and length")
            yield {"URL": parts[0], "Archive-date": parts[2], "Content-type": parts[3], "archive": archive, "at": at, "block": block}
        else:
            yield dict(zip(fields, parts)) | {"archive": archive, "at": at, "block": block}
        at = end + 1 + len(block)
    if wrong:
        raise ValueError(wrong)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head (with its empty line) and the payload of an HTTP message; all is payload if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def arc_date(text: str) -> str:
    """The timestamp of an ARC record, of 8 to 14 digits, as WARC writes it; the epoch if it is none of the calendar and the clock."""
    d = text.ljust(14, "0") if re.fullmatch(r"[0-9]{8,14}", text) else ""
    try:
        when = datetime(*(int(x) for x in (d[:4], d[4:6], d[6:8], d[8:10], d[10:12], d[12:14])))
    except ValueError:
        when = datetime(1970, 1, 1)
    return f"{when:%Y-%m-%dT%H:%M:%SZ}" if when.year >= 1000 else f"{when.year:04d}{when:-%m-%dT%H:%M:%SZ}"


RECORD = "record_id string, target string, date string, head binary, payload binary, digest string, bytes long, page_id long, kind string, content_type string"


def _converted(r: dict) -> tuple:
    """What the WARC record of an ARC record needs, in the order of RECORD."""
    if r["at"] == 0:
        head, payload, kind, media = b"", r["block"], "warcinfo", "text/plain"
    else:
        head, payload = split_http(r["block"])
        kind, media = ("response", "application/http; msgtype=response") if head else ("resource", r.get("Content-type", "application/octet-stream"))
    digest = hashlib.sha256(payload).hexdigest()
    page = re.search(rb"(?im)^X-Page-Id: (-?\d+)", head)
    key = f"{r['archive']} {r['URL']} {r['Archive-date']} {r['at']} {page[1].decode() if page else ''} {digest}"
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}"
    return (name, r["URL"], arc_date(r["Archive-date"]), head, payload, digest, len(payload), int(page[1]) if page else None, kind, media)


def convert(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """ARC files -> what their WARC records need: identifier, target, timestamp, HTTP head, payload, digest, length, page id, kind, content type.

    A damaged file raises ValueError; unless ``strict``, what lies before the
    damage is converted, and the file gives a row of kind "damaged" with its
    path as target and the reason as payload.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        kinds = [pa.string()] * 3 + [pa.binary()] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows: list[tuple] = []
                size = 0
                try:
                    for r in parse_arc(batch.column(0)[k].as_buffer().to_pybytes()):
                        rows.append(_converted(r))
                        size += rows[-1][6]
                        if size >= 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as e:
                    if strict:
                        raise
                    rows.append((None, batch.column(1)[k].as_py(), None, b"", str(e).encode(), None, 0, None, "damaged", None))
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content", "path").mapInArrow(records, RECORD)


def damaged(converted: DataFrame) -> DataFrame:
    """(path, reason) of the files that ``convert`` could not read to their end."""
    return converted.filter("kind = 'damaged'").select(F.col("target").alias("path"), F.col("payload").cast("string").alias("reason"))


def with_types(records: DataFrame, least: int = 100) -> DataFrame:
    """Records -> with record_type, and of revisits the page id, identifier, target and date of the response that they repeat.

    Of responses with equal payloads of at least ``least`` bytes that with the
    smallest page id (then identifier; ids before nulls) stays one.  Resources
    and warcinfo records keep their kind and block; rows of damaged files are
    left out.  Digests are grouped with partial sums, and only narrow rows meet
    in the join on them; payloads are joined by record identifier, which is
    unique.
    """
    records = records.filter("kind <> 'damaged'")
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "target", "date")
    narrow = records.filter((F.col("bytes") >= least) & (F.col("kind") == "response")).select("record_id", "page_id", "digest", "target", "date")
    first = narrow.groupBy("digest").agg(F.min(key).alias("f"), F.count("*").alias("n")).filter("n > 1")
    first = first.select("digest", F.col("f.page_id").alias("refers_to"), F.col("f.record_id").alias("refers_to_id"), F.col("f.target").alias("refers_to_target"), F.col("f.date").alias("refers_to_date"))
    again = narrow.select("record_id", "digest").join(first, "digest").filter("record_id <> refers_to_id").drop("digest").withColumn("record_type", F.lit("revisit"))
    return records.join(again, "record_id", "left").withColumn("record_type", F.coalesce("record_type", "kind"))


def warc_record(r: dict) -> bytes:
    """One WARC record; a revisit has the HTTP head alone as its block."""
    kind = r["record_type"]
    block = r["head"] if kind == "revisit" else r["head"] + r["payload"]
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"])]
    if kind == "warcinfo":
        head += [("WARC-Filename", r["target"].removeprefix("filedesc://"))]
    else:
        head += [("WARC-Target-URI", r["target"]), ("WARC-Payload-Digest", f"sha256:{r['digest']}")]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", r["content_type"]), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{r['refers_to_id']}>")]
        head += [("WARC-Refers-To-Target-URI", r["refers_to_target"]), ("WARC-Refers-To-Date", r["refers_to_date"])]
        head += [("X-Refers-To-Page", str(r["refers_to"]))] if r["refers_to"] is not None else []
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + _CRLF + block + _CRLF + _CRLF


def write_warc(records: DataFrame, path: str, file_bytes: int = 16 << 20) -> None:
    """Records with types -> gzip-compressed WARC files under ``path``."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                out.append(warc_record({n: batch.column(n)[k].as_py() for n in batch.schema.names}))
                size += len(out[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["file"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["file"])

    packed = records.mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: named fields (lower-case) and the block, cut by its declared length."""
    data, wrong = unpacked(content)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(at, end)].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
            raise ValueError(f"the WARC record at byte {at} declares no length")
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} has another length than declared")
        yield fields, block
        at = end + 8 + n
    if wrong:
        raise ValueError(wrong)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files -> (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target, date), a row a record.

    Length and digest are those of the full payload, also for revisits; the
    payload of a response or resource is held against both.  warcinfo records
    give no row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target", "date"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for f, block in parse_warc(batch.column(0)[k].as_buffer().to_pybytes()):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    page, size = re.search(rb"(?im)^X-Page-Id: (-?\d+)", head), re.search(rb"(?im)^Content-Length: (\d+)", head)
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    whole = f["warc-type"] != "revisit"
                    if whole and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{f['warc-record-id']} has another payload than its digest says")
                    n = len(payload) if whole or not size else int(size[1])
                    other = f.get("x-refers-to-page")
                    out.append((int(page[1]) if page else None, n, digest, f["warc-type"], int(other) if other else None, f["warc-record-id"].strip("<>"), f["warc-target-uri"], f["warc-date"]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target string, date string"
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, ddl)


def through_archives(pages: DataFrame, file_bytes: int = 16 << 20) -> DataFrame:
    """pages -> the rows that ``read_warc`` gives after pages went to ARC files and these to WARC files.

    A row for each row of ``pages``; null and empty html are empty payloads
    (always responses), page ids may be null or repeated, other columns are not
    looked at, no row gives an empty table.  Repeated page ids with equal
    payloads refer to their own id; which of them is the response is settled
    by the record identifier.  A page of any length is one record, and a file
    is closed after it, so a file holds ``file_bytes`` and one page at most.
    """
    spark = pages.sparkSession
    arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arcs, file_bytes)
    write_warc(with_types(convert(spark, arcs)), warcs, file_bytes)
    return read_warc(spark, warcs)
