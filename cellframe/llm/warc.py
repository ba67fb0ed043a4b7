"""Legacy web archives to WARC: parse ARC records by their version's header line and declared length, and
synthesise WARC records (identifier, timestamp, type, digests) that say the same.

`read_arc` gives the records of ARC files as rows, `convert_arcs` writes them as WARC files, `read_warc` reads WARC
files.  Files are written by Spark's text writer as raw bytes, so that commits, retries and remote file systems are
Spark's: each row is one gzip member, and the line separator is an empty member.  Files are read as binary rows,
inflated and parsed as streams; a file has to fit Spark's limit of 2 GB for such a row, and the writers here cut
files by a number of records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, materialize, new_path, pieces, read, remove_path, ship

#: Records of a file that is written here, and the most payloads whose copies are looked up by broadcast.
RECORDS, HEAVY = 5_000, 10_000
_NOTHING = zlib.compressobj(9, zlib.DEFLATED, 31).flush()  # an empty gzip member
#: The fields of an ARC header line by version of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length"),
}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArcError(ValueError):
    """An ARC file that breaks its format."""


class Arc(NamedTuple):
    fields: dict[str, str]
    block: bytes
    offset: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_record(fields: dict[str, str], block: bytes, version: int = 1) -> bytes:
    """One ARC record; fields that are missing or empty become '-'."""
    values = {**fields, "Archive-length": str(len(block))}
    line = " ".join((values.get(f) or "-").replace("\n", "%0A").replace("\r", "%0D") for f in FIELDS[version])
    return line.encode() + b"\n" + block + b"\n"


def arc_start(name: str, date: str, version: int = 1) -> bytes:
    """The version block that begins an ARC file."""
    block = f"{version} 0 cellframe\n{' '.join(FIELDS[version])}\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
            "Result-code": "200", "Filename": name}
    return arc_record(line, block, version)


def _line(line: bytes, names: tuple[str, ...], offset: int) -> dict[str, str]:
    """Fields from the right, since a URL may hold blanks."""
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdecimal():
        raise ArcError(f"no header line of {len(names)} fields at byte {offset}")
    return dict(zip(names, parts, strict=True))


class Stream:
    """Lines and runs of bytes from chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held, self.at = self.held[self.at :] + bytes(chunk), 0
        return True

    def line(self) -> bytes | None:
        """The next line with its end; None at the end of the stream."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.held) - 1
                break
        out = self.held[self.at : end + 1]
        self.at = end + 1
        return out or None

    def take(self, size: int) -> bytes:
        """The next `size` bytes, fewer at the end of the stream."""
        parts, left = [], size
        while left > len(self.held) - self.at:
            parts.append(self.held[self.at :])
            left -= len(parts[-1])
            self.held, self.at = b"", 0
            if not self._more():
                return b"".join(parts)
        parts.append(self.held[self.at : self.at + left])
        self.at += left
        return b"".join(parts)


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file, gzipped (in one member or many) or not, in chunks."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, size = zlib.decompressobj(31), 1 << 12
        while not member.eof:
            part = view[at : at + size]
            if not len(part):
                raise ArcError(f"the gzip member at byte {at} is cut off")
            out = member.decompress(part)
            at += len(part) - len(member.unused_data)
            size = min(2 * size, 1 << 20)
            if out:
                yield out


def gzipped(data: bytes) -> bytes:
    member = zlib.compressobj(1, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


def parse_arc(data: bytes) -> Iterator[Arc]:
    """The records of an ARC file, gzipped or not, the version block first; offsets count bytes of the content."""
    stream, at, names = Stream(inflated(data)), 0, None
    while (line := stream.line()) is not None:
        begin, at = at, at + len(line)
        if not line.strip(b"\r\n"):
            continue
        line, first = line.rstrip(b"\r\n"), None
        if names is None:
            # The first line is written in the fields that its own block names; its length is always last.
            if not line.startswith(b"filedesc://"):
                raise ArcError("an ARC file begins with filedesc://")
            length = line.rsplit(b" ", 1)[-1]
            if not length.isdigit():
                raise ArcError("the version block has no length")
            first = stream.take(int(length))
            version = first.split(b" ", 1)[0]
            if not version.isdigit() or int(version) not in FIELDS:
                raise ArcError(f"ARC version {version!r} is not known")
            names = FIELDS[int(version)]
        fields = _line(line, names, begin)
        size = int(fields["Archive-length"])
        block = stream.take(size) if first is None else first
        at += len(block)
        if len(block) < size:
            raise ArcError(f"the record at byte {begin} declares {size} bytes and has {len(block)}")
        yield Arc(fields, block, begin)


def timestamp(date: str) -> str:
    """YYYYMMDDhhmmss (or a prefix of it down to the year) as an ISO 8601 UTC time."""
    digits = re.match(r"\d{4,14}", date)
    full = (digits[0] if digits else "1970") + "00000101000000"[len(digits[0]) if digits else 4 :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(url: str, date: str, digest: str, offset: int | str) -> str:
    """The same record gets the same identifier each time it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{url} {date} {digest} {offset}')}>"


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header, or the whole block if it has none."""
    if not block.startswith(b"HTTP/"):
        return block
    end = re.search(rb"\r\n\r\n|\n\n", block)
    return block[end.end() :] if end else b""


def http_header(block: bytes, name: bytes) -> str | None:
    """A header of an HTTP block."""
    head = block[: len(block) - len(payload_of(block))]
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def convert(record: Arc, name: str | None = None, revisits: str | None = None, more: dict[str, str] | None = None) -> tuple[dict[str, str], bytes]:
    """The headers and block of the WARC record that stands for an ARC record.

    The version block becomes warcinfo, HTTP answers responses, others resources.  With `revisits` (the record id of
    a response of the same payload) a revisit without payload is made.  `name` is the record's identifier, if known.
    """
    f, block = record.fields, record.block
    url, date = f["URL"], timestamp(f["Archive-date"])
    payload = payload_of(block)
    digest = base32_sha1(payload)
    http, info = block.startswith(b"HTTP/"), url.startswith("filedesc://")
    out = {"WARC-Type": "response" if http else "resource"}
    if info:
        out = {"WARC-Type": "warcinfo", "WARC-Filename": url[len("filedesc://") :]}
    elif revisits is not None:
        out = {"WARC-Type": "revisit", "WARC-Profile": _IDENTICAL, "WARC-Refers-To": revisits}
        block = block[: len(block) - len(payload)]
    if not info:
        out["WARC-Target-URI"] = url
        if f["IP-address"] not in ("-", "0.0.0.0"):
            out["WARC-IP-Address"] = f["IP-address"]
    out |= {"WARC-Date": date, "WARC-Record-ID": name or record_id(url, date, digest, record.offset)}
    kind = f["Content-type"] if f["Content-type"] != "-" else "application/octet-stream"
    if info:
        kind, block = "application/warc-fields", b"software: cellframe\r\nformat: WARC File Format 1.1\r\n"
    else:
        out["WARC-Payload-Digest"] = f"sha1:{digest}"
        kind = "application/http; msgtype=response" if http else kind
    out |= {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": kind} | (more or {})
    return out | {"Content-Length": str(len(block))}, block


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, gzipped or not, by declared lengths."""
    stream = Stream(inflated(data))
    while (line := stream.line()) is not None:
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{line[:40]!r} begins no WARC record")
        headers = {}
        while (line := stream.line()) is not None and line.strip(b"\r\n"):
            key, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            headers[key] = value.strip()
        yield headers, stream.take(int(headers["Content-Length"]))


def _raw(rows: DataFrame, path: str, records: int) -> None:
    """Writes a binary column `value` as it is, each row a gzip member, at most `records` rows a file."""
    (rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1"))
     .option("maxRecordsPerFile", records).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _http(html: bytes, page: int | None) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: %s\r\nContent-Length: %d\r\n\r\n" % (
        str(page).encode(), len(html)) + html


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000", records: int = RECORDS) -> None:
    """Writes `pages` (page_id, url, html) as ARC files of the given version, a gzip member a record.

    A null html is an empty payload, a null url '-'; the page's id stands in a header of the HTTP answer."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, n = gzipped(arc_start("pages.arc", date, version)), 0
        for batch in pieces(batches, "html", 8 << 20):
            out = []
            for page, url, html in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")], strict=True):
                line = {"URL": url or "-", "Archive-date": date, "Content-type": "text/html", "Result-code": "200"}
                record = gzipped(arc_record(line, _http(html, page), version))
                out.append(start + record if n % records == 0 else record)  # each file begins with a version block
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _raw(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                      F.coalesce("html", F.lit("")).cast("binary").alias("html")).mapInArrow(run, "value binary"), path, records)


_FACTS = [("record", pa.string()), ("tagged", pa.bool_()), ("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64())]
_BODY = [("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("block", pa.binary())]
_DDL = "record string, tagged boolean, page_id bigint, digest string, size bigint"


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of ARC files: record (the identifier that WARC gives it), tagged (whether a page's id is known),
    page_id, digest and size of the payload and, with `blocks`, url, ip, date, kind and block.

    Versions 1 and 2, gzipped or not, payloads of any bytes.  A file that breaks the format raises ArcError."""
    ship(spark)
    schema = pa.schema(_FACTS + _BODY * blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for f, block, offset in parse_arc(content.as_py()):
                    payload, page = payload_of(block), http_header(block, b"X-Page-Id")
                    digest, url, date = base32_sha1(payload), f["URL"], f["Archive-date"]
                    known = page is not None and page.lstrip("-").isdecimal()
                    at = f"page {page}" if page is not None else f"{name.rsplit('/', 1)[-1]} {offset}"
                    row = (record_id(url, timestamp(date), digest, at), page is not None, int(page) if known else None, digest, len(payload))
                    rows.append(row + (url, f["IP-address"], date, f["Content-type"], block) if blocks else row)
                    held += len(block) if blocks else 64
                    if held > 8 << 20:
                        yield batch_of(schema, *zip(*rows, strict=True))
                        rows, held = [], 0
                if rows:
                    yield batch_of(schema, *zip(*rows, strict=True))

    ddl = _DDL + ", url string, ip string, date string, kind string, block binary" * blocks
    return _files(spark, path).mapInArrow(run, ddl)


def convert_arcs(spark: SparkSession, source: str, target: str, least: int = 0, records: int = RECORDS) -> None:
    """Writes the records of ARC files as WARC files, a gzip member a record.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response and the
    others revisit it; records that repeat that id are responses each, and a record whose page has no id is one
    unless another of its payload has an id.  Records of no page are ordered by their identifiers instead.
    Copies of a payload that very many records have are found by broadcast (HEAVY payloads at most), so they are not
    dealt to one task; all others by a join.
    """
    ship(spark)
    facts = read_arc(spark, source, blocks=False)
    first = F.max(F.struct("tagged", F.col("page_id"), "record")).alias("first")
    groups = materialize(facts.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1"), "payloads")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    heavy = groups.where(F.col("copies") * HEAVY > total).where("copies > 1000")  # HEAVY rows at most
    rows = read_arc(spark, source).join(F.broadcast(heavy.select("digest", F.col("first").alias("heavy"))), "digest", "left")
    key = F.when(F.col("heavy").isNull(), F.col("digest")).otherwise(F.col("record"))
    told = rows.withColumn("key", key).join(groups.select(F.col("digest").alias("key"), "first"), "key", "left")
    told = told.withColumn("first", F.coalesce("heavy", "first"))
    other = F.when(F.col("tagged"), F.col("first.page_id").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))).otherwise(
        F.col("first.record") != F.col("record"))
    revisits = F.when(F.col("first").isNotNull() & other & (F.col("size") >= least) & ~F.col("url").startswith("filedesc://"), F.col("first"))
    told = told.select("url", "ip", "date", "kind", "block", "record", revisits["record"].alias("revisits"), revisits["page_id"].alias("to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "block", 8 << 20):
            out = []
            for r in batch.to_pylist():
                fields = {"URL": r["url"], "IP-address": r["ip"], "Archive-date": r["date"], "Content-type": r["kind"]}
                more = {} if r["to"] is None else {"X-Refers-To-Page": str(r["to"])}
                out.append(gzipped(serialise(*convert(Arc(fields, r["block"], 0), r["record"], r["revisits"], more))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _raw(told.mapInArrow(run, "value binary"), target, records)


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()),
                     ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())),
                     ("block", pa.binary())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    for batch in batches:
        for content in batch.column("content"):
            yield from parse_warc(content.as_py())


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: record_id, record_type, uri, date, payload_digest (bare), refers_to_id, headers, block."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for h, block in _records(batches):
            digest = h.get("WARC-Payload-Digest")
            rows.append((h.get("WARC-Record-ID"), h["WARC-Type"], h.get("WARC-Target-URI"), h.get("WARC-Date"),
                         digest and digest.partition(":")[2], h.get("WARC-Refers-To"), list(h.items()), block))
            held += len(block)
            if held > 8 << 20:
                yield batch_of(_RECORD, *zip(*rows, strict=True))
                rows, held = [], 0
        if rows:
            yield batch_of(_RECORD, *zip(*rows, strict=True))

    return _files(spark, path).mapInArrow(run, "record_id string, record_type string, uri string, date string, payload_digest string, "
                                          "refers_to_id string, headers map<string, string>, block binary")  # fmt: skip


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page's record in WARC files: what is
    not in a revisit's headers stands in the head of its HTTP answer."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for h, block in _records(batches):
            page = http_header(block, b"X-Page-Id")
            if page is None:
                continue
            if h["WARC-Type"] == "revisit":
                size, digest = int(http_header(block, b"Content-Length") or 0), h["WARC-Payload-Digest"].partition(":")[2]
            else:
                payload = payload_of(block)
                size, digest = len(payload), base32_sha1(payload)
            to = h.get("X-Refers-To-Page")
            rows.append((None if page == "None" else int(page), size, digest, h["WARC-Type"], None if to is None else int(to)))
        yield batch_of(_READ, *(zip(*rows, strict=True) if rows else [[]] * len(_READ)))

    return _files(spark, path).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def write_pages(pages: DataFrame, path: str, least: int = 0, version: int = 1, date: str = "20240101000000", records: int = RECORDS) -> None:
    """Writes `pages` (page_id, url, html; other columns are ignored) as WARC files, by way of ARC files of the given version.

    Null htmls are empty payloads, null urls '-', rows that repeat an id records each (see `convert_arcs`); a very long
    html takes one record; an empty table gives files without pages."""
    spark = pages.sparkSession
    between = new_path(spark, "arc")
    write_arc(pages, between, version, date, records)
    convert_arcs(spark, between, path, least, records)
    remove_path(spark, between)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(read(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as first, sha1(html) as hex, octet_length(encode(html)) as size from p group by html)
select p.page_id, g.size as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
    (16 * (instr('0123456789abcdef', substr(g.hex, 1 + (5 * i) // 4, 1)) - 1) + instr('0123456789abcdef', substr(g.hex, 2 + (5 * i) // 4, 1)) - 1)
    >> (3 - (5 * i) % 4)::int) & 31)::int, 1)), '') as payload_digest,
  case when g.first is null or p.page_id = g.first then 'response' else 'revisit' end as record_type,
  case when p.page_id is distinct from g.first then g.first end as refers_to
from p join g on p.html = g.html
"""
