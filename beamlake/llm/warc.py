"""Legacy archive converter: ARC files to WARC files and back to rows.

write_arc writes pages as ARC records, version 1 or 2 by file; read_arc reads them by their version-specific header
line and declared length; write_warc synthesises record identifiers, timestamps, types and digests; read_warc reads
the archives back. Archives are gzip files with a member per record, as crawlers write them, so that a record can be
read from its offset alone; readers take any number of members, zero padding between them, and plain files. A row
that goes to Spark's text writer is a whole file of about FILE_BYTES compressed bytes, so files go through Hadoop's
file system and its commit protocol. They come back with binaryFile and are decompressed as a stream: a task holds a
compressed file and one record. A file whose last member is cut short is an error, as is a record whose digest differs.

A payload is the page's html in UTF-8. Of records with equal payloads of at least REVISIT_BYTES the one
with the largest page_id is the response and the others revisit it; rows that repeat that page_id are
responses too. A null page_id ranks lowest; where all are null all are responses. A null html is an empty
payload, a null url an empty address. A payload may be as long as a record of a task's memory. Payloads are bytes
throughout. Other columns of pages are not read. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.llm.common import drop_path, light, new_path, stored

FILE_BYTES, REVISIT_BYTES, DATE = 16 << 20, 1_000, "20200101000000"
#: zlib's level, and bytes that are decompressed and handed on at a time.
LEVEL, STEP, BATCH_BYTES = 3, 1 << 16, 4_000_000
#: The field lines of the two versions, as their specification has them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_PAGE = re.compile(rb"(?m)^X-Page-Id: (-?\d+)\r$")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Stream:
    """The bytes of an archive, plain or of any number of gzip members, decompressed as they are asked for."""

    def __init__(self, blob: bytes):
        self.raw, self.at, self.buffer, self.inflate = memoryview(blob), 0, bytearray(), None
        self.packed = bytes(self.raw[:2]) == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.packed:
            part = self.raw[self.at : self.at + STEP]
            self.buffer += part
            self.at += len(part)
            return len(part) > 0
        if self.inflate is None or self.inflate.eof:
            while self.at < len(self.raw) and self.raw[self.at] == 0:
                self.at += 1
            if self.at >= len(self.raw):
                return False
            self.inflate = zlib.decompressobj(31)
        part = self.raw[self.at : self.at + STEP]
        if not len(part):
            raise ValueError("the last member of the archive is cut short")
        self.buffer += self.inflate.decompress(part, 16 * STEP)
        self.at += len(part) - len(self.inflate.unused_data or self.inflate.unconsumed_tail)
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        seen = 0
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                end = len(self.buffer)
                break
        if not self.buffer:
            return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 1]
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _url(u: str | None) -> str:
    """ARC fields are parted by blanks, so blanks and controls are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u or "") or "-"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 beamlake\n{FIELDS[version]}\n"
    head = {1: f"filedesc://{name} 0.0.0.0 {DATE} text/plain {len(body)}", 2: f"filedesc://{name} 0.0.0.0 {DATE} text/plain 200 - - 0 {name} {len(body)}"}
    return f"{head[version]}\n{body}\n".encode()


def arc_record(version: int, name: str, page_id: int | None, url: str | None, html: bytes | None) -> bytes:
    """One record: header line, then an HTTP response that carries page_id in a header of its own."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page_id is None else f"X-Page-Id: {page_id}\r\n") + "\r\n"
    content = http.encode() + (html or b"")
    lead = f"{_url(url)} 0.0.0.0 {DATE} text/html"
    head = f"{lead} {len(content)}\n" if version == 1 else f"{lead} 200 - - 0 {name} {len(content)}\n"
    return head.encode() + content + b"\n"


class _Files:
    """Members of one task's archives, joined to files of about FILE_BYTES; each is a row for the text writer."""

    def __init__(self, kind: str):
        self.task, self.kind, self.n, self.parts, self.size = TaskContext.get().partitionId(), kind, 0, [], 0

    @property
    def name(self) -> str:
        return f"part-{self.task}-{self.n}.{self.kind}"

    def put(self, data: bytes) -> None:
        self.parts.append(member(data))
        self.size += len(self.parts[-1])

    def full(self) -> bool:
        return self.size >= FILE_BYTES

    def close(self) -> pa.RecordBatch:
        data = b"".join(self.parts)
        self.parts, self.size, self.n = [], 0, self.n + 1
        # The writer ends each row with a zero byte: the last of a member shorter than 16 MB, else padding.
        return pa.RecordBatch.from_arrays([pa.array([data[:-1] if data.endswith(b"\0") else data], pa.binary())], names=["value"])


def _write(files: DataFrame, path: str) -> None:
    """One file per row. A cast of binary to string keeps the bytes as they are."""
    text = files.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _rows(b: pa.RecordBatch, columns: int, n: int = 64) -> Iterator[tuple]:
    for at in range(0, b.num_rows, n):
        yield from zip(*[c.to_pylist() for c in b.slice(at, n).columns[:columns]], strict=True)


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that come with their size."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def write_arc(pages: DataFrame, path: str) -> None:
    """Each file starts with its version block; tasks alternate between the two versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files("arc.gz")
        version = 1 + out.task % 2
        for b in batches:
            for page_id, url, html in _rows(b, 3):
                if not out.parts:
                    out.put(version_block(version, out.name))
                out.put(arc_record(version, out.name, page_id, url, html))
                if out.full():
                    yield out.close()
        if out.parts:
            yield out.close()

    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    _write(rows.mapInArrow(run, "value binary"), path)


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """url, date, content type and content of each record after the version block(s)."""
    s, length_at = Stream(data), -1
    while (head := s.line()) is not None:
        line = head.decode("utf-8", "replace")
        if not line:
            continue
        fields = line.split(" ")
        n = int(fields[-1])
        content = s.take(n)
        if len(content) < n:
            raise ValueError(f"record of {n} bytes is cut short: {line[:200]}")
        if fields[0].startswith("filedesc://"):
            version = int(content.split(b" ", 1)[0])
            length_at = len(FIELDS[version].split(" "))
        elif len(fields) != length_at:
            raise ValueError(f"header line has {len(fields)} fields, its version has {length_at}: {line[:200]}")
        else:
            yield fields[0], fields[2], fields[3], content


def _payload(content: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, with its blank line, and its body."""
    cut = content.find(b"\r\n\r\n")
    return (content, b"") if cut < 0 else (content[: cut + 4], content[cut + 4 :])


def _page_id(head: bytes) -> int | None:
    own = _PAGE.search(head)
    return int(own[1]) if own else None


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, url, date, page_id, payload_bytes, payload_digest, http (head) and payload of every record.

    A record's identifier is a name-based one, of its file and its number there. payloads: false leaves the last two null."""
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("http", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for b in batches:
                for where, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    name = where.rsplit("/", 1)[1]
                    for n, (url, date, _, content) in enumerate(parse_arc(blob.as_buffer())):
                        head, body = _payload(content)
                        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{n}").urn
                        kept = (head, body) if payloads else (None, None)
                        yield len(body) if payloads else 0, (f"<{own}>", url, date, _page_id(head), len(body), hashlib.sha1(body).hexdigest(), *kept)

        yield from _batches(rows(), schema)

    return _read(spark, path).mapInArrow(run, "record_id string, url string, date string, page_id long, payload_bytes long, payload_digest string, http binary, payload binary")


def _date(d: str) -> str:
    return re.sub(r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", r"\1-\2-\3T\4:\5:\6Z", d)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    block = b"software: beamlake\r\nformat: WARC File Format 1.1\r\n"
    own = uuid.uuid5(uuid.NAMESPACE_URL, name).urn
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", _date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def warc_record(record_id: str, url: str, date: str, page_id: int | None, n: int, digest: str, http: bytes, payload: bytes, to: dict | None) -> bytes:
    """A response; or, where `to` names another record, a revisit of it without the payload."""
    block = http if to else http + payload
    fields = [
        ("WARC-Type", "revisit" if to else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", _date(date)), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Payload-Length", str(n)),
    ]
    if to:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", to["record_id"]), ("WARC-Refers-To-Target-URI", to["url"]), ("WARC-Refers-To-Date", _date(to["date"])), ("X-Refers-To-Page-Id", str(to["page_id"]))]
    return _record([*fields, ("Content-Type", "application/http; msgtype=response")], block)


def write_warc(spark: SparkSession, arc: str, path: str) -> None:
    """The records of the ARC files under `arc` as WARC files.

    A first pass reads digests only. Responses are chosen by digest with a partial maximum per task, so that a
    payload that a third of the records share is a row per task; only digests that occur twice come back to the
    records, by a broadcast where their bytes allow it, else by a join whose larger side Spark can split.
    """
    seen = read_arc(spark, arc, payloads=False).where(F.col("payload_bytes") >= REVISIT_BYTES)
    to = F.struct("page_id", "record_id", "url", "date")
    same = seen.groupBy(F.col("payload_digest").alias("same_digest")).agg(F.max(to).alias("to"), F.count("*").alias("n"))
    same = stored(same.where("n > 1 and to.page_id is not null").select("same_digest", "to.*").toDF("same_digest", "to_page", "to_record", "to_url", "to_date"), "digests")
    r = read_arc(spark, arc).join(light(same), (F.col("payload_digest") == F.col("same_digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    columns = ["record_id", "url", "date", "page_id", "payload_bytes", "payload_digest", "http", "payload", "to_page", "to_record", "to_url", "to_date"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files("warc.gz")
        for b in batches:
            for *own, page, record, url, date in _rows(b, len(columns)):
                if not out.parts:
                    out.put(warcinfo(out.name))
                revisits = page is not None and own[3] != page
                out.put(warc_record(*own, {"page_id": page, "record_id": record, "url": url, "date": date} if revisits else None))
                if out.full():
                    yield out.close()
        if out.parts:
            yield out.close()

    _write(r.select(*columns).mapInArrow(run, "value binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record, by declared length."""
    s = Stream(data)
    while (line := s.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should start: {line[:80]!r}")
        fields = {}
        while line := s.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = s.take(n)
        if len(block) < n:
            raise ValueError(f"record of {n} bytes is cut short: {fields.get('warc-record-id')}")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, url, date.

    Block digests, and the payload digests of responses, are computed from the bytes read and must agree."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "url", "date"]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for b in batches:
                for blob in b.column(1):
                    for f, block in parse_warc(blob.as_buffer()):
                        if f["warc-type"] not in ("response", "revisit"):
                            continue
                        head, body = _payload(block)
                        stated = f["warc-payload-digest"].removeprefix("sha1:")
                        whole = f["warc-type"] == "response"
                        digest = hashlib.sha1(body).hexdigest() if whole else stated
                        if digest != stated or hashlib.sha1(block).hexdigest() != f["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"digest differs: {f['warc-record-id']}")
                        to = f.get("x-refers-to-page-id")
                        n = len(body) if whole else int(f["x-payload-length"])
                        yield 0, (_page_id(head), n, digest, f["warc-type"], int(to) if to else None, f["warc-record-id"], f.get("warc-refers-to"), f["warc-target-uri"], f["warc-date"])

        yield from _batches(rows(), schema)

    types = {pa.int64(): "long", pa.string(): "string"}
    return _read(spark, path).mapInArrow(run, ", ".join(f"{n} {types[k]}" for n, k in zip(names, kinds, strict=True)))


def convert(pages: DataFrame) -> DataFrame:
    """pages to ARC, ARC to WARC, and the WARC records read back. The archives are deleted once they have been read."""
    spark = pages.sparkSession
    arc, out = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    write_warc(spark, arc, out)
    drop_path(spark, arc)
    back = stored(read_warc(spark, out), "records")
    drop_path(spark, out)
    return back
