"""Legacy web archives (ARC) to WARC, and back to rows.

Method: an ARC file is a version block and records of one header line and as many bytes as the line
declares; the version says which fields the line has.  The converter reads them by these lengths and
gives each record what its WARC equivalent needs: an id derived from address, date and content, a
timestamp, a type and SHA-1 digests: HTTP messages become responses, what has no HTTP head, as a DNS
answer, a resource of the type that its line declares.  Of records with equal payloads of REVISIT_BYTES or
more, one stays as it is and the others become revisits, which name it and leave the payload out.

Archives are read with Spark's binaryFile source and written by its text writer, which passes bytes on as
they are, so they can be in any store that Spark reaches.  A WARC file holds about ARCHIVE_BYTES of
records, each a gzip member of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import new_path, stage

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32_000_000
ARC_BYTES = 8_000_000
#: Tasks that share the records of one payload.
SALTS = 16
# The fields of a record's header line by the archive's version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
_RECORD = "page_id long, url string, ip string, date string, kind string, type string, record_id string, digest string, payload_bytes long, head binary"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, url string, date string, intact boolean"


# -- ARC -----------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 legacy\n" + " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}[f] for f in ARC_FIELDS[version]) + "\n"
    tail = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n{body}\n".encode()


def arc_record(version: int, url: str, date: str, content: bytes, offset: int, name: str) -> bytes:
    middle = "" if version == 1 else f"200 - - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {middle}{len(content)}\n".encode() + content + b"\n"


def _text(raw: bytes) -> str:
    """Old headers may be of any encoding; what isn't UTF-8 is read byte by byte."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record; a file may be compressed, as a whole or record by record."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at, fields = 0, None
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":  # between records
            at += 1
            continue
        end = raw.index(b"\n", at)
        line = _text(raw[at:end]).rstrip("\r")
        if fields is None:
            # The first record describes the file: its first line of content starts with the version.
            size = int(line.rsplit(" ", 1)[1])
            block = raw[end + 1 : end + 1 + size]
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields, at = ARC_FIELDS[version], end + 1 + size
            continue
        parts = line.rsplit(" ", len(fields) - 1)  # only an address may hold spaces
        header = dict(zip(fields, parts))
        size = int(header["length"])
        if len(parts) != len(fields) or end + 1 + size > len(raw):
            raise ValueError(f"a record at byte {at} doesn't fit its header")
        yield header, raw[end + 1 : end + 1 + size]
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark and head.startswith(b"HTTP/") else (b"", content)


def _head_value(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name + b":"):
            return _text(line.split(b":", 1)[1].strip())
    return None


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Write rows (page_id, url, html as text or bytes) as compressed ARC files of about ARC_BYTES below ``path``, in both versions by turns, as a crawler of old would have left them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, size, records = 0, 0, 0
        for batch in batches:
            chunks, values = [], []
            first = records
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if size > ARC_BYTES:
                    no, size = no + 1, 0
                version, name = 1 + no % 2, f"legacy-{no}.arc"
                if not size:
                    chunks.append(no)
                    values.append(arc_version_block(version, name, date))
                payload = html or b""
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                address = "".join("%20" if c.isspace() else c for c in url or "") or "about:blank"
                chunks.append(no)
                values.append(arc_record(version, address, date, head + payload, size, name))
                size += len(values[-1])
            records = first + len(values)
            # The writer adds the line end that closes a record.
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(range(first, records), pa.int64()), pa.array([v[:-1] for v in values], pa.binary())], names=["chunk", "no", "value"])

    lines = pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary")).mapInArrow(work, "chunk int, no long, value binary")
    _written(lines, path, "\n", "gzip")


def _written(lines: DataFrame, path: str, end: str, compression: str) -> None:
    """The values of (chunk, no, value binary) byte by byte, by no, each with ``end`` behind it, in a file for each chunk of a task.

    The writer wants its rows by chunk; a sort by chunk alone would not keep their order where it spills.
    """
    text = lines.sortWithinPartitions("chunk", "no").select("chunk", F.col("value").cast("string").alias("value"))
    text.write.partitionBy("chunk").option("lineSep", end).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


# -- conversion ----------------------------------------------------------------------------------


def convert(archives: DataFrame, payloads: bool) -> DataFrame:
    """The records of ARC files (path, content binary): _RECORD, and their payload if ``payloads``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORD.split(", ")] + ["payload"] * payloads
        types = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()] + [pa.binary()] * payloads
        for batch in batches:
            for path, raw in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size = [], 0
                for no, (header, content) in enumerate(parse_arc(raw)):
                    head, payload = split_http(content)
                    digest = hashlib.sha1(payload).hexdigest()
                    page_id = _head_value(head, b"x-page-id")
                    key = f"{path} {no} {header['url']} {header['date']} {digest}"
                    when = header["date"].ljust(14, "0")
                    stamp = f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z"
                    kind, content_type = ("response", "application/http; msgtype=response") if head else ("resource", header["type"])
                    row = (int(page_id) if page_id else None, header["url"], header["ip"], stamp, kind, content_type, str(uuid.uuid5(uuid.NAMESPACE_URL, key)), digest, len(payload), head)
                    rows.append((*row, payload) if payloads else row)
                    size += len(payload)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("path", "content").mapInArrow(work, _RECORD + ", payload binary" * payloads)


def originals(records: DataFrame) -> DataFrame:
    """digest, of, of_id: of each payload that several records share, the record with the largest page_id (then record id)."""
    shared = records.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "record_id")).alias("first"))
    return shared.filter("n > 1").select("digest", F.col("first.page_id").alias("of"), F.col("first.record_id").alias("of_id"))


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is 0: the highest of its size.  Beyond 16 MB an empty member follows, so that it is 0 there too."""
    pack = lambda raw: zlib.compress(raw, 1, 31)
    done = pack(record)
    return (done if len(record) < 1 << 24 else done + pack(b""))[:-1]


def _warc_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, no, value): records as gzip members; each chunk of about ARCHIVE_BYTES opens with a warcinfo record."""
    chunk, size, records = 0, None, 0
    for batch in batches:
        chunks, values, first = [], [], records
        for r in batch.to_pylist():
            if size is None or size > ARCHIVE_BYTES:
                chunk, size = (0 if size is None else chunk + 1), 0
                info = "software: tidewell\r\nformat: WARC File Format 1.1\r\n"
                chunks.append(chunk)
                values.append(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, r['record_id'])}>\r\nWARC-Date: {r['date']}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}\r\n\r\n".encode()))
            revisit = r["of_id"] is not None and r["of_id"] != r["record_id"]
            raw = r["head"] + (b"" if revisit else r["payload"])
            lines = [
                "WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['kind']}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}",
                f"WARC-Payload-Digest: sha1:{_base32(r['digest'])}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(raw).hexdigest())}", f"Content-Type: {r['type']}", f"Content-Length: {len(raw)}",
            ]
            if r["ip"] not in ("", "-", "0.0.0.0"):
                lines.append(f"WARC-IP-Address: {r['ip']}")
            if revisit:
                of = "" if r["of"] is None else str(r["of"])
                lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{r['of_id']}>", f"X-Refers-To-Page: {of}", f"X-Payload-Length: {r['payload_bytes']}"]
            chunks.append(chunk)
            values.append(_member("\r\n".join(lines).encode() + b"\r\n\r\n" + raw + b"\r\n\r\n"))
            size += len(values[-1])
        records = first + len(values)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(range(first, records), pa.int64()), pa.array(values, pa.binary())], names=["chunk", "no", "value"])


def write_warc(records: DataFrame, of: DataFrame, path: str) -> None:
    """Write the records (with payloads) as WARC files below ``path``."""
    # Records that can't be revisits have keys of their own, and those of one payload are dealt to SALTS tasks.
    key = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("digest")).otherwise(F.col("record_id"))
    salted = of.select(F.col("digest").alias("_key"), "of", "of_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = records.withColumns({"_key": key, "_salt": F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")}).join(salted, ["_key", "_salt"], "left").drop("_key", "_salt")
    # The last byte of a member is the writer's line end.
    _written(joined.mapInArrow(_warc_members, "chunk int, no long, value binary"), path, "\u0000", "none")


# -- reading -------------------------------------------------------------------------------------


def _members(raw: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, each read in small pieces, as the rest behind a member's end is copied."""
    view, at = memoryview(raw), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(view[at : at + 16_384]))
            at = min(len(view), at + 16_384)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by the declared lengths."""
    if raw[:2] == b"\x1f\x8b":
        for member in _members(raw):
            yield from parse_warc(member)
        return
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        lines = _text(raw[at:end]).split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(archives: DataFrame) -> DataFrame:
    """_READ of the response, resource and revisit records of WARC files (content binary); a response's payload is hashed anew, and intact tells whether its digests hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = []
                for h, block in parse_warc(raw):
                    kind = h["warc-type"]
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = split_http(block) if kind != "resource" else (b"", block)
                    said = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    digest, size = (hashlib.sha1(payload).hexdigest(), len(payload)) if kind != "revisit" else (said, int(h["x-payload-length"]))
                    page_id, of = _head_value(head, b"x-page-id"), h.get("x-refers-to-page")
                    ident = lambda name: h[name].removeprefix("<urn:uuid:").rstrip(">") if name in h else None  # noqa: B023, E731
                    rows.append((int(page_id) if page_id else None, size, digest, kind, int(of) if of else None, ident("warc-record-id"), ident("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest == said))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("content").mapInArrow(work, _READ)


def query(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages (page_id, url, html), read back from the archives.

    A null html counts as empty; a null address as about:blank.  Repeated rows are records of their
    own, of which one at most is the response.  A null page_id is the smallest; revisits of its record
    refer to null.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    arcs, path = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arcs)
    to_warc(spark, arcs, path)
    return read_warc(files(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def to_warc(spark: SparkSession, arcs: str, path: str) -> None:
    """Convert the ARC files below ``arcs`` to WARC files below ``path``."""
    archives = files(spark, arcs)
    write_warc(convert(archives, True), stage(originals(convert(archives, False)), "originals"), path)


SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact FROM w
"""
