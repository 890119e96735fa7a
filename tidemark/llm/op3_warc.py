"""ARC archives to WARC: records by version-specific header lines and declared lengths, equal payloads as revisits."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Compressed bytes of one WARC file, by which a reader's memory is bounded; a single longer record makes a longer file.
FILE_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the format: fields of a URL record's header line by version.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_CRLF = b"\r\n"
RECORD = "kind string, page_id long, url string, ip string, date string, head binary, payload binary"
#: A gzip member of no bytes, which ends a file: the text writer puts something after each row.
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


# ---------------------------------------------------------------- ARC


def arc_segment(version: str, records: list[tuple[str, str, str, bytes]], name: str = "segment.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, network document) records, its version block first."""
    about = f"{version} 0 tidemark\n{FIELDS[version]}\n".encode()

    def line(url: str, ip: str, date: str, kind: str, length: int) -> bytes:
        middle = "" if version == "1" else f" 200 - - 0 {name}"
        return f"{url} {ip} {date} {kind}{middle} {length}\n".encode()

    parts = [line(f"filedesc://{name}", "0.0.0.0", "20050101000000", "text/plain", len(about)), about, b"\n"]
    for url, ip, date, body in records:
        parts += [line(url, ip, date, "text/html", len(body)), body, b"\n"]
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[dict[str, object]]:
    """The URL records of an ARC file: header fields by name as its version block lists them, and `body`.

    The version block itself is a record too. One without a list of fields has its version's. Blank lines between records are skipped; a header
    line with another count of fields, or a length that the file doesn't hold, ends the reading with ValueError.
    """
    at, fields, size = 0, None, len(data)
    while at < size:
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line doesn't end")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            length = int(values[-1])
        except ValueError:
            raise ValueError(f"no length in the ARC header line {values}") from None
        body = data[end + 1 : end + 1 + length]
        if len(body) < length or length < 0:
            raise ValueError("an ARC record is shorter than declared")
        at = end + 1 + length
        if values[0].startswith("filedesc://"):
            lines = body.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else "1"
            fields = (lines[1] if len(lines) > 1 and lines[1] else FIELDS.get(version, FIELDS["1"])).split(" ")
            yield {"URL": values[0], "IP-address": values[1], "Archive-date": values[2], "body": body}
            continue
        if fields is None or len(values) != len(fields):
            raise ValueError(f"an ARC header line of {len(values)} fields")
        yield dict(zip(fields, values, strict=True)) | {"body": body}


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    cut = body.find(b"\r\n\r\n")
    return (b"", body) if cut < 0 or not body.startswith(b"HTTP/") else (body[: cut + 4], body[cut + 4 :])


def _rows(records: Iterator[dict[str, object]]) -> list[tuple]:
    """RECORD rows: a version block is a warcinfo, a dns: answer a resource, all else a response. Bytes stay as they are."""
    out = []
    for r in records:
        url = r["URL"]
        kind = "warcinfo" if url.startswith("filedesc://") else "resource" if url.startswith("dns:") else "response"
        head, payload = _split_http(r["body"]) if kind == "response" else (b"", r["body"])
        page = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
        out.append((kind, int(page[1]) if page else None, url, r["IP-address"], r["Archive-date"], head, payload))
    return out


def _batch(rows: list[tuple], kinds: tuple[pa.DataType, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)


_RECORD_TYPES = (pa.string(), pa.int64(), *[pa.string()] * 3, *[pa.binary()] * 2)
_RECORD_NAMES = ["kind", "page_id", "url", "ip", "date", "head", "payload"]


def _through_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as ARC segments of both versions, read again."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            by: dict[str, list] = {"1": [], "2": []}
            for page, url, date, html in zip(*(part[c].to_pylist() for c in ("page_id", "url", "date", "html")), strict=True):
                payload = (html or "").encode()
                own = f"X-Page-Id: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"
                by["1" if (page or 0) % 2 == 0 else "2"].append((url, "0.0.0.0", date, head.encode() + payload))
            for version, records in by.items():
                if records:
                    yield _batch(_rows(parse_arc(arc_segment(version, records))), _RECORD_TYPES, _RECORD_NAMES)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files (.arc or .arc.gz) as RECORD rows, version blocks and dns answers among them; page_id is null
    unless a record's HTTP head has it. A file is one task, so it should be of the usual size of some hundred MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                yield _batch(_rows(parse_arc(_plain(content.as_py()))), _RECORD_TYPES, _RECORD_NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


# ---------------------------------------------------------------- WARC


def _plain(data: bytes) -> bytes:
    """The bytes, uncompressed if they are gzip members."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        parts.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(parts) if parts else data


def _record_id(page: Column, url: Column, date: Column, digest: Column) -> Column:
    """A UUID of version 8 that holds the page's number and a part of the digest; of a record without a number one of version 5, from its URL, date and digest."""
    cut = lambda c, i, n: F.substring(c, i, n)
    p, d = F.lpad(F.lower(F.hex(page)), 16, "0"), digest
    numbered = F.concat(cut(p, 1, 8), F.lit("-"), cut(p, 9, 4), F.lit("-8"), cut(p, 13, 3), F.lit("-8"), cut(p, 16, 1), cut(d, 1, 2), F.lit("-"), cut(d, 3, 12))
    n = F.sha2(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.coalesce(date, F.lit("")), d), 256)
    other = F.concat(cut(n, 1, 8), F.lit("-"), cut(n, 9, 4), F.lit("-5"), cut(n, 13, 3), F.lit("-8"), cut(n, 16, 3), F.lit("-"), cut(n, 19, 12))
    return F.concat(F.lit("<urn:uuid:"), F.when(page.isNotNull(), numbered).otherwise(other), F.lit(">"))


def warc_records(records: DataFrame) -> DataFrame:
    """Columns `head` and `block`, the bytes of one WARC record for each row of RECORD.

    Of responses with one payload digest and REVISIT_BYTES or more, those of the smallest page_id are responses, the others
    revisits that refer to it. Records of archives have no page_id: they come after all that have one, by date and URL, and are told by these. Equal rows
    are one record to WARC and share its identifier. The digest's group is a minimum, summed before it is shuffled; the join back is one
    that Spark splits where many rows share a payload.
    """
    named = records.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    named = named.withColumn("own", F.struct(F.col("page_id").isNull().alias("unnumbered"), "page_id", F.when(F.col("page_id").isNull(), F.col("date")).alias("date"), F.when(F.col("page_id").isNull(), F.col("url")).alias("url")))
    firsts = named.where((F.col("kind") == "response") & (F.col("size") >= REVISIT_BYTES)).groupBy("digest").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    known = named.join(firsts.where("n > 1").select("digest", "first"), "digest", "left")
    again = F.coalesce((F.col("kind") == "response") & F.col("first").isNotNull() & ~F.col("own").eqNullSafe(F.col("first")), F.lit(False))
    known = known.withColumns({"again": again, "id": _record_id(F.col("page_id"), F.col("url"), F.col("date"), F.col("digest"))})
    block = F.when(F.col("again"), F.col("head")).otherwise(F.concat("head", "payload"))
    when = F.concat(*(F.substring("date", i, n) if isinstance(i, int) else F.lit(i) for i, n in ((1, 4), ("-", 0), (5, 2), ("-", 0), (7, 2), ("T", 0), (9, 2), (":", 0), (11, 2), (":", 0), (13, 2), ("Z", 0))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    info, web = F.col("kind") == "warcinfo", F.octet_length("head") > 0
    kind = F.when(info, "text/plain").when(F.col("kind") == "resource", "text/dns").when(web, "application/http; msgtype=response").otherwise("application/octet-stream")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise(F.col("kind"))), line("WARC-Record-ID", F.col("id")), line("WARC-Date", when),
        F.when(info, line("WARC-Filename", F.substring_index("url", "/", -1))).otherwise(F.concat(line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("X-Payload-Bytes", F.col("size").cast("string")),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first.page_id"), F.col("first.url"), F.col("first.date"), F.col("digest"))))).otherwise(""),
        line("Content-Type", kind), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    return known.withColumn("block", block).select(head.alias("head"), "block")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC files of about FILE_BYTES, a row each: records as gzip members of their own."""
    parts, size = [], 0
    for batch in batches:
        for head, block in zip(batch["head"], batch["block"], strict=True):
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            parts += [squeeze.compress(head.as_py().encode()), squeeze.compress(block.as_py()), squeeze.compress(_CRLF * 2), squeeze.flush()]
            size += sum(map(len, parts[-4:]))
            if size >= FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["file"])
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["file"])


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of about FILE_BYTES, each record a gzip member, in a folder that all executors share.

    A row is a file. Spark's text writer puts its bytes as they are, and an empty gzip member in place of a line's end.
    """
    files = warc_records(records).mapInArrow(_files, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record; lengths as declared."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == _CRLF:
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(head["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError("a WARC record is shorter than declared")
        at = end + 4 + length
        yield head, block


def _page_of(record_id: str) -> int | None:
    x = record_id.removeprefix("<urn:uuid:").rstrip(">").replace("-", "")
    if x[12:13] != "8":
        return None
    n = int(x[:12] + x[13:16] + x[17:18], 16)
    return n - (1 << 64) if n >> 63 else n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for content in batch["content"]:
            out = []
            for head, block in parse_warc(_plain(content.as_py())):
                payload = _split_http(block)[1]
                size, digest, refers = int(head["x-payload-bytes"]), head["warc-payload-digest"].removeprefix("sha256:"), None
                if head["warc-type"] == "revisit":
                    refers = _page_of(head["warc-refers-to"])
                elif len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its length and digest")
                out.append((_page_of(head["warc-record-id"]), size, digest, head["warc-type"], refers))
            yield _batch(out, kinds, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records in WARC files that write_warc() made.
    Payloads are digested again and must match; of a revisit, which has none, size and digest are as stated."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as ARC records, converted and written as WARC files, and read back.

    A null html is an empty payload, a null url `unknown:`; white space in a url is percent-coded. A row without
    page_id is a record too, never what others refer to if one with an id has its payload; of several alike without any, the first by URL is the response. Repeated rows are records
    each; those that share the smallest id are all responses. The segments' version blocks become warcinfo records, which aren't returned. An empty table gives no rows; other columns aren't read.
    """
    spark = pages.sparkSession
    date = F.date_format(F.timestamp_seconds(F.lit(1104537600) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    source = pages.select(F.col("page_id").cast("long"), "url", date.alias("date"), "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(source.mapInArrow(_through_arc, RECORD), path)
    return read_warc(spark, path).where("record_type in ('response', 'revisit')")


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
