"""Legacy archive conversion: ARC files to WARC, with equivalent identifiers, timestamps, types and digests.

An ARC file begins with a version block that declares the names of the fields of its records' header lines: version 1
has ``URL IP-address Archive-date Content-type Archive-length``, version 2 more of them. A record is its header line,
as many bytes as its last field declares, and a line feed. The converter parses each record by its own file's version,
takes the payload from behind the HTTP head if there is one, and synthesises a WARC record of the same URL, address and
time: an id that follows from its content (a name-based UUID), a SHA-1 payload digest in base32, a type.

``op7_warc`` writes the pages as ARC files, converts them, and writes and reads back the WARC files. Of the records with equal
payloads that of the smallest page_id is a response and the others revisit it, without a payload of their own. WARC
files come from Spark's own text writer, gzip-compressed: a record ends with two line ends, which is the separator. A file
holds up to ``FILE_RECORDS`` records and closes behind ``FILE_BYTES`` of them, so that a reader's memory is bounded by that and the longest record.

Defined cases: null html is empty; payloads below ``LEAST_BYTES`` are never revisited; a null or odd URL is written
percent-encoded, or as ``about:blank``; rows of equal page_id and payload that share the smallest id are all responses; a null
page_id is never the response that others refer to unless all are null; an empty table gives no files; a payload of any
length is one record, whole, in a file by itself if it is longer than one; columns other than
page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.llm import common

LEAST_BYTES = 0
#: Records of a file, and bytes of them behind which it closes.
FILE_RECORDS, FILE_BYTES = 2000, 16 << 20
#: Revisits up to which they are broadcast: a digest and two ids each.
BROADCAST_ROWS = 250_000
#: A digest that at least one row in so many has is joined by broadcast: there are no more of those than that.
HOT_SHARE = 1000

#: Fixed values of the two archive formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.0"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_ARC_DATE = re.compile(r"[0-9]{14}").fullmatch
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ENDS = b"\r\n\r\n"
#: The pages have no date and address of their own.
_DATE, _ADDRESS = "20000101000000", "0.0.0.0"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC file of (url, content) records."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 pages\n{fields}\n\n".encode()
    first = f"filedesc://pages.arc {_ADDRESS} {_DATE} text/plain"
    out = [f"{first} {'200 - - 0 pages.arc ' if version == 2 else ''}{len(body)}\n".encode(), body]
    for url, content in records:
        more = f"200 {hashlib.md5(content).hexdigest()} - 0 pages.arc " if version == 2 else ""
        out += [f"\n{url} {_ADDRESS} {_DATE} text/html {more}{len(content)}\n".encode(), content]
    return b"".join(out) + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields, by their declared names, and the content of each record behind the version block."""
    line, _, _ = data.partition(b"\n")
    size = int(line.rsplit(b" ", 1)[1])
    block = data[len(line) + 1 : len(line) + 1 + size].decode()
    version, names = int(block.split(" ", 1)[0]), block.split("\n")[1].split(" ")
    if names != ARC_FIELDS.get(version, "").split(" "):
        raise ValueError(f"version {version} declares other fields: {names}")
    at = len(line) + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        # a URL may hold spaces in old files; the other fields may not
        values = data[at:end].decode().rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit() or not _ARC_DATE(values[2]):
            raise ValueError(f"not a record header of version {version}: {data[at:end]!r}")
        size = int(values[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError("a record that ends before its declared length")
        yield dict(zip(names, values, strict=True)), content
        at = end + 1 + size


def payload_of(content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head, with its empty line, and the payload. Content without a head is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, mark, payload = content.partition(_ENDS)
    return head + mark, payload


def _warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def warc_record(fields: dict[str, str], content: bytes, page_id: int | None = None, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it; with ``refers_to`` a revisit of that page."""
    head, payload = payload_of(content)
    digest = payload_digest(payload)
    block = head if refers_to is not None else content
    name = f"{fields['URL']} {fields['Archive-date']} {page_id} {digest}"
    lines = [
        WARC_VERSION,
        b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response" if head else b"resource"),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, name)).encode(),
        b"WARC-Date: " + _warc_date(fields["Archive-date"]).encode(),
        b"WARC-Target-URI: " + fields["URL"].encode(),
        b"WARC-IP-Address: " + fields["IP-address"].encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: " + (b"application/http; msgtype=response" if head else fields["Content-type"].encode()),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if page_id is not None:
        lines.append(b"X-Page-ID: %d" % page_id)
    if refers_to is not None:
        lines += [b"WARC-Profile: " + REVISIT_PROFILE, b"X-Refers-To-Page: %d" % refers_to]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block])


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, by lower-case name, and the block of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(_ENDS, at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version.encode() != WARC_VERSION:
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        at = end + len(_ENDS)
        size = int(fields["content-length"])
        block = data[at : at + size]
        at += size
        if len(block) != size or data[at : at + len(_ENDS)] != _ENDS:
            raise ValueError("a record that ends elsewhere than it says")
        at += len(_ENDS)
        yield fields, block


def _url(url: str | None) -> str:
    return quote(url, safe="!#$&'()*+,/:;=?@[]~%-._") if url else "about:blank"


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, of which half go through each version of ARC, to runs of WARC records, a file each."""
    held, size = [], 0
    for batch in common.by_text_bytes(batches, "html"):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True))
        out = []
        for version in ARC_FIELDS:
            own = [r for r in rows if (r[0] or 0) % 2 + 1 == version]
            data = arc_file(version, [(_url(url), _HEAD + (html or "").encode()) for _, url, html, _ in own])
            out += [warc_record(fields, content, page_id, to) for (page_id, _, _, to), (fields, content) in zip(own, arc_records(data), strict=True)]
        for record in out:
            held.append(record)
            size += len(record)
            if len(held) >= FILE_RECORDS or size >= FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([_ENDS.join(held)], pa.binary())], ["records"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_ENDS.join(held)], pa.binary())], ["records"])


def revisits(pages: DataFrame) -> DataFrame:
    """digest, _page and refers_to of the distinct (payload, page_id) that repeat a payload of a smaller page_id; no payloads."""
    keys = common.written(
        pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_BYTES).select(F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.col("page_id").alias("_page")), "digests"
    )
    groups = common.written(keys.groupBy("digest").agg(F.min("_page").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "copies")
    hot = F.col("n") * HOT_SHARE >= F.lit(keys.count())
    # of hot digests there are HOT_SHARE at most, so that their rows need not meet in one task
    few = F.broadcast(groups.where(hot).select("digest", "refers_to"))
    marked = keys.join(few, "digest", "left")
    rest = marked.where("refers_to is null").select("digest", "_page").join(groups.where(~hot).select("digest", "refers_to"), "digest")
    return marked.where("refers_to is not null").select("digest", "_page", "refers_to").union(rest.select("digest", "_page", "refers_to")).where("_page <> refers_to").distinct()


def _told(keyed: DataFrame, again: DataFrame, few: bool) -> DataFrame:
    """page_id, url, html and refers_to of pages (with their digest) by ``revisits``. These go to the pages where they are few; else only pages whose digest is that of some revisit, and hardly any others, are shuffled
    with their payloads, and the rest stays where it is."""
    columns = ("page_id", "url", "html", "refers_to")
    to = again.withColumnRenamed("digest", "_digest")
    met = (F.col("digest") == F.col("_digest")) & (F.col("page_id") == F.col("_page"))
    if few:
        return keyed.join(F.broadcast(to), met, "left").select(*columns)
    maybe = common.flagged(keyed, "digest", again, "digest", "maybe")
    return maybe.where("maybe").join(to, met, "left").select(*columns).union(maybe.where("not maybe").withColumn("refers_to", F.lit(None).cast("long")).select(*columns))


def write(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files, by way of ARC records."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    again = common.written(revisits(pages), "revisits")
    keyed = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    records = _told(keyed, again, again.count() <= BROADCAST_ROWS).mapInArrow(_converted, "records binary")
    records.select(F.col("records").cast("string")).write.option("lineSep", _ENDS.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of the files under ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in warc_records(zlib.decompress(content.as_py(), 31)):
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), number("x-payload-length")
                    if fields["warc-type"] != "revisit":
                        payload = payload_of(block)[1] if fields["warc-type"] == "response" else block
                        size = len(payload)
                        if payload_digest(payload) != digest:
                            raise ValueError("a payload that does not have its digest")
                    rows.append((number("x-page-id"), size, digest, "revisit" if fields["warc-type"] == "revisit" else "response", number("x-refers-to-page")))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path)
