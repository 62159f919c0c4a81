"""WARC archives: write captures, read them back, assemble transactions.

Archives are written by Spark's text sink with CR LF CR LF between rows, which is
the end mark of a WARC record, so the commit protocol and any Hadoop file system
serve as they do for tables. They are read as whole files and parsed by
Content-Length; a file holds so few records that its bytes are bounded: RECORDS_PER_FILE
where payloads are small, those of one capture where they are LARGE. Request and metadata records name their response in
WARC-Concurrent-To (or the response names them); the assembly joins them to one
nested row per capture. A revisit record stands for a payload that an earlier
response holds; WARC-Refers-To names it.

Defined results: a null payload is empty; of equal payloads the smallest page_id
(null first) is written as response, other ids as revisits; rows that share id and
payload are captures of the same kind; payloads are written whole, whatever their length
below Spark's 2 GiB a cell; a record without partners makes a capture
with empty lists; an empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.skew import HEAVY, look_up
from sediment.session import scratch_path, staged

CRLF = "\r\n"
#: Fixed values of RFC 4648's base-32 alphabet, beside the digits of base 32 as conv() writes them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes from which a payload gets files of its own capture; below, a file has at most 256 MB.
LARGE = 1 << 18
RECORDS_PER_FILE = 3_000
#: Payloads with copies that may be broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
NO_ID = -(1 << 63)
FIELDS = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, digest_ok boolean, payload_bytes long, head string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as bare upper-case base 32: four times 40 bits make eight digits each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _record(kind: Column, record_id: Column, url: Column, date: str, more: list[Column], content_type: Column, block: Column) -> Column:
    head = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + "WARC-Record-ID: "), record_id, F.lit(CRLF + f"WARC-Date: {date}" + CRLF + "WARC-Target-URI: "), url, F.lit(CRLF)]
    tail = [F.lit("Content-Type: "), content_type, F.lit(CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*head, *more, *tail)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", smallest: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write response or revisit, request and metadata records of every row under ``path``.

    Equal payloads of at least ``smallest`` bytes are written once.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("about:blank")), r"[\x00-\x20]", "%20").alias("url"),
        html.alias("html"), base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n"),
    )
    copies = rows.where(F.col("n") >= smallest).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
    copies = staged(copies, "payload-copies")
    if copies.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(copies.select("digest", "first_id")), "digest", "left")
    else:  # a payload that many pages have meets its first page by broadcast
        heavy = F.broadcast(copies.where(F.col("c") * HEAVY > rows.count()).select("digest", "first_id"))
        met = rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(copies.select("digest", "first_id").hint("merge"), "digest", "left"))
    revisit = F.coalesce(F.col("first_id") < F.col("id"), F.lit(False)) & (F.col("n") >= smallest)

    own = _uuid(F.lit("response"), F.col("id").cast("string"), F.col("digest"))
    origin = _uuid(F.lit("response"), F.col("first_id").cast("string"), F.col("digest"))
    link = F.concat(F.lit("WARC-Concurrent-To: "), own, F.lit(CRLF))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), origin, F.lit(CRLF + f"WARC-Profile: {IDENTICAL}" + CRLF))).otherwise("")
    host, target = F.regexp_extract(F.col("url"), "^[a-zA-Z]+://([^/?#]*)", 1), F.col("url")
    request = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF))
    ident = F.when(F.col("id") == NO_ID, F.lit("")).otherwise(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)))
    metadata = F.concat(ident, F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit(CRLF))
    kind, msg = F.when(revisit, F.lit("revisit")).otherwise("response"), F.lit("application/http; msgtype=")
    records = F.array(
        _record(kind, own, target, date, [digest, refers], F.concat(msg, F.lit("response")), F.when(revisit, http).otherwise(F.concat(http, F.col("html")))),
        _record(F.lit("request"), _uuid(F.lit("request"), F.col("id").cast("string"), F.col("digest"), target), target, date, [link], F.concat(msg, F.lit("request")), request),
        _record(F.lit("metadata"), _uuid(F.lit("metadata"), F.col("id").cast("string"), F.col("digest"), target), target, date, [link], F.lit("application/warc-fields"), metadata),
    )
    for large, most in ((False, RECORDS_PER_FILE), (True, 3)):
        part = met.where((F.col("n") >= LARGE) == large)
        if large and not rows.where(F.col("n") >= LARGE).limit(1).count():
            break
        part.select(F.explode(records).alias("value")).write.mode("append" if large else "errorifexists").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


class _Stream:
    """Bytes of a plain or gzip file (any number of members), read in steps."""

    def __init__(self, content: bytes):
        self.rest, self.buffer, self.at = memoryview(content), bytearray(), 0
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if not len(self.rest):
            return False
        step, self.rest = self.rest[: 1 << 18], self.rest[1 << 18 :]
        if self.at > 1 << 20:
            del self.buffer[: self.at]
            self.at = 0
        if self.zip is None:
            self.buffer += step
            return True
        self.buffer += self.zip.decompress(step)
        while self.zip.eof and (len(self.zip.unused_data) or len(self.rest)):
            left = self.zip.unused_data
            self.zip = zlib.decompressobj(31)
            if not left:
                break
            self.buffer += self.zip.decompress(left)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.buffer.find(mark, self.at)) < 0:
            if not self.more():
                return None
        found = bytes(self.buffer[self.at : end])
        self.at = end + len(mark)
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self.more():
            pass
        found = bytes(self.buffer[self.at : self.at + n])
        self.at += n
        return found


def _header(lines: bytes) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in lines.decode("utf-8", "replace").split(CRLF):
        name, _, value = line.partition(":")
        found.setdefault(name.strip().lower(), []).append(value.strip())
    return found


def parse(content: bytes, with_payload: bool = True) -> Iterator[tuple]:
    """The records of one archive file, as FIELDS."""
    stream = _Stream(content)
    while (head := stream.until((CRLF + CRLF).encode())) is not None:
        if not head.lstrip(b"\r\n").startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        h = _header(head)
        one = lambda name: h.get(name, [None])[0]  # noqa: B023, E731
        block = stream.take(int(one("content-length")))
        stream.take(4)
        kind, digest = one("warc-type"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        start, ok, size, payload = block, None, None, None
        if kind in ("response", "revisit"):
            start, _, body = block.partition((CRLF + CRLF).encode())
            if kind == "response":
                ok, size, payload = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest, len(body), body if with_payload else None
            else:
                size = int(_header(start).get("content-length", ["0"])[0])
        yield one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), h.get("warc-concurrent-to", []), one("warc-refers-to"), digest, ok, size, start.decode("utf-8", "replace"), payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in FIELDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse(content.as_py(), with_payload):
                    rows.append(r)
                    held += len(r[-1] or b"") + 500
                    if held > 1 << 24:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, requests, metadata (lists by record id).

    The lists of one capture are as long as its archive makes them; partners are
    counted once per capture however often their record is repeated.
    """
    replies = records.where(F.col("type").isin("response", "revisit"))
    others = records.where(F.col("type").isin("request", "metadata")).select("record_id", "type", "concurrent_to", F.struct("record_id", "date", "target_uri", "head").alias("r"))
    named = others.select(F.explode("concurrent_to").alias("capture"), "record_id", "type", "r")
    back = replies.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("record_id")).join(others.select("record_id", "type", "r"), "record_id").select("capture", "record_id", "type", "r")
    pairs = named.unionByName(back).groupBy("capture", "record_id").agg(F.first("type").alias("type"), F.first("r").alias("r"))
    lists = pairs.groupBy("capture").agg(*[F.sort_array(F.collect_list(F.when(F.col("type") == t, F.col("r")))).alias(c) for t, c in (("request", "requests"), ("metadata", "metadata"))])
    fields = [c for c in replies.columns if c not in ("record_id", "concurrent_to")]
    captures = replies.select("record_id", F.struct(*fields).alias("response")).join(lists.withColumnRenamed("capture", "record_id"), "record_id", "left")
    none = F.array().cast(lists.schema["requests"].dataType)
    return captures.select("record_id", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def page_report(captures: DataFrame) -> DataFrame:
    """One row per capture written by :func:`write_archives`: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ident = F.regexp_extract(F.coalesce(F.get("metadata", F.lit(0))["head"], F.lit("")), r"(?m)^page-id: (-?\d+)", 1)
    rows = captures.select(
        "record_id", F.when(ident != "", ident.cast("long")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("__to"), F.col("response.digest_ok").alias("digest_ok"),
    )
    rows = staged(rows, "captures")
    origin = staged(rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("__to")).agg(F.min("page_id").alias("refers_to")), "origins")
    named = rows.where("__to is not null")
    met = look_up(named, origin, "__to").unionByName(named.join(origin, "__to", "left_anti").withColumn("refers_to", F.lit(None).cast("long")))
    both = met.unionByName(rows.where("__to is null").withColumn("refers_to", F.lit(None).cast("long")))
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages' archives to the shared folder, read them back and report."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **columns)
    records = staged(read_archives(spark, path, with_payload=False), "warc-records")
    return page_report(assemble(records))
