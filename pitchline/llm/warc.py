"""WARC archives: writing captures and assembling them again.

Writing: each page becomes a transaction of a request, a response (or a revisit) and a
metadata record; the request and the metadata name the response by WARC-Concurrent-To.
Records of equal payloads of ``REVISIT_BYTES`` or more: the one with the largest page id
is the response, the others revisit it. Spark's text writer puts the records out, with
the blank lines that end a record as its separator, so archives go to any store that
Spark writes to, and a lost task leaves nothing behind.

Reading: archives come as binary files and are decoded as a stream, records cut by their
Content-Length. A file is one gzip stream, which readers decode from its beginning: Spark's
writer can't begin a new member for each record. Assembly: records are brought together by the id of their response
(its own, or the one they are concurrent to) and make one nested row per capture; of
several requests or metadata records for a response the one of least record id stands,
with their number. Revisits find the response they refer to by its record id.

Defined cases: a null page counts as an empty payload; null urls are kept as null; a
null page id sorts below all others; of rows with the largest id the one with the
largest url, and of rows that agree in that too exactly one, is the response; empty tables give empty archives and results.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, new_folder, staged, table

REVISIT_BYTES = 1000
PAGES_PER_FILE = 50_000
#: Bytes of payload that a file holds on average; a reader takes a file at once.
FILE_BYTES = 64 << 20
CRLF = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), top AS (
  SELECT payload_digest, max(page_id) AS top_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN p.page_id < t.top_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < t.top_id THEN t.top_id END AS refers_to
FROM p LEFT JOIN top t ON p.payload_digest = t.payload_digest AND p.payload_bytes >= 1000
"""


def _urn(*parts: Column | str) -> Column:
    """A record id from a hash of these."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4), F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, headers: list[Column], content_type: str, block: Column, with_block_end: bool = True) -> Column:
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri]
    length = F.octet_length(block).cast("string")
    return F.concat(*head, *headers, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), length, F.lit(END), block, *([F.lit(END)] if with_block_end else []))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a transaction for each row of ``pages`` (page_id, url, html). Payloads stay
    where they are: the digests that come more than once go to them, by broadcast where
    their number allows it, else by a join in which rows of one digest are spread."""
    html = F.coalesce("html", F.lit(""))
    sizes = pages.select("page_id", "url", F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    # by digest, id and url first: a payload that a third of all pages share is combined early
    same = sizes.groupBy("digest", "page_id", "url").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    total = same.agg(F.sum(F.col("n") * F.col("rows")).alias("bytes"), F.sum("rows").alias("rows"))
    order = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", F.col("url").isNotNull().alias("has_url"), "url")
    tops = same.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct(order.alias("key"), "rows")).alias("top"), F.sum("rows").alias("k")).where("k > 1")
    tops = staged(tops.select("digest", F.col("top.key.page_id").alias("top_id"), F.col("top.key.url").alias("top_url"), F.col("top.rows").alias("ties")), "warc-tops")
    total = total.first()  # two numbers
    per_file = max(1, min(PAGES_PER_FILE, int(FILE_BYTES // max(1, (total["bytes"] or 0) // max(1, total["rows"] or 0)))))

    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha1(html.cast("binary")).alias("digest"))
    rows = joined(rows, tops, ["digest"], "left", F.xxhash64("page_id", "url"))
    at_top = F.col("ties").isNotNull() & F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    # rows' ids are of this evaluation: unique, and nothing refers to them
    own = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    plain = rows.where(~(at_top & (F.col("ties") > 1))).withColumn("revisit", F.col("ties").isNotNull() & ~at_top).withColumn("key", F.when(at_top, "top").otherwise(own))
    out = plain.select("page_id", "url", "html", "n", "digest", "revisit", "key")
    if not tops.where("ties > 1").isEmpty():  # rows alike in id, url and payload: one of them is the response
        alike = rows.where(at_top & (F.col("ties") > 1)).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "html", "n", "ties")))
        alike = alike.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("ties").cast("int"))))
        key = F.when(F.col("k") == 1, "top").otherwise(F.concat(F.lit("copy "), F.col("k").cast("string")))
        out = out.unionByName(alike.select("page_id", "url", "html", "n", "digest", (F.col("k") > 1).alias("revisit"), key.alias("key")))
    out.select(_transaction().alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def _transaction() -> Column:
    """The three records of a row (page_id, url, html, n, digest, revisit, key)."""
    own, nothing = _urn(F.lit("response"), F.col("digest"), F.col("key")), F.lit("")
    page = F.coalesce(F.col("page_id").cast("string"), nothing)
    uri = F.when(F.col("url").isNull(), F.concat(F.lit("urn:page:"), F.url_encode(page))).otherwise(F.regexp_replace("url", r"[\x00-\x20\x7F]", "+"))
    host = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    concurrent = F.concat(F.lit("\r\nWARC-Concurrent-To: "), own)
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.lit("response"), F.col("digest"), F.lit("top")))).otherwise(nothing)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END), F.when(F.col("revisit"), nothing).otherwise(F.col("html")))
    request = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    fields = F.concat(
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("pageId: "), F.url_encode(page), F.lit(CRLF))).otherwise(nothing),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("pageUrl: "), F.url_encode("url"), F.lit(CRLF))).otherwise(nothing),
        F.lit("payloadBytes: "), F.col("n").cast("string"), F.lit(CRLF),
    )
    return F.concat(
        _record("request", _urn(F.lit("request"), F.col("digest"), F.col("key")), uri, [concurrent], "application/http; msgtype=request", request),
        _record(F.when(F.col("revisit"), "revisit").otherwise("response"), own, uri, [digest, refers], "application/http; msgtype=response", http),
        _record("metadata", _urn(F.lit("metadata"), F.col("digest"), F.col("key")), uri, [concurrent], "application/warc-fields", fields, with_block_end=False),
    )


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload_sha1 string, fields map<string,string>"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def _records(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    types = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as f:
                    for h, block in parse(io.BufferedReader(f, 1 << 20)):
                        payload, fields = block, []
                        if h.get("content-type", "").startswith("application/http"):
                            payload = block.partition(END.encode())[2]
                        elif h.get("content-type") == "application/warc-fields":
                            lines = (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)
                            fields = list({k.strip(): v.strip() for k, _, v in lines}.items())
                        declared = h.get("warc-payload-digest")
                        rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), declared and declared.removeprefix("sha1:"), len(payload), hashlib.sha1(payload).hexdigest(), fields) + (payload,) * with_payload)
                        size += len(block)
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """All records of the gzipped archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_records(with_payload), RECORD + ", payload binary" * with_payload)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata,
    n_requests, n_metadata), joined through the concurrent-to identifiers. Records
    that are concurrent to no response are left out."""
    kinds = {"response": F.col("type").isin("response", "revisit"), "request": F.col("type") == "request", "metadata": F.col("type") == "metadata"}
    parts = {
        "response": ["record_id", "type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload_sha1"],
        "request": ["record_id", "target_uri", "payload_bytes"],
        # maps have no order: the least record's fields as entries
        "metadata": ["record_id", "target_uri", "entries"],
    }
    rows = records.withColumn("entries", F.map_entries("fields")).withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    if "payload" in records.columns:
        parts["response"].append("payload")
    out = rows.groupBy("capture_id").agg(
        *(F.min(F.when(kinds[k], F.struct(*names))).alias(k) for k, names in parts.items()),
        F.count_if(kinds["request"]).alias("n_requests"),
        F.count_if(kinds["metadata"]).alias("n_metadata"),
    )
    meta = F.when(F.col("metadata").isNotNull(), F.struct("metadata.record_id", "metadata.target_uri", F.map_from_entries("metadata.entries").alias("fields")))
    return out.where("response IS NOT NULL").withColumn("metadata", meta)


def archive_and_read(pages: DataFrame, page_id_type: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page,
    as read back from the archives."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder)
    rows = captures(read_records(spark, folder)).select(
        "capture_id", F.url_decode(F.col("metadata.fields")["pageId"]).cast(page_id_type).alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("to"), F.col("response.payload_digest").alias("declared"), F.col("response.payload_sha1").alias("own"),
        F.when(F.col("response.type") == "revisit", F.col("metadata.fields")["payloadBytes"].cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
    )
    rows = staged(rows, "warc-captures")  # the archives are read once
    wanted = rows.where("record_type = 'revisit'").select(F.col("to").alias("capture_id")).distinct()  # one for each payload that is revisited
    targets = rows.where("record_type = 'response'").join(wanted, "capture_id", "left_semi").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    # a response refers to nothing: a key of its own, or all of them would meet in one task
    rows = rows.withColumn("to", F.coalesce("to", F.concat(F.lit("-"), F.col("capture_id"))))
    digest = F.when(F.col("record_type") == "revisit", F.col("declared")).otherwise(F.col("own"))
    out = joined(rows, staged(targets, "warc-targets"), ["to"], "left", F.xxhash64("capture_id"))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def page_url(capture_url: str | None) -> str | None:
    """The url as it was, from a capture's ``pageUrl`` field."""
    return None if capture_url is None else unquote(capture_url.replace("+", " "))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return archive_and_read(pages.select("page_id", "url", "html"), pages.schema["page_id"].dataType.simpleString())
