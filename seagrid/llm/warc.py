"""WARC archives: writing, reading and transaction assembly (operator 3).

Writing uses Spark's text writer with the record separator as line separator, so
archives appear through the commit protocol of any file system Spark can write.
Each page becomes a request, a response (or revisit) and a metadata record, the
first and last of which name the response in WARC-Concurrent-To. Of pages with
equal payloads of ``min_revisit_bytes`` or more, the one with the largest id is
the response and the others become revisit records without a payload.

Reading takes files of up to 2 GB, plain or gzip (one or many members), and
follows Content-Length, so payloads may hold any bytes, record separators too.
Assembly joins the three kinds of records on their concurrent-to identifiers and
emits one nested row per capture.

Edge cases: a null payload is written as an empty one, a null URL without target
URI, a null id without page_id field (read back as null; such a page is never the
response of a group that has an id). CR and LF in a URL are percent-encoded. Record
identifiers derive from page id and payload, so that a rerun task writes the same.
Pages that repeat the largest id of a group of equal payloads are all responses;
a repeated page is a capture of its own. Of several requests (or metadata records)
of one capture the one with the smallest record id is shown, with their number.
Requests and metadata whose response is missing form captures without response.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import scratch_path, slices, table

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: A file holds about so many payload bytes; readers take a file at a time.
FILE_BYTES = 32 << 20
#: Up to so many groups of equal payloads (under 100 bytes each) are broadcast.
BROADCAST_GROUPS = 100_000
RECORD_SCHEMA = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, content_type string, http_header string, payload binary"


def _uuid(*parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column]], content_type: str | Column, block: Column) -> Column:
    """A record without the two line ends after its block; headers that are null are left out."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), lit(kind)), *(F.concat(F.lit(f"{name}: "), value) for name, value in headers), F.concat(F.lit("Content-Type: "), lit(content_type)), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8", compression: str = "gzip") -> None:
    """Write ``pages`` to WARC files under ``path``; the payload may be a string or binary."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("ord"), F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload"), "same": F.sha2("payload", 256)})
    large = F.col("bytes") >= min_revisit_bytes
    groups = rows.filter(large).groupBy("same", "bytes").agg(F.max("ord").alias("first"), F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    groups = groups.filter("n > 1").select(F.col("same").alias("key"), "first")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    # A payload that can have no group gets a key of its own, else all of these would meet in one task.
    rows = rows.withColumn("key", F.when(large, F.col("same")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    joined = rows.join(F.broadcast(groups) if few else groups, "key", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("ord").isNull() | (F.col("ord") != F.col("first"))), F.lit(False))
    sha1 = F.concat(F.lit("sha1:"), F.sha1("payload"))
    capture_id = lambda i: _uuid(F.lit("capture"), F.coalesce(i, F.lit("")), F.col("same"))
    own, blank = capture_id(F.col("id")), F.lit(None).cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("payload").cast("string")))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        [("WARC-Record-ID", F.col("own")), *common, ("WARC-Payload-Digest", F.col("sha1")), ("WARC-Profile", F.when(F.col("revisit"), F.lit(REVISIT_PROFILE)).otherwise(blank)), ("WARC-Refers-To", F.when(F.col("revisit"), capture_id(F.col("first").cast("string"))).otherwise(blank))],
        "application/http; msgtype=response",
        block,
    )
    request = _record("request", [("WARC-Record-ID", _uuid(F.lit("request"), F.col("own"))), *common, ("WARC-Concurrent-To", F.col("own"))], "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce("url", F.lit("*")), F.lit(f" HTTP/1.1{CRLF * 2}")))
    fields = F.concat_ws(CRLF, F.concat(F.lit("page_id: "), F.col("id")), F.when(F.col("revisit"), F.concat(F.lit("refers_to: "), F.col("first").cast("string"))), F.lit(""))
    metadata = _record("metadata", [("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("own"))), *common, ("WARC-Concurrent-To", F.col("own"))], "application/warc-fields", fields)
    ready = joined.withColumns({"revisit": revisit, "own": own, "sha1": sha1})
    records = ready.select(F.concat_ws(CRLF * 2, request, response, metadata).alias("value"))
    per_file = max(1, FILE_BYTES // max(1, (total["b"] or 0) // max(1, total["n"])))
    records.write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def _unzipped(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    parts, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(rest) + member.flush())
        rest = member.unused_data
    return b"".join(parts)


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive file."""
    data = _unzipped(content)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}: {first[:40]!r}")
        head = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut off")
        at = end + 4 + size
        http = None
        if head.get("content-type", "").startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
            http, block = block[:cut].decode("utf-8", "replace"), block[cut + 4 :]
        yield {
            "record_type": head.get("warc-type"),
            "record_id": head.get("warc-record-id"),
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "payload_digest": head.get("warc-payload-digest"),
            "content_type": head.get("content-type"),
            "http_header": http,
            "payload": block,
        }


_RECORD_ARROW = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.string()) for c in RECORD_SCHEMA.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, held = [], 0
            for record in parse_records(batch.column(0)[0].as_py()):
                rows.append(record)
                held += len(record["payload"])
                if held > 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD_SCHEMA)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, n_requests, metadata, n_metadata."""

    def side(kind: str, extra: list[str]) -> DataFrame:
        rows = records.filter(F.col("record_type") == kind).select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), F.struct("record_id", *extra).alias(kind))
        return rows.groupBy("capture_id").agg(F.min(kind).alias(kind), F.count("*").alias("n_requests" if kind == "request" else "n_metadata"))

    responses = records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct("record_type", "refers_to", "target_uri", "date", "payload_digest", "http_header", "payload").alias("response")
    )
    sides = side("request", ["http_header", "payload"]).join(side("metadata", ["payload"]), "capture_id", "full")
    both = responses.join(sides, "capture_id", "full")
    return both.select("capture_id", "response", "request", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), "metadata", F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def warc_field(block: Column, name: str) -> Column:
    """The value of a field of an application/warc-fields block, or null."""
    found = F.regexp_extract(block.cast("string"), f"(?m)^{name}: (.*?)\r?$", 1)
    return F.when(found != "", found)


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = assemble_transactions(read_warc(spark, path))
    response, revisit = F.col("response"), F.col("response.record_type") == "revisit"
    told = F.regexp_extract(response["http_header"], "Content-Length: (\\d+)", 1).try_cast("long")
    return captures.select(
        warc_field(F.col("metadata.payload"), "page_id").try_cast("long").alias("page_id"),
        F.when(revisit, told).otherwise(F.octet_length(response["payload"]).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(response["payload_digest"], "^sha1:", "")).otherwise(F.sha1(response["payload"])).alias("payload_digest"),
        response["record_type"].alias("record_type"),
        warc_field(F.col("metadata.payload"), "refers_to").try_cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS same FROM p
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY same, payload_bytes) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM g
"""
