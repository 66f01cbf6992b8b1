"""Operator 3: round trips and SQL."""

import gzip
import hashlib

import duckdb
import pytest

from seagrid.llm.common import scratch_path
from seagrid.llm.warc import OP3_SQL, assemble_transactions, op3_warc_transactions, parse_records, read_warc, warc_field, write_warc


def test_op3_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = con.execute(OP3_SQL).fetchall()
    got = op3_warc_transactions(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    big, other = "é" * 600, "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n" * 40
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "small"), (7, "http://a/7", "small"), (8, "u", other), (9, "u", other), (9, "u", other), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "warc-test")
    write_warc(pages, path, compression=compression)
    records = read_warc(spark, path)
    assert records.count() == 3 * len(rows)
    captures = assemble_transactions(records)
    assert captures.count() == len(rows)
    from pyspark.sql import functions as F

    got = captures.select(warc_field(F.col("metadata.payload"), "page_id").alias("id"), warc_field(F.col("metadata.payload"), "refers_to").alias("to"), "response", "request", "n_requests").collect()
    seen = sorted((r.id or "", r.response.record_type, r.to, bytes(r.response.payload)) for r in got)
    expect = [("", "revisit", "3", b""), ("1", "revisit", "3", b""), ("2", "revisit", "3", b""), ("3", "response", None, big.encode()), ("4", "response", None, b""), ("5", "response", None, b""), ("6", "response", None, b"small"), ("7", "response", None, b"small"), ("8", "revisit", "9", b""), ("9", "response", None, other.encode()), ("9", "response", None, other.encode())]
    assert [tuple(map(str, x)) for x in seen] == [tuple(map(str, x)) for x in sorted(expect, key=lambda x: x[0])]
    assert all(r.request is not None and r.n_requests >= 1 for r in got)
    assert all(r.response.payload_digest == "sha1:" + hashlib.sha1(bytes(r.response.payload)).hexdigest() for r in got if r.response.record_type == "response")
    first = {r.id: r.response for r in got}
    assert first["2"].target_uri == "http://a/2%0D%0AX: y" and first["3"].target_uri is None
    three = records.filter("record_type = 'response'").filter(F.octet_length("payload") == len(big.encode())).first()
    assert first["1"].refers_to == three.record_id


def test_binary_payload(spark):
    rows = [(1, "u", bytearray(b"\xff\x00\r\n\r\n" * 400))]
    path = scratch_path(spark, "warc-test")
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html binary"), path)
    got = read_warc(spark, path).filter("record_type = 'response'").first()
    assert bytes(got.payload) == bytes(rows[0][2])


def test_member_per_record_and_errors():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["payload"] for r in parse_records(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(parse_records(b"HTTP/1.1 200\r\n\r\n"))
    with pytest.raises(ValueError):
        list(parse_records(record[:-6]))


def test_orphans_and_empty(spark):
    from seagrid.llm.warc import RECORD_SCHEMA

    orphan = [("request", "<r>", "<gone>", None, "u", "d", None, "t", "GET", bytearray(b""))]
    got = assemble_transactions(spark.createDataFrame(orphan, RECORD_SCHEMA)).collect()
    assert len(got) == 1 and got[0].capture_id == "<gone>" and got[0].response is None and got[0].n_requests == 1
    path = scratch_path(spark, "warc-test")
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert assemble_transactions(read_warc(spark, path)).collect() == []
