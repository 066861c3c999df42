"""Round trips through archives, and ranges that begin anywhere."""

import base64
import hashlib

from pyspark.sql import functions as F

from gazette.llm import warc
from gazette.llm.common import shared_path


def want(rows, least=0):
    by = {}
    for page, _, html in rows:
        by.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p in by[html or ""] if p is not None), default=None)
        again = len(data) >= least and top is not None and (page is None or page < top)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


ROWS = [(i, f"http://h/{i}", f"<p>{'x' * (i % 7)} é</p>") for i in range(60)]
ROWS += [(100, None, None), (101, "http://h/a b\r\nX: y", ""), (102, "u", "long " * 40000), (103, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08"), (103, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08"), (None, "u", "alone"), (None, "u", ROWS[0][2])]


def test_round_trip_any_split(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write(pages, shared_path(spark, "warc"), level=0)
    for split in (97, 1000, 1 << 20):
        got = warc.read(spark, files, split, piece=64)
        assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == want(ROWS)
    bodies = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, files).where("record_type = 'response'").collect()}
    assert bodies[102] == ROWS[62][2] and bodies[101] == ""
    urls = {r.page_id: r.url for r in warc.read(spark, files).collect()}
    assert urls[100] is None and urls[101] == "http://h/a%20b%0D%0AX:%20y"


def test_least_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.revisits(pages, 3).select("page_id", warc.F.when(warc.F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type")).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(pages.limit(0), shared_path(spark, "warc")).collect() == []


def test_no_record():
    assert warc.parsed(b"WARC/1.0\r\nno") is None
    assert warc.parsed(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n") is None


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html")).repartition(3)
    files = warc.write(pages, str(tmp_path))
    found = warc.read(spark, files, split=2000)
    assert found.rdd.getNumPartitions() > 8 and found.count() == 300
