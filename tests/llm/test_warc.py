import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from evalloom.llm import warc
from evalloom.session import run_dir


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset int")


def rows():
    copy, other = "<p>" + "x" * 200, "é" * 50
    return [
        (5, "http://a/1", copy), (2, "http://a/2", copy), (9, None, copy), (2, "http://a/2", copy), (None, "http://a/n", copy),
        (7, "http://a/short", "x" * 99), (8, "http://a/short2", "x" * 99), (10, "http://b/é?q=ü\r\nX: 1", other), (11, "http://b", other),
        (12, "http://c", ""), (13, "http://d", None), (14, "http://e", "\r\n\r\nWARC/1.1\r\n" + "z" * 100),
        (15, "http://f", "long " * 100_000), (16, "http://g", "\u0000\u0001 " * 60),
    ]


def expected(data):
    out = []
    for page, _, html in data:
        payload = (html or "").encode()
        same = [p for p, _, h in data if (h or "").encode() == payload and p is not None]
        first = min(same, default=None)
        later = len(payload) >= 100 and first is not None and (page is None or page > first)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response", first if later else None))
    return sorted(out, key=repr)


def test_round_trip_of_odd_pages(spark):
    data = rows()
    table = pages(spark, [(*r, "clash", 1) for r in data])
    found = warc.archive_pages(table, payloads=True)
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[c] for c in kept) for r in found.collect()), key=repr) == expected(data)
    bodies = {r.page_id: r.payload for r in found.where("record_type = 'response'").collect()}
    assert all(bytes(bodies[p]) == (h or "").encode() for p, _, h in data if p in bodies)
    urls = {r.page_id: r.url for r in found.collect()}
    assert urls[9] is None and urls[5] == "http://a/1" and "\n" not in urls[10]
    assert warc.archive_pages(table.limit(0)).collect() == []


def test_ranges_and_files(spark):
    """Small files, small reads and gaps give the same records; a selection reads only what it names."""
    data = [(i, f"http://h/{i}", f"<html>{i}" + "text " * (i % 40)) for i in range(300)]
    folder = warc.qualified(spark, run_dir(spark, "warc"))
    assert folder.startswith("file:///")
    typed = warc.with_record_types(pages(spark, [(*r, None, None) for r in data]))
    index = warc.write_archives(typed, folder, file_bytes=2000)
    assert index.select("file").distinct().count() > 5
    whole = sorted(map(tuple, warc.read_records(index, folder).collect()))
    assert len(whole) == 300
    for read_bytes, read_gap in ((500, 0), (3000, 100), (1 << 20, 1 << 20)):
        assert whole == sorted(map(tuple, warc.read_records(index, folder, read_bytes=read_bytes, read_gap=read_gap).collect()))
    some = warc.read_records(index, folder, F.col("url").endswith("7"), read_gap=10)
    assert sorted(r.page_id for r in some.collect()) == list(range(7, 300, 10))


def test_record_is_a_gzip_member_of_its_own():
    member = warc.record_bytes(3, "http://x/y", b"body", 4, hashlib.sha256(b"body").hexdigest(), "response", None)
    text = gzip.decompress(member)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"body\r\n\r\n")
    fields, payload = warc.parse_record(member)
    assert payload == b"body" and fields["X-Page-ID"] == "3"


def test_swapped_index_rows_are_found(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(4)], "page_id long, url string, html string")
    folder = warc.qualified(spark, warc.run_dir(spark, "warc"))
    index = warc.write_archives(warc.with_record_types(pages), folder)
    assert warc.read_records(index, folder).count() == 4
    for name in ("page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"):
        value = F.lit("other") if dict(index.dtypes)[name] == "string" else F.lit(77).cast("long")
        wrong = index.withColumn(name, F.when(F.col("page_id") == 2, value).otherwise(F.col(name)))
        with pytest.raises(Exception, match="not the one of the index"):
            warc.read_records(wrong, folder).collect()
