import hashlib

from anamnesis.llm import warc
from anamnesis.llm.common import shared_dir

SCHEMA = "page_id bigint, url string, html string, digest string"


def pages(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "x" * 1200
    rows = [(i, f"http://a/{i}", fake * i + "é" * i, "clash") for i in range(60)]
    rows += [(100 + i, None, long, "clash") for i in range(5)] + [(104, "again", long, None), (None, "u", long, None), (200, "a\r\nb", None, None), (201, "", "", None)]
    rows += [(300, "big", fake * 3000, None), (301, "cut", "WARC/1.0\r\nContent-Length: 99999999999\r\n\r\n" * 50, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    tops = {}
    for page, _, html, _ in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and page is not None:
            tops[b] = max(tops.get(b, page), page)
    out = []
    for page, _, html, _ in rows:
        b = (html or "").encode()
        top = tops.get(b)
        again = top is not None and page != top and sum((r[2] or "").encode() == b for r in rows) > 1
        out.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    assert got == expected(rows)


def test_small_ranges_and_magic_in_payloads(spark):
    rows, df = pages(spark)
    path = shared_dir(spark, "warc-test")
    warc.write(df.coalesce(2), path)
    for size in (700, 5000):
        found = warc.records(spark, path, size).collect()
        assert len(found) == len(rows)
        kept = sorted(hashlib.sha1(bytes(r.payload)).hexdigest() for r in found if r.record_type == "response")
        assert kept == sorted(x[2] for x in expected(rows) if x[3] == "response")


def test_long_headers(spark):
    long = "data:" + "x" * 150_000
    rows = [(1, long, "first", None), (2, "http://a/2", "y" * 30_000, None), (3, long + "3", "WARC/1.0\r\n" * 20, None), (4, long + "4", "", None), (5, "http://a/5", "last", None)]
    path = shared_dir(spark, "warc-long")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    at = {r.at for r in warc.records(spark, path).collect()}
    # Ranges that start at a record with a long header, and some within which it starts.
    for size in (warc.RANGE, sorted(at)[2], 40_000):
        found = warc.records(spark, path, size).collect()
        assert sorted((r.uri, bytes(r.payload).decode()) for r in found) == sorted((r[1], r[2]) for r in rows)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
