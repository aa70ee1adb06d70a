from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest

from tillwise.llm.runtime import scratch
from tillwise.llm.warc import WarcError, _roles, _uri, digest, pack, read_archives, read_records, round_trip, write_archives

PAGES = [
    (1, "http://a/1", "<html>one</html>"), (2, "http://a/2", "<html>one</html>"), (3, None, "<html>ü\r\n\r\nthree</html>"),
    (4, "http://a/ 4\n", None), (5, "", ""), (None, "http://a/6", "<html>one</html>"), (None, "x", "alone"),
    (7, "http://a/7", "same"), (7, "http://a/7", "same"), (6, "y", "same"), (8, "long", "é" * 700_000), (9, "w", "WARC/1.1\r\n\r\n"),
]
SCHEMA = "page_id long, url string, html string"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, smallest=0):
    answer = defaultdict(list)
    for page, _, html in pages:
        answer[html or ""].append(page)
    answer = {t: max((i for i in ids if i is not None), default=None) for t, ids in answer.items()}
    rows, used = [], set()
    for page, _, html in pages:
        text = html or ""
        key = (page, text)
        response = len(text.encode()) < smallest or (page == answer[text] and key not in used)
        used.add(key)
        rows.append((page, len(text.encode()), sha1(text), "response" if response else "revisit", None if response else answer[text]))
    return rows


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], SCHEMA + ", key string, id int")
    assert Counter(map(tuple, round_trip(pages).collect())) == Counter(expected(PAGES))


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    archives = write_archives(pages, scratch(spark, "warc"), smallest=10)
    rows = read_archives(archives).drop("payload", "url").collect()
    assert Counter(map(tuple, rows)) == Counter(expected(PAGES, 10))


def test_payloads_and_members(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    archives = write_archives(pages, scratch(spark, "warc"))
    bodies = {(r.page_id, bytes(r.payload)) for r in read_archives(archives).collect() if r.record_type == "response"}
    assert bodies == {(p, (t or "").encode()) for (p, _, t), e in zip(PAGES, expected(PAGES)) if e[3] == "response"}
    assert archives.agg({"records": "sum"}).first()[0] == len(PAGES)
    for row in archives.collect():  # any gzip reader sees the same archive
        with gzip.open(row.path.removeprefix("file://")) as whole:
            assert whole.read().count(b"WARC-Record-ID") == row.records


def test_hot_payload_is_split(spark, skewed):
    """Most pages are empty: the join with the answers is split, one page answers for all."""
    pages = spark.range(0, 60_000, 1, 8).selectExpr("id AS page_id", "'u' AS url", "CAST(CASE WHEN id % 10 < 9 THEN '' ELSE string(id) END AS BINARY) AS payload")
    rows, plan = skewed(_roles(pages, 0).select("page_id", "revisit", "refers_to"))
    assert "skew=true" in plan
    hot = [r for r in rows if r.page_id % 10 < 9]
    assert [r.page_id for r in hot if not r.revisit] == [59_998] and {r.refers_to for r in hot if r.revisit} == {59_998}
    assert not any(r.revisit for r in rows if r.page_id % 10 == 9)


def test_paths_of_the_shared_folder():
    assert [_uri(p) for p in ("file:/tmp/x", "file:///tmp/x", "s3a://b/x", "s3://b/x", "hdfs://n/x")] == [
        "file:///tmp/x", "file:///tmp/x", "s3://b/x", "s3://b/x", "hdfs://n/x"]


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_faults_are_found():
    good = pack(1, "u", b"payload", None, False)
    assert [r.payload for r in read_records(io.BytesIO(good + good))] == [b"payload"] * 2
    assert list(read_records(io.BytesIO(b""))) == []
    plain = gzip.decompress(good)
    for wrong in (plain.replace(b"payload", b"payl0ad"), plain + b"x", plain[:-2], plain.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(gzip.compress(wrong))))
    for cut in (5, 20, len(good) - 3):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(good + good[:cut])))
    swapped = plain.replace(digest(b"payload").encode(), digest(b"other").encode())
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(gzip.compress(swapped))))
