"""Archives: exact round trip, revisits, merged order."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from txquality.llm import warc
from txquality.llm.common import new_folder

BIG = "<p>é" + "x" * 1200
PAGES = [
    (1, "http://B.example.com/z?q=1#f", BIG), (2, "http://a.example.com/", BIG), (3, "https://b.example.com/z?q=1", "tiny"), (4, "http://c.org", "tiny"),
    (5, None, None), (6, "", ""), (7, "http://b.example.com/line\r\nbreak", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb"), (8, "http://a.example.com/", BIG + " "),
    (9, "http://a.example.com/", "y" * 999), (10, "http://a.example.com/", "y" * 999), (9, "http://a.example.com/", "y" * 999), (11, "http://long.org/", "é" * 400_000),
    (2, "http://a.example.com/", BIG), (None, "http://a.example.com/", BIG), (None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 0) for p in PAGES], "page_id bigint, url string, html string, payload string, keeper int").repartition(3)


def test_round_trip(spark, pages):
    folder = warc.write(pages, new_folder(spark, "test"), file_bytes=300_000)
    captures = warc.read(spark, folder)
    found = captures.collect()
    assert len(found) == len(PAGES) and len({r.run for r in found}) > 1
    keeper = max(p for p, _, h in PAGES if h == BIG and p is not None)
    expected = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        again = html == BIG and page != keeper
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert all(r.digest_ok or r.record_type == "revisit" for r in found)


def test_files_are_warc_and_runs_are_sorted(spark, pages):
    folder = warc.write(pages, new_folder(spark, "test"), file_bytes=300_000)
    files = [r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect()]
    for content in files:
        plain = gzip.decompress(bytes(content))
        for headers, block in warc.parsed(plain):
            assert headers["WARC-Type"] in ("response", "revisit") and len(block) == int(headers["Content-Length"])
        assert not plain or (plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n"))
    for run in {r.run for r in warc.read(spark, folder).collect()}:
        keys = [(r.url_key, r.captured) for r in warc.read(spark, folder).where(f"run = '{run}'").orderBy("position").collect()]
        assert keys == sorted(keys)


@pytest.mark.parametrize("range_rows", [4, 1000])
def test_merged_order(spark, pages, range_rows):
    captures = warc.read(spark, warc.write(pages, new_folder(spark, "test"), file_bytes=300_000))
    rows = sorted(warc.merged(captures, range_rows).collect(), key=lambda r: (r.range, r.place))
    none_first = lambda v: (v is not None, v or 0)
    order = [(r.url_key, r.captured, none_first(r.page_id)) for r in rows]
    assert len(rows) == len(PAGES) and order == sorted(order)
    history = {r.url_key: r for r in warc.histories(captures).collect()}
    assert history["com,example,a)/"].captures == 7 and history["com,example,a)/"].versions == 3


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        streams = [sorted(rng.randrange(20) for _ in range(rng.randrange(0, 12))) for _ in range(k)]
        keyed = [[((v,), (i, n)) for n, v in enumerate(s)] for i, s in enumerate(streams)]
        assert list(warc.LoserTree(keyed)) == sorted((x for s in keyed for x in s), key=lambda x: (x[0], x[1]))


def test_empty_table(spark, pages):
    assert warc.archive(pages.limit(0)).count() == 0


def test_times_are_utc_in_every_session_zone(spark):
    rows = [(1, "http://a.org/", "x", "1600000000"), (2, "http://a.org/", "x", None), (3, "http://a.org/", "x", "soon"), (4, "http://a.org/", "x", "1604210400"),
            (5, "http://a.org/", "x", "1604214000"), (6, "http://a.org/", "x", "-5"), (7, "http://a.org/", "x", "99999999999999")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, captured string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        named = {r.page_id: r.captured for r in warc.archive(pages, captured="captured").collect()}
        clash = {r.page_id: r.captured for r in warc.archive(pages).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    default = {i: warc.EPOCH + i for i in range(1, 8)}
    assert clash == default
    assert named == {**default, 1: 1600000000, 4: 1604210400, 5: 1604214000}
