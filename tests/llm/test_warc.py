import base64
import hashlib

from cellweave.llm import common, warc


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://a/4\r\nx", ""), (5, "http://b", "über\r\n\r\nrest"), (None, "http://n", "same"), (6, "u", "6" * 100_000)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, sha string")
    out = common.fresh_folder(spark, "w")
    index = warc.write_archives(pages, out)
    got = {r["page_id"]: r for r in warc.read_records(index, out).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert got[page_id]["payload_bytes"] == len(raw)
        assert got[page_id]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[page_id]["html"] == (None if got[page_id]["record_type"] == "revisit" else html or "")
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    some = warc.read_records(index.where("page_id in (2, 5)"), out).collect()
    assert sorted(r["page_id"] for r in some) == [2, 5]


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    out = common.fresh_folder(spark, "w")
    got = {r["page_id"]: r["record_type"] for r in warc.read_records(warc.write_archives(pages, out, min_bytes=5), out).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark):
    out = common.fresh_folder(spark, "w")
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), out), out).count() == 0


def test_ranges_coalesce_neighbours():
    spans = [(0, 10), (10, 5), (30, 5), (1000, 10)]
    assert list(warc.ranges(spans, gap=20, most=100)) == [(0, 3, 0, 35), (3, 4, 1000, 1010)]
    assert list(warc.ranges(spans, gap=20, most=16)) == [(0, 2, 0, 15), (2, 3, 30, 35), (3, 4, 1000, 1010)]
