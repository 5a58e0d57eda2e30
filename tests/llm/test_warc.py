import base64
import collections
import hashlib

import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01

from glosa.llm.queries import QUERIES
from glosa.llm.warc import archived, chunked, read_archives, unchunked, write_archives

PAGES = "page_id long, url string, html string"


def expected(rows, min_bytes=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= min_bytes else None
        to = None if to == page else to
        out[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "response" if to is None else "revisit", to] += 1
    return out


def got(df):
    rows = df.collect()
    assert all(r.complete for r in rows)
    return collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


def hostile_pages():
    mark = "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1"
    htmls = ["", None, "a", "a", "a", mark, mark * 3000, "WARC/1.1", "x" * 8191 + "é" * 9000, "😀" * 40_000, "\r\n\r\n0\r\n\r\n",
             "\x00\x1f\x7f \n", "<p>" + "long " * 100_000, "WARC/" + "1.1", "tail WARC/", "1.1\r\n"]
    rows = [(50 - i, f"http://h.example/é {i}\r\nX: y", h) for i, h in enumerate(htmls)]
    return rows + [(47, None, "a"), (47, None, "a"), (None, "u", "a"), (None, "u", "only null"), (None, "v", "only null"),
                   (-3, "", "b"), (-2, "", "b")]


def test_query_matches_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF01}/pages.parquet", columns=["page_id", "url", "html"]).to_pylist()]
    df = QUERIES["op5_warc_segments"](spark, SF01)
    assert df.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got(df) == expected(rows)


def test_hostile_pages(spark):
    pages = spark.createDataFrame(hostile_pages(), PAGES).repartition(3).withColumn("digest", F.lit("clash"))
    assert got(archived(pages)) == expected(hostile_pages())
    assert got(archived(pages, segment_bytes=700, chunk_bytes=64, min_bytes=2)) == expected(hostile_pages(), 2)


def test_payloads_come_back_whole(spark, tmp_path):
    pages = spark.createDataFrame(hostile_pages(), PAGES).where("page_id > 0").dropDuplicates(["html"])
    write_archives(pages, str(tmp_path / "w"), segment_bytes=900)
    back = {r.page_id: bytes(r.payload).decode() for r in
            read_archives(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    assert back == {r.page_id: r.html or "" for r in pages.collect() if r.page_id in back} and len(back) >= 12


def test_lost_and_swapped_segments_are_reported(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "z" * 5000), (2, "v", "short")], PAGES).coalesce(1)
    write_archives(pages, str(tmp_path / "w"), segment_bytes=1000)
    (path,) = (tmp_path / "w").glob("part-*")
    data = path.read_bytes()
    records = [b"WARC/1.1\r\n" + r for r in data.split(b"WARC/1.1\r\n")[1:]]
    for k, name in enumerate(("lost", "other order", "damaged")):
        new = {0: records[:2] + records[3:], 1: records[::-1], 2: [r.replace(b"zzzz", b"zzyz", 1) for r in records]}[k]
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "part-0").write_bytes(b"".join(new))
        out = {r.page_id: (r.complete, r.payload) for r in read_archives(spark, str(tmp_path / f"d{k}")).collect()}
        assert out[2] == (True, b"short"), name
        assert out[1] == ((True, b"z" * 5000) if k == 1 else (False, None)), name


@given(st.lists(st.sampled_from(["WARC/1.1", "WARC/", "1.1", "\r\n", "é", "a" * 50, "😀"]), max_size=30).map("".join),
       st.integers(1, 40))
def test_framing_round_trip(text, size):
    body = chunked(text.encode(), size)
    assert unchunked(body) == text.encode()
    assert b"WARC/1.1" not in body or size < 8 and b"WARC/1.1" not in body
    assert unchunked(body[:-5]) is None


def test_foreign_framing():
    assert unchunked(b"5;x=y\r\nhello\r\n00\r\nTrailer: 1\r\n\r\n") == b"hello"
    assert unchunked(b"zz\r\nhello\r\n0\r\n\r\n") is None and unchunked(b"5\r\nhell\r\n0\r\n\r\n") is None


def test_empty_table(spark):
    assert archived(spark.createDataFrame([], PAGES)).collect() == []


def test_a_url_that_ends_in_the_version(spark):
    rows = [(1, "http://a.example/WARC/1.1", "<p>one</p>"), (2, "WARC/1.1", "<p>two</p>"), (3, "http://a.example/", "<p>one</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archived(df).select("page_id", "record_type", "complete").collect()
    assert sorted((r.page_id, r.record_type, r.complete) for r in got) == [
        (1, "response", True), (2, "response", True), (3, "revisit", True)]
