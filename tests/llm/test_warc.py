import base64
import gzip
import hashlib

import pytest
from corvane.llm import common, warc
from corvane.llm.common import fresh_dir

PAGES = [
    (1, "http://a.example/x?q=1", "<p>one\r\n\r\nWARC/1.1\r\nnot a record</p>"),
    (2, "http://b.example", None),
    (3, None, ""),
    (4, "https://c.example/é", "<p>two é \U0001f600</p>"),
    (5, "https://d.example/", "<p>two é \U0001f600</p>"),
    (6, "https://d.example/", "<p>two é \U0001f600</p>"),
    (7, "http://e.example/\r\nX: y", "long " * 200_000),
    (None, "http://f.example", "<p>two é \U0001f600</p>"),
    (4, "https://c.example/é", "<p>two é \U0001f600</p>"),
    (8, "http://g.example", "only"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def path(spark):
    at = fresh_dir(spark, "warc")
    df = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, bytes int").repartition(3)
    warc.write(df, at)
    return at


def test_captures_equal_the_pages(spark, path):
    got = sorted((tuple(r) for r in warc.captures(spark, path).collect()), key=repr)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[digest(html)] = min(first.get(digest(html), i), i)
    want = []
    for i, _, html in PAGES:
        again = i != first.get(digest(html), i)
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", first[digest(html)] if again else None))
    assert got == sorted(want, key=repr)


def test_transactions_nest_what_was_exchanged(spark, path):
    rows = warc.transactions(warc.read(spark, path)).collect()
    assert len(rows) == len(PAGES)
    by = {r["metadata"]["fields"].get("page-id"): r for r in rows}
    one = by["1"]
    assert bytes(one["response"]["payload"]).decode() == PAGES[0][2]
    assert one["response"]["target_uri"] == PAGES[0][1] and one["request"]["type"] == "request"
    assert by["5"]["response"]["type"] == "revisit" and bytes(by["5"]["response"]["payload"]) == b""
    assert by["7"]["response"]["target_uri"] == "http://e.example/%0D%0AX: y"


def test_parser_reads_members_plain_files_and_refuses_a_cut_one():
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <{i}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    plain = record(1, "a: b") + record(2, "")
    members = gzip.compress(record(1, "a: b")) + gzip.compress(record(2, ""))
    for data in (plain, members):
        rows = list(warc.parse(data, True))
        assert [r[0] for r in rows] == ["<1>", "<2>"] and rows[0][9] == {"a": "b"}
    with pytest.raises(ValueError):
        list(warc.parse(plain[:-20], True))
    assert list(warc.parse(b"", True)) == []


def test_records_without_their_response_are_a_capture(spark):
    rows = [("<r>", "request", "<gone>"), ("<x>", "response", None), ("<m>", "metadata", "<x>"), ("<x>", "response", None), ("<i>", "warcinfo", None)]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string")
    got = sorted((r["capture_id"], r["response"] is not None, r["request"] is not None, r["metadata"] is not None) for r in warc.transactions(df).collect())
    assert got == [("<gone>", False, True, False), ("<x>", True, False, True), ("<x>", True, False, True)]


def test_no_pages(spark):
    at = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), at)
    assert warc.captures(spark, at).collect() == []


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    monkeypatch.setattr(warc, "SMALL_PAGE", 1000)
    monkeypatch.setattr(warc, "BIG_PAGE", 3000)
    sizes = [10, 1000, 1001, 3000, 3001, 9000, 0, 999] * 5
    pages = [(i, "http://a.example", "x" * n + str(i % 3) if n > 10 else "x" * n) for i, n in enumerate(sizes)]
    at = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), at)
    got = {r["page_id"]: r["payload_bytes"] for r in warc.captures(spark, at).collect()}
    assert got == {i: len(h) for i, _, h in pages}
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(at).select("content").collect()
    counts = [sum(r[1] in ("response", "revisit") for r in warc.parse(bytes(f[0]), False)) for f in held]
    assert sum(counts) == len(pages) and max(counts) <= 6


@pytest.mark.parametrize("sent", [0, 100_000])
def test_many_returning_payloads_give_the_same(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT_PAYLOADS", sent)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(common, "MOST_HOT", 5)
    pages = [(i, f"http://a.example/{i}", "same" if i % 3 else f"page {i // 6}") for i in range(200)]
    at = fresh_dir(spark, "warc")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), at)
    first = {}
    for i, _, h in pages:
        first[h] = min(first.get(h, i), i)
    want = sorted((i, "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in pages)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.captures(spark, at).collect()) == want


def test_dates_come_from_their_column(spark):
    at = fresh_dir(spark, "warc")
    df = spark.createDataFrame([(1, "http://a.example", "a", "2025-02-03T04:05:06Z"), (2, "http://a.example", "b", None)], "page_id long, url string, html string, at string")
    warc.write(df, at, date_col="at")
    got = {r["metadata"]["fields"]["page-id"]: r["response"]["date"] for r in warc.transactions(warc.read(spark, at)).collect()}
    assert got == {"1": "2025-02-03T04:05:06Z", "2": warc.DATE}


def test_base32_of_the_digest(spark):
    df = spark.createDataFrame([(str(i) * i,) for i in range(200)], "s string")
    assert [r[1] for r in df.select("s", warc.base32_sha1(df.s)).collect()] == [digest(str(i) * i) for i in range(200)]
