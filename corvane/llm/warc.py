"""WARC archives written and read by Spark, and transactions assembled through concurrent-to identifiers."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, settle, skew_join

DATE = "2024-01-01T00:00:00Z"
#: An archive file is read by one task as one value, so its size is bounded: pages of up to SMALL_PAGE bytes are written
#: by FILE_BYTES // SMALL_PAGE a file, those of up to BIG_PAGE by FILE_BYTES // BIG_PAGE, and larger ones by as many as
#: FILE_BYTES holds of the largest, one at least.
FILE_BYTES, SMALL_PAGE, BIG_PAGE = 128 << 20, 64 << 10, 1 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "digest string, payload_bytes long, payload binary, fields map<string,string>"
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: fifteen hex digits are twelve characters, in the digits of base 32."""
    return _base32(F.sha1(data))


def _base32(code: Column) -> Column:
    """40 hex digits in base32; code is read three times, so it should be a column and not a computation."""
    piece = lambda at, n: F.lpad(F.conv(F.substring(code, at, n), 16, 32), n * 4 // 5, "0")
    return F.translate(F.concat(piece(1, 15), piece(16, 15), piece(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)


def _uuid(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], content: str, block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Date: "), F.col("date"))]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # null values leave their line out
    lines += [F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _identified(pages: DataFrame, id_col: str, url_col: str, html_col: str, date_col: str | None) -> DataFrame:
    """id, url, html, date, bytes, sha (hex), own (the id of the response record) of every page; no shuffle."""
    date = F.coalesce(col(date_col).cast("string"), F.lit(DATE)) if date_col else F.lit(DATE)
    url = F.regexp_replace(F.regexp_replace(col(url_col), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(col(id_col).alias("id"), url.alias("url"), F.coalesce(col(html_col), F.lit("")).alias("html"), date.alias("date"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha", F.sha1("html"))
    return rows.withColumn("own", _uuid("response", F.col("id"), F.col("url"), F.col("sha")))


def _returning(narrow: DataFrame) -> DataFrame:
    """sha, first_id, first_own of the payloads that several records have: the least id, nulls last."""
    least = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "own"))
    held = narrow.filter(F.col("bytes") >= LEAST_BYTES).groupBy("sha").agg(F.count("*").alias("k"), least.alias("f")).filter("k > 1")
    return held.select("sha", F.col("f.id").alias("first_id"), F.col("f.own").alias("first_own"), F.col("f.n").alias("first_null"))


#: Payloads that return are sent to every task up to this number (a digest, an id and a record id each, about 150
#: bytes); beyond it they are met in a shuffle.
SENT_PAYLOADS = 100_000


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> None:
    """Write a request, a response or revisit, and a metadata record of every page as gzipped WARC files under path.

    Of pages with equal payloads of LEAST_BYTES or more, those with the smallest id are responses and the others
    revisit them, without their payload. A null payload is empty; a null url has no target; line ends in a url are
    percent-encoded. Null ids come after all others. ``date_col`` holds WARC dates; null ones and a table without it
    take DATE. Spark's text writer makes the files: a record ends in two line ends, which is the separator it writes,
    and its commit protocol keeps the files of lost tasks out. A file is one gzip member without a warcinfo record.

    What a page revisits is decided on a narrow table of digests, without payloads. Unless very many payloads return,
    the decision is sent to the pages, so no payload is shuffled; else only those that return are, and of a digest of
    very many pages the payloads stay where they are.
    """
    rows = _identified(pages, id_col, url_col, html_col, date_col)
    narrow = settle(rows.select("id", "bytes", "sha", "own"))
    firsts = settle(_returning(narrow))
    largest = narrow.agg(F.max("bytes")).first()[0] or 0
    if firsts.limit(SENT_PAYLOADS + 1).count() <= SENT_PAYLOADS:
        rows = rows.join(F.broadcast(firsts), "sha", "left")
    else:
        rows = skew_join(rows, firsts, "sha")
    again = F.col("first_null").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    least = -1
    for most in (SMALL_PAGE, BIG_PAGE, max(largest, BIG_PAGE + 1)):
        if least < largest:  # a class without pages costs no scan
            part = rows.filter((F.col("bytes") > least) & (F.col("bytes") <= most)) if largest > SMALL_PAGE else rows
            lines = part.select(F.concat_ws("\r\n\r\n", *_records(again)).alias("value"))
            out = lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
            out.option("maxRecordsPerFile", max(1, FILE_BYTES // most)).text(f"{path}/upto-{most}")
        least = most


def _records(again: Column) -> list[Column]:
    """The request, the response or revisit, and the metadata record of a row of _identified()."""
    own, target = F.col("own"), F.col("url")
    digest = F.concat(F.lit("sha1:"), _base32(F.col("sha")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    where = F.regexp_extract("url", r"^[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    host = F.regexp_extract("url", r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    ask = F.concat(F.lit("GET "), F.coalesce(F.when(where.startswith("/"), where), F.concat(F.lit("/"), where), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n"))
    fields = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.lit("fetched-by: corvane"))
    concurrent = ("WARC-Concurrent-To", own)
    return [
        _record(F.lit("request"), _uuid("request", own), [("WARC-Target-URI", target), concurrent], "application/http;msgtype=request", ask),
        _record(
            F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
            own,
            [
                ("WARC-Target-URI", target),
                ("WARC-Payload-Digest", digest),
                ("WARC-Refers-To", F.when(again, F.col("first_own"))),
                ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ],
            "application/http;msgtype=response",
            F.when(again, head).otherwise(F.concat(head, F.col("html"))),
        ),
        _record(F.lit("metadata"), _uuid("metadata", own), [("WARC-Target-URI", target), concurrent], "application/warc-fields", fields),
    ]


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(data: bytes, payloads: bool) -> Iterator[tuple]:
    """The records of one archive file, plain or of any number of gzip members, as rows of RECORD.

    The file is unpacked as it is read, so beside its own bytes one record is held. A cut-off last record is an error.
    """
    held, at, unzip = bytearray(), 0, None
    if data[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, unzip
        while at < len(data):
            piece = data[at : at + (1 << 18)]
            at += len(piece)
            if unzip is None:
                held.extend(piece)
                return True
            got = unzip.decompress(piece)
            if unzip.eof:
                at -= len(unzip.unused_data)
                unzip = zlib.decompressobj(31)
            if got:
                held.extend(got)
                return True
        return False

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        seek = 0
        while (end := held.find(b"\r\n\r\n", max(0, seek - 3))) < 0:
            seek = len(held)
            if not more():
                if bytes(held).strip():
                    raise ValueError("an archive ends within a record's head")
                return
            while held[:2] == b"\r\n":
                del held[:2]
                seek = 0
        head = _headers(bytes(held[:end]))
        size, start = int(head.get("content-length", 0)), end + 4
        while len(held) < start + size:
            if not more():
                raise ValueError("an archive ends within a record's block")
        block = bytes(held[start : start + size])
        del held[: start + size]
        kind, fields, payload = head.get("warc-type"), {}, block
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if "application/http" in head.get("content-type", ""):
            top, _, payload = block.partition(b"\r\n\r\n")
            fields = _headers(top)
        elif "warc-fields" in head.get("content-type", ""):
            fields = _headers(block)
        count = len(payload)
        if kind == "revisit":
            count, payload = int(fields.get("content-length", 0)), b""
        elif kind == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()  # of what was read, not what was claimed
        yield (
            head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
            head.get("warc-date"), digest, count, payload if payloads else None, fields,
        )


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under path. Without payloads their bytes are hashed and counted, then let go."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows, size = [], 0
                for row in parse(data, payloads):
                    rows.append(row)
                    size += len(row[8] or b"") + 500
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs or null).

    A record belongs to the capture that its concurrent-to names, or to its own. One shuffle by capture id, after
    aggregation on the map side. A response that was written several times under one id is as many captures. Records
    that name a response which is nowhere make a capture without one.
    """
    kind = F.col("type")
    one = lambda *of: F.first(F.when(kind.isin(*of), F.struct(*(c for c in records.columns if c != "concurrent_to"))), ignorenulls=True)
    rows = records.filter(kind.isin("request", "response", "revisit", "metadata"))
    held = rows.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.count_if(kind.isin("response", "revisit")).alias("n"),
        one("response", "revisit").alias("response"),
        one("request").alias("request"),
        one("metadata").alias("metadata"),
    )
    each = held.withColumn("again", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))))
    return each.select("capture_id", "response", "request", "metadata")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to (the page id of the response)."""
    rows = transactions(read(spark, path, payloads=False)).select(
        F.element_at("metadata.fields", "page-id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("to"),
        F.col("capture_id").alias("id"),
    )
    rows = settle(rows)
    known = rows.filter("record_type = 'response'").groupBy("id").agg(F.min("page_id").alias("refers_to")).withColumnRenamed("id", "to")
    again = skew_join(rows.filter("to is not null"), known, "to")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.filter("to is null").withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(again.select(names))
