"""Workbooks, Word documents and PDF files, read from their own formats with the standard library.

A file is parsed as one unit by one task, which is how these formats are made; many files are read in parallel. The
parsers take bytes and give rows, and reach Spark through mapInPandas over the binary file source.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import in_scope

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _read(spark: SparkSession, path: str, parser: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = ["uri", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(where, *row) for row in parser(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"uri string, {schema}")


# -- workbooks --------------------------------------------------------------------------------------------------------


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, row, column, value) of each cell that is not empty, from 1; values as text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_S}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        for number, row in enumerate(ElementTree.fromstring(book.read(part)).iter(f"{_S}row"), 1):
            for place, cell in enumerate(row.iter(f"{_S}c"), 1):
                value = cell.find(f"{_S}v")
                kind = cell.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else value.text
                yield sheet.get("name"), int(row.get("r") or number), _column(cell.get("r") or "") or place, text


def xlsx(spark: SparkSession, path: str) -> DataFrame:
    """uri, sheet, row, column, value: a row per cell."""
    return _read(spark, path, xlsx_cells, "sheet string, row long, column long, value string")


def xlsx_sheets(cells: DataFrame) -> DataFrame:
    """uri, sheet, rows, columns of each sheet, its header not counted."""
    return cells.groupBy("uri", "sheet").agg((F.count_distinct("row") - 1).alias("rows"), F.max("column").alias("columns"))


def xlsx_schema(cells: DataFrame) -> DataFrame:
    """uri, sheet, ordinal, name, type: the header row names the columns; all values decide the type."""
    first = cells.groupBy("uri", "sheet").agg(F.min("row").alias("head"))
    held = cells.join(first, ["uri", "sheet"])
    names = held.filter("row = head").select("uri", "sheet", F.col("column").alias("ordinal"), F.col("value").alias("name"))
    body = held.filter("row > head").groupBy("uri", "sheet", F.col("column").alias("ordinal")).agg(F.bool_and(F.col("value").try_cast("double").isNotNull()).alias("n"))
    return names.join(body, ["uri", "sheet", "ordinal"], "left").select("uri", "sheet", "ordinal", "name", F.when(F.coalesce("n", F.lit(False)), "double").otherwise("string").alias("type"))


def xlsx_data(cells: DataFrame, sheet: str, names: list[str]) -> DataFrame:
    """The rows of one sheet as columns of text, in the order of its header."""
    body = cells.filter((F.col("sheet") == sheet) & (F.col("row") > 1))
    return body.groupBy("uri", "row").pivot("column", list(range(1, len(names) + 1))).agg(F.first("value")).select("uri", "row", *(F.col(str(i + 1)).alias(n) for i, n in enumerate(names)))


def xlsx_table(cells: DataFrame, sheet: str) -> DataFrame:
    """The rows of one sheet under the names of its header row; an empty or repeated name gets its column's number.

    Reads the header row to the driver: a format of at most 16,384 columns. Of several files the first with the sheet names them.
    """
    head = cells.filter((F.col("sheet") == sheet) & (F.col("row") == 1)).orderBy("uri", "column").limit(16_384).collect()
    if not head:
        raise ValueError(f"no sheet named {sheet} with a header")
    named = {r["column"]: r["value"] for r in head if r["uri"] == head[0]["uri"]}
    names: list[str] = []
    for i in range(1, max(named) + 1):
        name = named.get(i) or f"column_{i}"
        names.append(f"{name}_{i}" if name in names or name in ("uri", "row") else name)
    return xlsx_data(cells, sheet, names)


def xlsx_files(files: DataFrame, pattern: str = "**") -> DataFrame:
    """The workbooks in scope."""
    return files.filter(in_scope(F.col("uri"), pattern) & F.lower("uri").endswith(".xlsx"))


def xlsx_find_amounts(cells: DataFrame, least: float = 0.0) -> DataFrame:
    """uri, sheet, row, column, amount of the cells that hold a number, currency marks and thousands aside."""
    amount = F.regexp_replace("value", r"[\s,$€£]", "").try_cast("double")
    return cells.select("uri", "sheet", "row", "column", amount.alias("amount")).filter(F.col("amount") >= least)


# -- Word -------------------------------------------------------------------------------------------------------------


def docx_parts(content: bytes) -> Iterator[tuple]:
    """(ordinal, kind, level, text) of headings, tables, images and comments, in order of the document."""
    book = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(book.read("word/document.xml"))
    told = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    n = 0
    for element in body.iter():
        found = None
        if element.tag == f"{_W}p":
            style = element.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"[Hh]eading\s?(\d)", style.get(f"{_W}val")) if style is not None else None
            found = ("docx_heading", int(level[1]), told(element)) if level else None
        elif element.tag == f"{_W}tbl":
            found = ("docx_table", 0, "\n".join("\t".join(told(c) for c in r.iter(f"{_W}tc")) for r in element.iter(f"{_W}tr")))
        elif element.tag == f"{_W}drawing":
            names = [e.get("name") for e in element.iter() if e.tag.endswith("}docPr")]
            found = ("docx_image", 0, names[0] if names else "")
        if found:
            n += 1
            yield (n, *found)
    if "word/comments.xml" in book.namelist():
        for comment in ElementTree.fromstring(book.read("word/comments.xml")).iter(f"{_W}comment"):
            n += 1
            yield n, "docx_comment", 0, told(comment)


def docx(spark: SparkSession, path: str) -> DataFrame:
    """uri, ordinal, kind, level, text of the nodes of Word documents."""
    return _read(spark, path, docx_parts, "ordinal long, kind string, level long, text string")


# -- PDF --------------------------------------------------------------------------------------------------------------


def _objects(content: bytes) -> dict[int, bytes]:
    """Objects by number, those inside object streams too; of two with one number the later."""
    found = {int(m[1]): m[2] for m in re.finditer(rb"(?:^|[\r\n\s])(\d+) \d+ obj\b(.*?)endobj", content, re.S)}
    for body in list(found.values()):
        if b"/ObjStm" not in body:
            continue
        data = _stream(body)
        count, first = int(re.search(rb"/N (\d+)", body)[1]), int(re.search(rb"/First (\d+)", body)[1])
        numbers = list(map(int, data[:first].split()[: 2 * count]))
        starts = numbers[1::2] + [len(data) - first]
        for i, number in enumerate(numbers[::2]):
            found.setdefault(number, data[first + starts[i] : first + starts[i + 1]])
    return found


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompress(m[1]) if b"/FlateDecode" in body else m[1]


def _string(body: bytes, name: bytes) -> str | None:
    m = re.search(rb"/" + name + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", body, re.S)
    if not m:
        return None
    if m[1][:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", m[1][1:-1]).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda x: bytes([int(x[1], 8)]) if x[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(x[1], x[1]), m[1][1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _ref(body: bytes, name: bytes) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+) \d+ R", body)
    return int(m[1]) if m else None


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the page objects in reading order."""
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and _ref(b, b"Parent") is None]
    out: list[int] = []

    def walk(number: int, depth: int) -> None:
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if not kids or depth > 50:
            out.append(number)
            return
        for kid in re.findall(rb"(\d+) \d+ R", kids[1]):
            walk(int(kid), depth + 1)

    for root in roots[:1]:
        walk(root, 0)
    return out


def pdf_parts(content: bytes) -> Iterator[tuple]:
    """(kind, ordinal, page, name, text): pages' text, bookmarks, form fields and annotations; pages count from 1."""
    objects = _objects(content)
    pages = _pages(objects)
    place = {n: i + 1 for i, n in enumerate(pages)}
    n = 0
    for number in pages:
        body = objects.get(number, b"")
        texts = []
        for ref in re.findall(rb"(\d+) \d+ R", (re.search(rb"/Contents\s*(\[.*?\]|\d+ \d+ R)", body, re.S) or [b"", b""])[1]):
            data = _stream(objects.get(int(ref), b""))
            texts += [_string(b"/T " + m, b"T") or "" for m in re.findall(rb"\((?:\\.|[^\\()])*\)(?=[^()]*T[jJ])", data, re.S)]
        n += 1
        yield "pdf_page", n, place[number], None, " ".join(texts)
        for ref in re.findall(rb"(\d+) \d+ R", (re.search(rb"/Annots\s*\[(.*?)\]", body, re.S) or [b"", b""])[1]):
            mark = objects.get(int(ref), b"")
            kind = re.search(rb"/Subtype\s*/(\w+)", mark)
            if kind and kind[1] != b"Widget":
                n += 1
                yield "pdf_annotation", n, place[number], kind[1].decode(), _string(mark, b"Contents")
    for body in objects.values():
        if b"/FT" in body and (name := _string(body, b"T")) is not None:
            n += 1
            yield "pdf_form_field", n, place.get(_ref(body, b"P") or -1), name, _string(body, b"V")
        if b"/Title" in body and b"/Parent" in body and re.search(rb"/(Dest|A)\b", body):
            dest = re.search(rb"/(?:Dest|D)\s*\[\s*(\d+) \d+ R", body)
            n += 1
            yield "pdf_bookmark", n, place.get(int(dest[1])) if dest else None, _string(body, b"Title"), None


def pdf(spark: SparkSession, path: str) -> DataFrame:
    """uri, kind, ordinal, page, name, text of PDF files; ``kind`` is pdf_page, pdf_bookmark, pdf_form_field or pdf_annotation."""
    return _read(spark, path, pdf_parts, "kind string, ordinal long, page long, name string, text string")


def pdf_pages(parts: DataFrame, first: int, last: int) -> DataFrame:
    """The pages first to last, both in."""
    return parts.filter((F.col("kind") == "pdf_page") & F.col("page").between(first, last))
