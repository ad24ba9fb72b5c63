"""Files as relations: workspace scans, text, CSV, JSON, SARIF, concept and vocabulary stores."""

from __future__ import annotations

import csv as _csv
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..functions.address import in_scope

#: Media types by extension; the kind parameter says what the content is.
MIMES = {
    ".cs": "text/x-csharp;kind=code.csharp", ".go": "text/x-go;kind=code.go", ".py": "text/x-python;kind=code.python", ".rb": "text/x-ruby;kind=code.ruby",
    ".rs": "text/x-rust;kind=code.rust", ".ts": "text/x-typescript;kind=code.typescript", ".tsx": "text/x-typescript;kind=code.typescript", ".cpp": "text/x-c++;kind=code.cpp",
    ".h": "text/x-c++;kind=code.cpp", ".php": "text/x-php;kind=code.php", ".md": "text/markdown;kind=markdown.doc", ".csv": "text/csv;kind=csv.table",
    ".json": "application/json;kind=json.doc", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet;kind=xlsx.book",
    ".pdf": "application/pdf;kind=pdf.doc", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document;kind=docx.doc", ".sarif": "application/sarif+json;kind=sarif.log",
}


def _below(path: Column, root: str) -> Column:
    """The path below root, whatever scheme and slashes Spark puts before it."""
    return F.regexp_replace(F.substring_index(path, root.rstrip("/").rsplit(":", 1)[-1].rstrip("/") + "/", -1), "^/+", "")


def workspace(spark: SparkSession, root: str, mount: str = "file:///", pattern: str | None = None, glob: str | None = None) -> DataFrame:
    """uri, name, extension, mime, byte_size, modified of every file below root. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).select("path", "length", "modificationTime")
    rel = _below(F.col("path"), root)
    name = F.substring_index("rel", "/", -1)
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    rows = found.select(rel.alias("rel"), "length", "modificationTime").withColumn("name", name).withColumn("extension", extension)
    mime = F.lit("application/octet-stream")
    for ext, kind in MIMES.items():
        mime = F.when(F.col("extension") == ext, F.lit(kind)).otherwise(mime)
    out = rows.select(F.concat(F.lit(mount), "rel").alias("uri"), "name", "extension", mime.alias("mime"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"))
    return out.filter(in_scope(F.col("uri"), pattern)) if pattern else out


def texts(spark: SparkSession, root: str, mount: str = "file:///", glob: str | None = None) -> DataFrame:
    """uri, text of every file below root, each as one text."""
    reader = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).format("text").load(root)
    return rows.select(F.concat(F.lit(mount), _below(F.col("_metadata.file_path"), root)).alias("uri"), F.col("value").alias("text"))


def concepts(spark: SparkSession, root: str) -> DataFrame:
    """capsule, text of the notes below root; README files are not notes."""
    rows = texts(spark, root, "concept:///", "*.md")
    return rows.filter(F.lower(F.substring_index("uri", "/", -1)) != "readme.md").withColumnRenamed("uri", "capsule")


VOCABULARY = "term string, meaning string, aliases string, scope string, domain string"


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """term, meaning, aliases, scope, domain of a vocabulary store: CSV with a header, lists joined by ``;``."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(VOCABULARY).csv(path)
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("term", "meaning", listed(F.col("aliases")).alias("aliases"), listed(F.col("scope")).alias("scope"), "domain")


def capture_terms(rows: DataFrame, path: str) -> None:
    """Append entries to the store. A redundant alias is reported by whoever asks, never refused."""
    joined = rows.select("term", "meaning", F.array_join("aliases", ";").alias("aliases"), F.array_join("scope", ";").alias("scope"), "domain")
    joined.write.mode("append").option("header", "true").option("escape", '"').csv(path)


# -- CSV --------------------------------------------------------------------------------------------------------------


def csv_data(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of a CSV file. Types are inferred unless they are given; a large file should give them, as it saves a pass."""
    reader = spark.read.option("header", str(header).lower()).option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def csv_schema(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, name, type, tokens: the columns and the tokens that reading each would take."""
    data = csv_data(spark, path)
    costs = data.agg(*(F.coalesce(F.sum(scalars.token_count(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(str(i)) for i, c in enumerate(data.columns)))
    kinds = F.array(*(F.struct(F.lit(i + 1).cast("long").alias("ordinal"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{i}`").cast("long").alias("tokens")) for i, f in enumerate(data.schema)))
    return costs.select(F.explode(kinds).alias("x")).select("x.*")


def csv_preview(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    return csv_data(spark, path).limit(most)


def csv_files(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """The files whose kind is a CSV table."""
    return files.filter((scalars.media_type_kind(F.col("mime")) == "csv.table") & in_scope(F.col("uri"), pattern))


# -- JSON -------------------------------------------------------------------------------------------------------------


def json_data(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The rows of JSON files, with the schema that they have now."""
    return spark.read.option("multiLine", str(multi_line).lower()).json(path)


def json_files(files: DataFrame, pattern: str | None = None) -> DataFrame:
    return files.filter((scalars.media_type_kind(F.col("mime")) == "json.doc") & in_scope(F.col("uri"), pattern))


#: How deep json_keys() goes.
JSON_DEPTH = 64


def json_keys(docs: DataFrame, key: str, text: str = "text", wanted: str | None = None) -> DataFrame:
    """key, path, value of every leaf: dotted names, elements numbered from 0; strings as they read, nulls left out.

    Objects and arrays are opened level by level by the engine's own functions, a round for each level that there
    is; what is no JSON has no leaves. Values below JSON_DEPTH come out as JSON text.
    """
    level = docs.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("v")).filter("v is not null")
    nested, out = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"), None
    for depth in range(JSON_DEPTH + 1):
        last = depth == JSON_DEPTH
        leaf = level if last else level.filter(~nested & (F.schema_of_variant("v") != "VOID"))
        value = F.to_json("v") if last else F.try_variant_get("v", "$", "string")
        found = leaf.select(key, "path", value.alias("value"))
        out = found if out is None else out.unionByName(found)
        inner = level.filter(nested)
        if last or inner.isEmpty():
            break
        inner.createOrReplaceTempView("corvane_json_level")
        step = docs.sparkSession.sql(f"SELECT `{key}`, path, coalesce(x.key, cast(x.pos AS STRING)) AS name, x.value AS v FROM corvane_json_level, LATERAL variant_explode(v) AS x")
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        level = step.select(key, path.alias("path"), "v")
    return out.filter(F.col("path").rlike(wanted)) if wanted else out


# -- inline -----------------------------------------------------------------------------------------------------------


def _yaml_rows(text: str) -> list[dict]:
    """A YAML list of flat mappings: the part of YAML that makes a table."""
    rows: list[dict] = []
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if body.startswith("- "):
            rows.append({})
            body = body[2:].strip()
        name, colon, value = body.partition(":")
        if not colon or not rows:
            raise ValueError(f"not a list of flat mappings: {line!r}")
        value = value.strip()
        rows[-1][name.strip()] = None if value in ("", "~", "null") else value.strip("'\"")
    return rows


def parse(spark: SparkSession, text: str) -> DataFrame:
    """Inline CSV, JSON or YAML as a table of strings; the form is told from the first character.

    The text is part of a call, so it is small and parsed where it is.
    """
    body = text.strip()
    if body[:1] in "[{":
        try:
            loaded = json.loads(body)
        except ValueError:
            loaded = [json.loads(x) for x in body.splitlines() if x.strip()]
        rows = loaded if isinstance(loaded, list) else [loaded]
    elif body.startswith("- "):
        rows = _yaml_rows(body)
    else:
        rows = list(_csv.DictReader(io.StringIO(body)))
    names = list(dict.fromkeys(k for r in rows for k in r))
    if not names:
        raise ValueError("the text holds no table")
    told = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(told(r.get(n)) for n in names) for r in rows], schema)


# -- SARIF ------------------------------------------------------------------------------------------------------------

_SARIF = """runs array<struct<
  tool: struct<driver: struct<name: string>>,
  results: array<struct<ruleId: string, level: string, message: struct<text: string>,
    locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: long>>>>>>>>"""
#: Levels of a report as severities.
LEVELS = {"error": "ERROR", "warning": "WARNING", "note": "INFO", "none": "HINT"}


def sarif(spark: SparkSession, path: str, mount: str = "file:///") -> DataFrame:
    """target_uri, line, severity, source, rule_id, message of the results of SARIF reports; one row per location."""
    return _results(spark.read.schema(_SARIF).option("multiLine", "true").json(path), mount)


def sarif_lines(spark: SparkSession, path: str, mount: str = "file:///") -> DataFrame:
    """The same where every line of a file is a report, which lets large files be split."""
    return _results(spark.read.schema(_SARIF).json(path), mount)


def _results(report: DataFrame, mount: str) -> DataFrame:
    runs = report.select(F.explode("runs").alias("r"))
    results = runs.select(F.col("r.tool.driver.name").alias("source"), F.explode("r.results").alias("x"))
    rows = results.select("source", "x", F.explode_outer("x.locations").alias("at"))
    severity = F.lit("WARNING")
    for level, name in LEVELS.items():
        severity = F.when(F.col("x.level") == level, name).otherwise(severity)
    at = F.col("at.physicalLocation")
    return rows.select(F.concat(F.lit(mount), at["artifactLocation"]["uri"]).alias("target_uri"), at["region"]["startLine"].alias("line"), severity.alias("severity"), "source", F.col("x.ruleId").alias("rule_id"), F.col("x.message.text").alias("message"))
