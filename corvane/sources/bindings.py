"""The relations of the query surface over stored tables. Path segments stay physical columns, for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.address import Scope


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Path of a document below this: lang, source, doc_id.
DOCUMENTS = "doc:///"


def documents(spark: SparkSession, sf_dir: str, pattern: str | None = None) -> DataFrame:
    """uri, lang, source, doc_id, text; a pattern is pushed to lang and source before the uri is built."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    if pattern:
        docs = docs.filter(Scope.parse(pattern).segments(DOCUMENTS, ["lang", "source"]))
    docs = docs.withColumn("uri", F.concat(F.lit(DOCUMENTS), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))))
    return docs.filter(Scope.parse(pattern).column(F.col("uri"))) if pattern else docs


def files(spark: SparkSession, sf_dir: str, pattern: str | None = None) -> DataFrame:
    """The Files relation: uri, name, extension, mime, lang, source, byte_size, token_count, headline."""
    docs = documents(spark, sf_dir, pattern)
    return docs.select(
        "uri",
        F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"),
        F.lit(".md").alias("extension"),
        F.concat(F.lit("text/markdown;kind=markdown."), F.col("lang")).alias("mime"),
        "lang",
        "source",
        F.octet_length("text").cast("long").alias("byte_size"),
        scalars.token_count(F.col("text")).alias("token_count"),
        scalars.headline(F.col("text")).alias("headline"),
    )


def lines(docs: DataFrame, uri: str = "uri", text: str = "text", *keep: str) -> DataFrame:
    """docs -> uri, line_number from 1, line, and the kept columns."""
    return docs.select(uri, *keep, F.posexplode(F.split(text, "\n")).alias("n", "line")).select(uri, *keep, (F.col("n") + 1).cast("long").alias("line_number"), "line")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, ordinal of every link of a page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.posexplode(found).alias("n", "dst"))
    return pages.select("src", "dst", (F.col("n") + 1).cast("long").alias("ordinal"))


def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, level (0 for the title), title: what a page declares. Pages may share a url, or have none."""
    tags = F.regexp_extract_all("html", F.lit(r"<(title|h[1-6])[^>]*>([^<]*)<"), F.lit(1))
    names = F.regexp_extract_all("html", F.lit(r"<(title|h[1-6])[^>]*>([^<]*)<"), F.lit(2))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.arrays_zip(tags.alias("tag"), names.alias("title"))).alias("x"))
    level = F.when(F.col("x.tag") == "title", 0).otherwise(F.substring("x.tag", 2, 1).try_cast("int")).cast("long")
    return pages.select("page_id", "url", level.alias("level"), F.trim("x.title").alias("title"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, author, authored_at: a commit is an order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("authored_at"), F.col("o_orderpriority").alias("message"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, file: the parts of an order, once each."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("file")).distinct()


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, seq, ts, state, value: the feed of each run."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), "value", "props")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uri, lang, source, mark: covered, uncovered, or unmeasured where there is no label."""
    docs = documents(spark, sf_dir).select("doc_id", "uri", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    mark = F.when(F.col("quality") == 1, "covered").when(F.col("quality") == 0, "uncovered").otherwise("unmeasured")
    return docs.join(labels, "doc_id", "left").select("doc_id", "uri", "lang", "source", mark.alias("mark"))


#: Severities in order.
SEVERITIES = ("HINT", "INFO", "WARNING", "ERROR")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_uri, lang, source, severity, rule_id, message: what the labels hold against documents."""
    docs = documents(spark, sf_dir).select("doc_id", "uri", "lang", "source")
    bad = table(spark, sf_dir, "labels").filter("toxic = 1 or quality = 0")
    severity = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "ERROR").when(F.col("toxic") == 1, "WARNING").otherwise("INFO")
    rule = F.when(F.col("toxic") == 1, "toxic").otherwise("low-quality")
    return bad.join(docs, "doc_id").select(F.col("uri").alias("target_uri"), "lang", "source", severity.alias("severity"), rule.alias("rule_id"), F.concat(rule, F.lit(" text")).alias("message"))
