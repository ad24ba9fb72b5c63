"""Concepts, vocabulary and what sessions have seen."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import joins, memory
from ..sources import bindings as B
from . import query
from .relational import FILES, values

T = B.table
#: capsule, invariant, category, verification, relevance, is_universal, ttl_days, captured
CAPSULES = [
    ("concept:///rules/English.md", "English texts are checked", "RULE", None, ["doc:///en/**", "!doc:///en/src3/**"], False, None, date(2024, 1, 1)),
    ("concept:///rules/First.md", "The first source is frozen", "DECISION", None, ["doc:///*/src0/*"], False, 30, date(2024, 1, 1)),
    ("concept:///rules/Both.md", "Overlaps", "PATTERN", None, ["doc:///fr/src1/*", "doc:///fr/**"], False, 10, date(2024, 2, 1)),
    ("concept:///all/Everywhere.md", "Applies to all", "KNOWLEDGE", "read it", [], True, None, date(2024, 1, 1)),
    ("concept:///bad/name.md", " ", "OTHER", None, [], False, 0, date(2024, 1, 1)),
    ("concept:///know/It.md", "Known", "KNOWLEDGE", "", ["**"], False, 5, date(2024, 1, 1)),
]
CAPSULE = "capsule string, invariant string, category string, verification string, relevance array<string>, is_universal boolean, ttl_days int, captured date"
GOVERNS = f"""WITH {FILES}, g AS (
SELECT uri, 'concept:///rules/English.md' AS capsule, false AS is_universal, 2 AS globs FROM files WHERE lang = 'en' AND source <> 'src3'
UNION ALL SELECT uri, 'concept:///rules/First.md', false, 1 FROM files WHERE source = 'src0'
UNION ALL SELECT uri, 'concept:///rules/Both.md', false, 2 FROM files WHERE lang = 'fr'
UNION ALL SELECT uri, 'concept:///know/It.md', false, 1 FROM files)"""
ALL = GOVERNS + ", a AS (SELECT * FROM g UNION ALL SELECT uri, 'concept:///all/Everywhere.md', true, 0 FROM files), p AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY is_universal, globs, capsule) AS place FROM a)"


def capsules(spark):
    return spark.createDataFrame(CAPSULES, CAPSULE)


def targets(spark, d):
    return B.documents(spark, d).select("uri")


@query("j08_glob_governs", GOVERNS + " SELECT uri, capsule FROM g")
def _(spark, d):
    return joins.governs(targets(spark, d), capsules(spark)).select("uri", "capsule")


@query("m01_concepts", ALL + " SELECT uri, capsule, place FROM p")
def _(spark, d):
    return memory.concepts(targets(spark, d), capsules(spark)).select("uri", "capsule", "place")


@query("m01_concept_counts", ALL + " SELECT uri, count(*) FILTER (WHERE NOT is_universal AND place <= 2) AS narrow_shown, count(*) FILTER (WHERE is_universal) AS universal_applicable, count(*) AS total FROM p GROUP BY uri")
def _(spark, d):
    return memory.counted(memory.concepts(targets(spark, d), capsules(spark)), shown=2)


@query("t06_concept_order", ALL + " SELECT capsule, place FROM p WHERE uri = (SELECT min(uri) FROM files)")
def _(spark, d):
    one = targets(spark, d).orderBy("uri").limit(1)
    return memory.concepts(one, capsules(spark)).select("capsule", "place")


SESSIONS = [("s1", "concept:///know/It.md"), ("s2", "concept:///all/Everywhere.md")]


@query(
    "m02_surface_concepts",
    ALL
    + ", "
    + values("seen", "session, capsule", SESSIONS)
    + ", w AS (SELECT s.session, p.* FROM p, (VALUES ('s1'), ('s2'), ('s3')) s(session) WHERE uri LIKE 'doc:///fr/src0/%' OR uri LIKE 'doc:///en/src3/%'), f AS (SELECT session, capsule, min((is_universal, uri, place)) AS x FROM w WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.session = w.session AND seen.capsule = w.capsule) GROUP BY 1, 2) SELECT session, capsule, x[2] AS uri, row_number() OVER (PARTITION BY session ORDER BY x, capsule) AS place FROM f QUALIFY place <= 3",
)
def _(spark, d):
    written = B.documents(spark, d, "doc:///fr/src0/*;doc:///en/src3/*").select("uri")
    rows = memory.concepts(written, capsules(spark)).crossJoin(F.broadcast(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "session string")))  # three rows
    return memory.surfaced_concepts(rows, spark.createDataFrame(SESSIONS, "session string, capsule string"), 3)


SENSES = [("heron", "a wading bird", ["herons", "the heron"], "birds"), ("nation", "a country", ["the"], "law"), ("que", "that", [], "words"), ("absent", "not there", ["zzq"], "none")]
TOK = "tok AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' AS w FROM documents)"
SENSE_NAMES = [(t, m, n) for t, m, a, _ in SENSES for n in [t, *a]]


@query(
    "m03_surface_vocabulary",
    f"WITH {TOK}, " + values("v", "term, meaning, name", SENSE_NAMES) + ", h AS (SELECT doc_id, term, meaning, count(*) AS n FROM tok JOIN v ON contains(w, ' ' || name || ' ') GROUP BY ALL), r AS (SELECT *, row_number() OVER o AS place, sum(length(term) + length(meaning) + 2) OVER o AS used FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY n DESC, term, meaning)) SELECT doc_id, term, meaning, place FROM r WHERE place <= 2 AND used <= 30",
)
def _(spark, d):
    senses = spark.createDataFrame(SENSES, "term string, meaning string, aliases array<string>, domain string")
    return memory.surfaced_terms(T(spark, d, "documents"), senses, "doc_id", 2, 30)


@query("m04_capture_checks", "WITH " + values("c", "capsule, problems", [(c[0], n) for c, n in zip(CAPSULES, (0, 0, 0, 0, 5, 1), strict=True)]) + " SELECT capsule, problems::BIGINT AS problems FROM c")
def _(spark, d):
    return memory.violations(capsules(spark)).select("capsule", F.size("problems").cast("long").alias("problems"))


@query("m04_expiry", "WITH " + values("c", "capsule, expired", [(c[0], e) for c, e in zip(CAPSULES, (False, True, False, False, True, True), strict=True)]) + " SELECT * FROM c")
def _(spark, d):
    return capsules(spark).select("capsule", memory.expired(capsules(spark), F.lit("2024-02-05").cast("date")).alias("expired"))


@query("m08_provenance_notice", "SELECT DISTINCT a.user_id AS session, a.event_type AS uri, 'wt' AS worktree FROM events a WHERE a.value > 50 AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.value < 20) AND a.user_id % 5 <> 0")
def _(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("uri"), "value")
    edited = e.filter("value < 20").withColumn("worktree", F.lit("wt"))
    seen = e.filter("session % 5 = 0")
    return memory.provenance(e.filter("value > 50"), edited, seen)
