"""Grep, BM25, hashed vectors, fusion, similar items and vocabulary discovery."""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import functions as F

from ..operators import grams, joins, postings, search, vectors
from ..operators.lineage import fresh_dir, settle
from ..sources import bindings as B
from . import query
from .addresses import LINES
from .relational import FILES, registry

T = B.table
TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)"


def bm25_sql(name: str, words: list[str]) -> str:
    """CTEs ending in ``name(doc_id, score)``."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS t{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(len(words)))
    k, b = search.K1, search.B
    score = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * {k + 1} / (t{i} + {k} * ({1 - b} + {b} * n / mean))" for i in range(len(words)))
    some = " OR ".join(f"t{i} > 0" for i in range(len(words)))
    return f"{name}_r AS (SELECT doc_id, len(w) AS n, {tf} FROM tok), {name}_s AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM {name}_r), {name} AS (SELECT doc_id, round({score}, {search.DIGITS}) AS score FROM {name}_r, {name}_s WHERE {some})"


def vector_sql(name: str, text: str) -> str:
    """CTEs ending in ``name(doc_id, score)``."""
    wanted: Counter = Counter()
    for word, n in Counter(re.findall(r"\w+", text.lower())).items():
        dim, sign = search.place_of(word)
        wanted[dim] += sign * (1 + log(n))
    size = sqrt(sum(v * v for v in wanted.values()))
    weight = "CASE " + " ".join(f"WHEN d = {d} THEN {float(v)!r}" for d, v in sorted(wanted.items()) if v) + " ELSE 0.0 END"
    return f"""{name}_e AS (SELECT doc_id, x, 1 + ln(count(*)) AS v FROM (SELECT doc_id, unnest(w) AS x FROM tok) GROUP BY 1, 2),
{name}_d AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 2))::INT AS d, sum(CASE WHEN ('0x' || substr(md5(x), 3, 1))::INT % 2 = 0 THEN v ELSE -v END) AS v FROM {name}_e GROUP BY 1, 2),
{name} AS (SELECT doc_id, round(sum(v * {weight}) / (sqrt(sum(v * v)) * {size!r}), 6) AS score FROM {name}_d GROUP BY 1 HAVING sqrt(sum(v * v)) > 0 AND round(sum(v * {weight}) / (sqrt(sum(v * v)) * {size!r}), 6) > 0)"""


def fused_sql(name: str, lists: list[str], most: int) -> str:
    """CTEs ending in ``name(rank, doc_id, score)``."""
    parts = " UNION ALL ".join(f"SELECT doc_id, 1.0::DOUBLE / ({search.FUSION} + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM {x} QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= {search.CANDIDATES}" for x in lists)
    return f"""{name}_t AS (SELECT doc_id, round(sum(s), 12) AS s FROM ({parts}) GROUP BY 1), {name}_m AS (SELECT max(s) AS hi, min(s) AS lo FROM {name}_t),
{name} AS (SELECT row_number() OVER (ORDER BY s DESC, doc_id) AS rank, doc_id, round(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END, 6) AS score FROM {name}_t, {name}_m QUALIFY row_number() OVER (ORDER BY s DESC, doc_id) <= {most})"""


KEYWORDS, QUESTION = "heron thre nation", "where was the thent of heron"
EXPLORE = f"WITH {TOKENS}, {bm25_sql('lex', search.terms(KEYWORDS))}, {vector_sql('vec', KEYWORDS)}, {bm25_sql('ask', search.terms(QUESTION))}"
FIND = f"WITH {TOKENS}, {bm25_sql('lex', search.terms(KEYWORDS))}, {vector_sql('vec', KEYWORDS)}, {fused_sql('best', ['lex', 'vec'], 10)}"

def spots_sql(text: str) -> str:
    """CTEs ending in ``spot(doc_id, line_number, line)`` over the documents of ``best``."""
    words = ", ".join(f"'{w}'" for w in search.terms(text))
    return f", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents WHERE doc_id IN (SELECT doc_id FROM best)), p AS (SELECT doc_id, line_number, line, len(list_intersect(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+'), [{words}])) AS n FROM l), spot AS (SELECT doc_id, line_number::BIGINT AS line_number, line FROM p WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line_number) = 1)"


SPOTS = spots_sql(KEYWORDS)


def docs(spark, d):
    return T(spark, d, "documents").select("doc_id", "text")


@query("r01_explore", EXPLORE + f", {fused_sql('best', ['lex', 'vec', 'ask'], 10)} SELECT * FROM best")
def _(spark, d):
    return search.explore(docs(spark, d), KEYWORDS, QUESTION, "doc_id")


@query("r01_bm25", f"WITH {TOKENS}, {bm25_sql('lex', search.terms(KEYWORDS))} SELECT doc_id, score FROM lex")
def _(spark, d):
    return search.bm25(docs(spark, d), KEYWORDS, "doc_id")


def text_index(spark, d):
    return postings.TextIndex(spark, fresh_dir(spark, "postings"), "doc_id").build(docs(spark, d))


@query("r01_bm25_by_index", f"WITH {TOKENS}, {bm25_sql('lex', search.terms(KEYWORDS))} SELECT doc_id, score FROM lex")
def _(spark, d):
    return text_index(spark, d).bm25(KEYWORDS)


@query("r01_explore_by_index", EXPLORE + f", {fused_sql('best', ['lex', 'vec', 'ask'], 10)} SELECT * FROM best")
def _(spark, d):
    return text_index(spark, d).explore(KEYWORDS, QUESTION)


@query("r01_top_after_upsert", f"WITH tok AS (SELECT doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 7 = 0 THEN text || ' heron thre heron' ELSE text END), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents), {bm25_sql('lex', search.terms(KEYWORDS))} SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM lex QUALIFY rank <= 40")
def _(spark, d):
    """Every seventh document changes after it was indexed."""
    changed = docs(spark, d).filter("doc_id % 7 = 0").select("doc_id", F.concat("text", F.lit(" heron thre heron")).alias("text"))
    return text_index(spark, d).upsert(changed).top(KEYWORDS, 40)


@query("r02_find", FIND + SPOTS + " SELECT rank, doc_id, round(score * 100)::BIGINT AS confidence, line_number FROM best LEFT JOIN spot USING (doc_id)")
def _(spark, d):
    return search.find(docs(spark, d), KEYWORDS, 10, "doc_id")


def _similar_sql(rest: str) -> str:
    """Every row as a candidate of every query, which is each row whose id is divisible by 100."""
    return f"WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE vec_id <> query) {rest}"


TOP = _similar_sql("SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM c QUALIFY rank <= 15")


def _queried(spark, d):
    e = T(spark, d, "embeddings").select("vec_id", "embedding")
    return e.filter("vec_id % 100 = 0"), e


@query("r03_similar", TOP)
def _(spark, d):
    return vectors.top_k(*_queried(spark, d), 15)


@query("r03_similar_by_index", TOP)
def _(spark, d):
    asked, e = _queried(spark, d)
    return vectors.VectorIndex(e, fresh_dir(spark, "vectors")).build().search(asked, 15, exact=True)


@query("r03_index_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, d):
    """Of the nearest cells alone, as many as hold 19 of 20 neighbours of rows drawn at random."""
    asked, e = _queried(spark, d)
    index = vectors.VectorIndex(e, fresh_dir(spark, "vectors")).build()
    found = index.search(asked, 15, probes=index.probes_for(15))
    return vectors.recall(found, vectors.top_k(asked, e, 15)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("j15_seed_similarity", _similar_sql("SELECT query, vec_id, score FROM c WHERE score >= 0.3"))
def _(spark, d):
    asked, e = _queried(spark, d)
    return vectors.VectorIndex(e, fresh_dir(spark, "vectors")).build().within(asked, 0.3)


@query("r04_search_pipeline", FIND + SPOTS + " SELECT doc_id, NULL::VARCHAR AS symbol, line_number AS line_start, line_number AS line_end, substr(trim(line), 1, 160) AS snippet, score FROM best LEFT JOIN spot USING (doc_id)")
def _(spark, d):
    return search.search_pipeline(docs(spark, d), KEYWORDS, 10, "doc_id")


@query("j05_search_joined", FIND + " SELECT b.doc_id, b.rank, d.lang, d.source FROM best b JOIN documents d USING (doc_id)")
def _(spark, d):
    best = search.explore(docs(spark, d), KEYWORDS, "", "doc_id")
    return T(spark, d, "documents").join(F.broadcast(best), "doc_id").select("doc_id", "rank", "lang", "source")  # ten rows


@query("r05_scoped_grep_by_source", LINES + " SELECT source, count(*) AS matching_lines, count(DISTINCT uri) AS files FROM l WHERE lang = 'en' AND source <> 'src3' AND contains(line, 'the') GROUP BY source")
def _(spark, d):
    held = B.documents(spark, d, "doc:///en/**;!**/src3/**").filter(F.contains("text", F.lit("the")))
    lines = B.lines(held, "uri", "text", "source").filter(F.contains("line", F.lit("the")))
    return lines.groupBy("source").agg(F.count("*").alias("matching_lines"), F.count_distinct("uri").alias("files")).orderBy(F.col("matching_lines").desc_nulls_last(), F.col("source").asc_nulls_last())


@query("r05_grep_literal", LINES + " SELECT uri, line_number, line FROM l WHERE contains(lower(line), 'heron') ORDER BY uri, line_number LIMIT 100")
def _(spark, d):
    return search.grep(B.documents(spark, d), "heron")


@query("r06_regex_matches", LINES + " SELECT uri, line_number, line FROM l WHERE regexp_matches(line, '[0-9]{3}-[0-9]{4}') ORDER BY uri, line_number LIMIT 50")
def _(spark, d):
    return search.grep(B.documents(spark, d), "[0-9]{3}-[0-9]{4}", True, 50)


@query("r06_grep_case_sensitive", LINES + " SELECT uri, line_number, line FROM l WHERE lang = 'en' AND contains(line, 'The ') ORDER BY uri, line_number LIMIT 100")
def _(spark, d):
    return search.grep(B.documents(spark, d, "doc:///en/**"), "The ", False, 0, True)


def gram_index(spark, d):
    held = B.documents(spark, d).select("uri", "text")
    return held, grams.GramIndex(spark, fresh_dir(spark, "grams")).build(held)


@query("r05_grep_by_index", LINES + " SELECT uri, line_number, line FROM l WHERE contains(lower(line), 'heron') ORDER BY uri, line_number LIMIT 100")
def _(spark, d):
    held, index = gram_index(spark, d)
    return index.grep(held, "heron")


EITHER, ANY = "(inedtion|her[aeo]n) ?th|[Aa]nd wa", "[0-9]{3}-[0-9]{4}"


@query("r06_regex_by_index", LINES + f" (SELECT 1 AS n, uri, line_number, line FROM l WHERE regexp_matches(line, '{EITHER}') ORDER BY uri, line_number LIMIT 50) UNION ALL (SELECT 2, uri, line_number, line FROM l WHERE regexp_matches(line, '{ANY}') ORDER BY uri, line_number LIMIT 50)")
def _(spark, d):
    """An alternation, and a pattern that requires no trigram."""
    held, index = gram_index(spark, d)
    return index.grep(held, EITHER, True, 50).select(F.lit(1).alias("n"), "*").unionByName(index.grep(held, ANY, True, 50).select(F.lit(2).alias("n"), "*"))


@query("r06_share_compared", "SELECT p AS pattern, count(*) AS texts, count(*) FILTER (WHERE p = 'a' OR len(list_filter(g, lambda x: NOT contains(lower(coalesce(text, '')), x))) = 0) AS compared FROM documents, (VALUES ('heron', ['her', 'ero', 'ron']), ('thent of', ['the', 'hen', 'ent', 'nt ', 't o', ' of']), ('a', [])) v(p, g) GROUP BY p")
def _(spark, d):
    _, index = gram_index(spark, d)
    return index.share("heron").unionByName(index.share("thent of")).unionByName(index.share("a"))


@query(
    "r07_discover_vocabulary",
    f"""WITH {TOKENS}, e AS (SELECT doc_id, unnest(list_distinct(w)) AS term, list_has_any(w, ['inedtion', 'zzzq']) AS hit FROM tok), c AS (SELECT term, count(*) AS df, count(*) FILTER (WHERE hit) AS w FROM e GROUP BY term)
SELECT 'CONFIRMED' AS kind, 'lexical' AS channel, term, df, 1.0::DOUBLE AS score FROM c WHERE term IN ('inedtion', 'zzzq')
UNION ALL (SELECT 'TERM', 'co-occurrence', term, df, round(w / df, 6) FROM c WHERE term NOT IN ('inedtion', 'zzzq') AND w >= 2 ORDER BY 5 DESC, df DESC, term LIMIT 10)
UNION ALL SELECT 'DIAGNOSTIC', 'unknown', t, 0, 0.0 FROM (VALUES ('inedtion'), ('zzzq')) v(t) WHERE t NOT IN (SELECT term FROM c)""",
)
def _(spark, d):
    return search.discover(docs(spark, d), "inedtion zzzq", "doc_id")


@query("r08_fuzzy_terms", f"WITH {TOKENS}, v AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM tok) GROUP BY term) SELECT term, df, levenshtein(term, 'natoin') AS distance FROM v WHERE levenshtein(term, 'natoin') <= 2 AND length(term) BETWEEN 4 AND 8 ORDER BY distance, df DESC, term LIMIT 5")
def _(spark, d):
    return search.fuzzy(search.vocabulary(docs(spark, d), "doc_id"), "natoin")


#: Letters of two bytes told as one of ASCII that no word here has: edits are of letters, and the SQL counts bytes.
TOLD = "translate(term, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&*+')"


@query(
    "r08_near_terms",
    f"WITH {TOKENS}, v AS MATERIALIZED (SELECT term, length(term) AS n, {TOLD} AS told FROM (SELECT DISTINCT unnest(w) AS term FROM tok)), q AS MATERIALIZED (SELECT * FROM v WHERE ('0x' || substr(md5(term), 1, 8))::BIGINT % 100 = 0) SELECT q.term AS query, v.term, levenshtein(q.told, v.told) AS distance FROM q JOIN v ON abs(q.n - v.n) <= 2 AND q.term <> v.term WHERE levenshtein(q.told, v.told) <= 2",
)
def _(spark, d):
    """The words whose id, a hash of theirs, is divisible by 100, against all words."""
    known = settle(search.vocabulary(docs(spark, d), "doc_id").select("term"))
    id_ = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    return search.near_terms(known.filter(id_ % 100 == 0), known)


@query("r08_vector_scores", f"WITH {TOKENS}, {vector_sql('vec', KEYWORDS)} SELECT doc_id, score FROM vec WHERE score > 0.0001")
def _(spark, d):
    return search.vector_scores(docs(spark, d), KEYWORDS, "doc_id").filter("score > 0.0001")


@query("r09_explain", EXPLORE + f", {fused_sql('best', ['lex', 'vec', 'ask'], 10)}, u AS (SELECT rank, doc_id, greatest(ceil(length(text) / 4.0), 1)::BIGINT AS tokens FROM best JOIN documents USING (doc_id)), f AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM u){spots_sql(KEYWORDS + ' ' + QUESTION)} SELECT rank, doc_id, line_number, substr(trim(line), 1, 200) AS quote, tokens FROM f LEFT JOIN spot USING (doc_id) WHERE used <= 2000")
def _(spark, d):
    return search.explain(docs(spark, d), QUESTION, KEYWORDS, 2000, 10, "doc_id")


@query("r10_evidence_trust", "SELECT bool_and(event_type <> 'signup') AS semantic_ready, (count(*) FILTER (WHERE event_type <> 'signup') * 100 // count(*))::BIGINT AS semantic_percent FROM events")
def _(spark, d):
    from ..operators.rollups import engine_status

    return engine_status(registry(spark, d)).select("semantic_ready", "semantic_percent")


@query("j09_terms_in_text", f"WITH {TOKENS}, v(term) AS (VALUES ('heron'), ('the'), ('nowhere'), ('was the')) SELECT doc_id, term FROM tok, v WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || term || ' ')")
def _(spark, d):
    v = spark.createDataFrame([("heron",), ("the",), ("nowhere",), ("was the",)], "term string")
    return joins.contains(docs(spark, d), v).select("doc_id", "term")
