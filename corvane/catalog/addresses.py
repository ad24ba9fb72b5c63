"""The address grammar: globs, exclusions, slices, literals and suppression of what an address does not name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address as A
from ..operators import retrieve
from ..sources import bindings as B
from . import query
from .relational import FILES, values

GLOBS = [
    ("doc:///en/**", "doc:///en/src0/1", True),
    ("doc:///en/*", "doc:///en/src0/1", False),
    ("doc:///*/src0/*", "doc:///en/src0/1", True),
    ("doc:///**/1", "doc:///en/src0/1", True),
    ("doc:///**/1", "doc:///1", True),
    ("doc:///en/src?/1", "doc:///en/src0/1", True),
    ("doc:///en/src?/1", "doc:///en/src10/1", False),
    ("doc:///{en,fr}/src0/1", "doc:///fr/src0/1", True),
    ("doc:///{en,fr}/src0/1", "doc:///de/src0/1", False),
    ("doc:///en/src[0-3]/1", "doc:///en/src2/1", True),
    ("doc:///en/src[!0-3]/1", "doc:///en/src2/1", False),
    ("doc:///en/src0/1;doc:///fr/**", "doc:///fr/x/9", True),
    ("doc:///**;!**/src0/**", "doc:///en/src0/1", False),
    ("doc:///**;!**/src0/**", "doc:///en/src1/1", True),
    ("!**/src0/**", "doc:///en/src1/1", True),
    ("routes/%5Bid%5D/view", "routes/[id]/view", True),
    ("routes/%2A/view", "routes/x/view", False),
    ("a.b", "axb", False),
    ("100%.md", "100%.md", True),
]


@query("p05_glob_cases", "WITH " + values("g", "n, pattern, uri, expected", [(i, *g) for i, g in enumerate(GLOBS)]) + " SELECT n::BIGINT AS n, expected AS hit FROM g")
def _(spark, d):
    rows = None
    for i, (pattern, uri, _hit) in enumerate(GLOBS):
        one = spark.range(1).select(F.lit(i).cast("long").alias("n"), A.in_scope(F.lit(uri), pattern).alias("hit"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("p05_glob_scope", f"WITH {FILES} SELECT uri FROM files WHERE regexp_matches(uri, '^doc:///(en|fr)/src[0-4]/[^/]*$') AND NOT regexp_matches(uri, '^.*/src3/.*$')")
def _(spark, d):
    return B.documents(spark, d, "doc:///{en,fr}/src[0-4]/*;!**/src3/**").select("uri")


@query("p05_glob_column_patterns", "WITH " + values("g", "n, pattern, uri, expected", [(i, *g) for i, g in enumerate(GLOBS) if not set("{[") & set(g[0])]) + " SELECT n::BIGINT AS n, expected AS hit FROM g")
def _(spark, d):
    rows = [(i, p, u) for i, (p, u, _) in enumerate(GLOBS) if not set("{[") & set(p)]
    g = spark.createDataFrame(rows, "n long, pattern string, uri string")
    return g.select("n", A.matches_glob(g.uri, g.pattern).alias("hit"))


LITERALS = [("routes/[id]/view.tsx", "routes/%5Bid]/view.tsx"), ("what?/{now};*all* 100%.md", "what%3F/%7Bnow}%3B%2Aall%2A 100%.md"), ("plain", "plain"), (None, None)]


@query("p06_literal_target", "WITH " + values("l", "path, target", LITERALS) + " SELECT * FROM l")
def _(spark, d):
    p = spark.createDataFrame([(a,) for a, _ in LITERALS], "path string")
    return p.select("path", A.literal_target(p.path).alias("target"))


STRIPS = [("file:///a.cs#symbol=Foo => structure", "file:///a.cs"), ("file:///a => grep: x#y", "file:///a"), (" file:///b#line=1,2", "file:///b"), ("c", "c")]


@query("p07_strip_addressing", "WITH " + values("s", "address, target", STRIPS) + " SELECT * FROM s")
def _(spark, d):
    p = spark.createDataFrame([(a,) for a, _ in STRIPS], "address string")
    return p.select("address", A.strip_addressing(p.address).alias("target"))


LINES = f"WITH {FILES}, l AS (SELECT uri, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_number FROM files)"


@query("p08_line_slice", LINES + " SELECT uri, line_number, line FROM l WHERE line_number BETWEEN 2 AND 4")
def _(spark, d):
    return retrieve.sliced(B.documents(spark, d), 2, 4)


SYMBOLS = ["Store", "Store.Save", "Store.Save.inner", "Other.Save", "StoreX.Run", "CheckToken"]
WANTED = {"Store.*": ["Store.Save"], "Store.**": ["Store.Save", "Store.Save.inner"], "Save": ["Store.Save", "Other.Save"], "*Token": ["CheckToken"], "Store": ["Store"]}


@query("p08_symbol_slice", "WITH " + values("s", "wanted, name", [(w, n) for w, names in WANTED.items() for n in names]) + " SELECT * FROM s")
def _(spark, d):
    s = spark.createDataFrame([(x,) for x in SYMBOLS], "name string")
    rows = None
    for wanted in WANTED:
        one = retrieve.symbols_in(s, wanted).select(F.lit(wanted).alias("wanted"), "name")
        rows = one if rows is None else rows.unionByName(one)
    return rows


ADDRESSES = [
    ("file:///a.cs#symbol=Foo;file:///b.cs#line=3,9 => structure", "file:///a.cs|Foo||structure|;file:///b.cs||3-9|structure|"),
    ("file:///src/**;!**/tests/** => grep: needle", "file:///src/**;!**/tests/**|||grep|needle"),
    ("doc:///x#page=2", "doc:///x||||"),
]


@query("p09_modifier_dispatch", "WITH " + values("a", "address, parsed", ADDRESSES) + " SELECT * FROM a")
def _(spark, d):
    told = lambda x: "|".join([x.pattern, x.symbol or "", f"{x.lines[0]}-{x.lines[1]}" if x.lines else "", x.modifier or "", x.argument or ""])
    return spark.createDataFrame([(a, ";".join(map(told, A.parse_address(a)))) for a, _ in ADDRESSES], "address string, parsed string")


@query("p11_evidence_scope", f"WITH {FILES} SELECT uri FROM files WHERE starts_with(uri, 'doc:///en/') AND regexp_matches(uri, '^doc:///[^/]*/src1/.*$')")
def _(spark, d):
    return B.documents(spark, d, "doc:///en/**").filter(A.in_scope(F.col("uri"), "doc:///*/src1/**")).select("uri")


@query("p13_smart_case", "SELECT doc_id, contains(lower(text), 'the') AS loose, contains(text, 'The') AS exact, regexp_matches(text, 'Th[ae]') AS regex FROM documents")
def _(spark, d):
    from ..operators.search import line_match

    t = F.col("text")
    return B.table(spark, d, "documents").select("doc_id", line_match("the")(t).alias("loose"), line_match("The")(t).alias("exact"), line_match("Th[ae]", True)(t).alias("regex"))


@query("p16_prefix_cap", "SELECT doc_id, substr(text, 1, 500) AS head FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("head"))


@query("u01_address_union", LINES + " SELECT uri, line_number, line FROM l WHERE (uri LIKE 'doc:///en/src1/%' AND line_number = 1) OR (uri LIKE 'doc:///fr/%' AND line_number <= 2)")
def _(spark, d):
    a = retrieve.sliced(B.documents(spark, d, "doc:///en/src1/**"), 1, 1)
    return a.unionByName(retrieve.sliced(B.documents(spark, d, "doc:///fr/**"), 1, 2)).dropDuplicates(["uri", "line_number"])


@query("u02_address_difference", f"WITH {FILES} SELECT uri FROM files EXCEPT SELECT uri FROM files WHERE lang IN ('en', 'de')")
def _(spark, d):
    return B.documents(spark, d, "doc:///**;!doc:///en/**;!doc:///de/**").select("uri")


@query("s21_glob_files", f"WITH {FILES} SELECT uri, doc_id || '.md' AS name, ceil(length(text) / 4.0)::BIGINT AS token_count FROM files WHERE regexp_matches(uri, '^doc:///[^/]*/src1[0-9]/[^/]*$')")
def _(spark, d):
    return B.files(spark, d, "doc:///*/src1[0-9]/*").select("uri", "name", "token_count")


@query("s41_snippet_glob", f"WITH {FILES} SELECT uri, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], chr(10)) AS snippet FROM files WHERE uri LIKE 'doc:///es/%' ORDER BY uri LIMIT 20")
def _(spark, d):
    return retrieve.snippets(B.documents(spark, d, "doc:///es/**"), "doc:///es/**", 20)
