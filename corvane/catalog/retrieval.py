"""Reading, trees, history, blame, changes, lint, coverage and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.address import in_scope
from ..operators import diffs, joins, retrieve
from ..sources import bindings as B
from . import query
from .addresses import LINES
from .relational import ANNOTATIONS, COVER, FILES, severity_floor

T = B.table


@query("g01_read_headlines", rf"WITH {FILES} SELECT uri, 'headline' AS shown_as, substr(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '^[#>*\-\s]+', '')), 1, 120) AS body FROM files WHERE lang = 'fr'")
def _(spark, d):
    return retrieve.read(B.documents(spark, d, "doc:///fr/**"), "doc:///fr/** => headline")


@query("g01_read_auto", f"WITH {FILES}, n AS (SELECT count(*) AS n FROM files WHERE lang = 'es' AND source = 'src1') SELECT uri, CASE WHEN 20000 // n >= 2000 THEN 'content' WHEN 20000 // n >= 500 THEN 'structure' ELSE 'headline' END AS shown_as FROM files, n WHERE lang = 'es' AND source = 'src1'")
def _(spark, d):
    return retrieve.read(B.documents(spark, d, "doc:///es/src1/**"), "doc:///es/src1/**", 20000).select("uri", "shown_as")


@query("g01_read_slices", LINES + " SELECT uri, CASE WHEN lang = 'es' THEN 'lines 1-2' ELSE 'lines 2-2' END AS shown_as, string_agg(line, chr(10) ORDER BY line_number) AS body FROM l WHERE (source = 'src1' AND lang = 'es' AND line_number <= 2) OR (source = 'src2' AND lang = 'de' AND line_number = 2) GROUP BY ALL")
def _(spark, d):
    rows = retrieve.read(B.documents(spark, d), "doc:///es/src1/*#line=1,2;doc:///de/src2/*#line=2")
    return rows.filter("body <> '' or shown_as = 'lines 1-2'")


@query("g02_tree", f"WITH {FILES} SELECT folder, depth, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT unnest(['doc:/', 'doc:///'||lang||'/', 'doc:///'||lang||'/'||source||'/']) AS folder, unnest([1, 2, 3])::BIGINT AS depth, octet_length(encode(text)) AS bytes FROM files) GROUP BY 1, 2")
def _(spark, d):
    return retrieve.tree(B.files(spark, d), "byte_size")


@query("g03_history", "WITH t AS (SELECT DISTINCT l_orderkey AS h FROM lineitem WHERE l_partkey = 7), s AS (SELECT l_orderkey AS h, count(DISTINCT l_partkey) AS files_changed FROM lineitem WHERE l_orderkey IN (SELECT h FROM t) GROUP BY 1) SELECT o_orderkey AS hash, o_custkey AS author, o_orderpriority AS message, files_changed, contains(lower(o_orderpriority), 'urgent')::INT AS score FROM orders JOIN s ON o_orderkey = h ORDER BY score DESC, o_orderdate DESC, hash LIMIT 10")
def _(spark, d):
    rows = retrieve.history(B.commits(spark, d), B.commit_files(spark, d), F.col("file") == 7, 10, "urgent")
    return rows.select("hash", "author", "message", "files_changed", "score")


@query("g04_blame_totals", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, count(*) AS total_lines, count(DISTINCT (doc_id + n) % 7) AS commits FROM l GROUP BY doc_id")
def _(spark, d):
    lines = B.lines(T(spark, d, "documents"), "doc_id").withColumn("hash", (F.col("doc_id") + F.col("line_number")) % 7)
    return retrieve.blame_totals(lines, "doc_id")


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'staged' WHEN 'O' THEN 'unstaged' ELSE 'untracked' END"


def _status(spark, d):
    o, li = T(spark, d, "orders"), T(spark, d, "lineitem")
    gone = F.col("l_returnflag") == "R"
    n = li.groupBy("l_orderkey").agg(F.count_if(~gone).alias("insertions"), F.count_if(gone).alias("deletions"))
    group = F.when(o.o_orderstatus == "F", "staged").when(o.o_orderstatus == "O", "unstaged").otherwise("untracked")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select(o.o_orderkey.alias("entry"), group.alias("changelist"), F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))


@query("g05_changes", f"WITH n AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag <> 'R') AS i, count(*) FILTER (WHERE l_returnflag = 'R') AS d FROM lineitem GROUP BY 1) SELECT {STATUS} AS changelist, count(*) AS entries, sum(coalesce(i, 0))::BIGINT AS insertions, sum(coalesce(d, 0))::BIGINT AS deletions FROM orders LEFT JOIN n ON o_orderkey = k GROUP BY 1")
def _(spark, d):
    return retrieve.changes(_status(spark, d), "changelist", "entry", "insertions", "deletions")


@query("g06_lint", ANNOTATIONS + ", c AS (SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings FROM a WHERE lang = 'en') SELECT target_uri, severity, rule_id, errors, warnings FROM a, c WHERE lang = 'en' AND severity IN ('WARNING', 'ERROR')")
def _(spark, d):
    scope = B.annotations(spark, d).filter(in_scope(F.col("target_uri"), "doc:///en/**"))
    counts = scope.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    return severity_floor(scope, "WARNING").join(F.broadcast(counts)).select("target_uri", "severity", "rule_id", "errors", "warnings")  # one row


@query("g07_coverage_summary", COVER + " SELECT source, count(*) FILTER (WHERE mark = 'covered') AS covered, count(*) FILTER (WHERE mark <> 'unmeasured') AS measured, (count(*) FILTER (WHERE mark = 'covered') * 100 // nullif(count(*) FILTER (WHERE mark <> 'unmeasured'), 0))::BIGINT AS pct FROM c GROUP BY source")
def _(spark, d):
    c = B.coverage(spark, d).groupBy("source").agg(F.count_if(F.col("mark") == "covered").alias("covered"), F.count_if(F.col("mark") != "unmeasured").alias("measured"))
    return c.withColumn("pct", scalars.percent(c.covered, c.measured))


@query("g07_uncovered", COVER + " SELECT uri FROM c WHERE mark = 'uncovered' AND lang = 'en'")
def _(spark, d):
    c = B.coverage(spark, d)
    return c.filter((c.mark == "uncovered") & in_scope(c.uri, "doc:///en/**")).select("uri")


@query("g08_reference_bands", """WITH e AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages) SELECT dst IN (SELECT url FROM pages) AS resolved, starts_with(dst, '#') AS within, count(*) AS links FROM e WHERE starts_with(src, 'https://') GROUP BY 1, 2""")
def _(spark, d):
    known = T(spark, d, "pages").select(F.col("url").alias("uri"))
    edges = B.page_edges(spark, d).filter(in_scope(F.col("src"), "https://**"))
    rows = joins.references(edges, known)
    return rows.groupBy((F.col("band") == "resolved").alias("resolved"), F.col("dst").startswith("#").alias("within")).agg(F.count("*").alias("links"))


SYMBOLS = "s AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<(title|h[1-6])[^>]*>([^<]*)<', 2)) AS title FROM pages)"


@query("g09_file_coverage", f"WITH {SYMBOLS} SELECT url, count(*) AS symbols, count(*) FILTER (WHERE quality = 1) AS covered, count(*) FILTER (WHERE quality = 0) AS uncovered, count(*) FILTER (WHERE quality IS NULL) AS unmeasured FROM s LEFT JOIN labels ON page_id = doc_id GROUP BY url")
def _(spark, d):
    symbols = B.page_symbols(spark, d).withColumnRenamed("page_id", "doc_id")
    marks = T(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("covered"))
    rows = retrieve.coverage(symbols, marks, "doc_id")
    return rows.groupBy("url").agg(F.count("*").alias("symbols"), *(F.count_if(F.col("mark") == m).alias(m) for m in ("covered", "uncovered", "unmeasured")))


@query("g10_zero_result", "SELECT count(*) = 0 AS zero_result FROM documents WHERE lang = 'xx'")
def _(spark, d):
    return retrieve.zero_result(retrieve.read(B.documents(spark, d), "doc:///xx/**"))


@query("s30_git_log", "WITH c AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25) SELECT o_orderkey AS hash, o_custkey AS author, o_orderpriority AS message, l_partkey AS file FROM c JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def _(spark, d):
    return retrieve.log(B.commits(spark, d), B.commit_files(spark, d), 25).select("hash", "author", "message", "file")


@query("s30_git_hotspots", "SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits, count(DISTINCT o_custkey) AS authors FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY commits DESC, authors DESC, file LIMIT 10")
def _(spark, d):
    return retrieve.hotspots(B.commits(spark, d), B.commit_files(spark, d), 10)


@query("s31_git_blame", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_number FROM documents WHERE lang = 'de') SELECT doc_id, line_number, line, o_custkey AS author FROM l JOIN orders ON o_orderkey = (doc_id * 31 + line_number) % 1000 WHERE line_number BETWEEN 2 AND 5")
def _(spark, d):
    lines = retrieve.sliced(B.documents(spark, d, "doc:///de/**"), 2, 5, "doc_id").withColumn("hash", (F.col("doc_id") * 31 + F.col("line_number")) % 1000)
    return lines.join(B.commits(spark, d), "hash").select("doc_id", "line_number", "line", "author")


@query("s32_git_diff", "WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal ELSE floor(c_acctbal) END AS v FROM customer WHERE c_nationkey < 20) SELECT coalesce(a.k, b.k) AS file, CASE WHEN a.k IS NULL THEN 'A' WHEN b.k IS NULL THEN 'D' ELSE 'M' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def _(spark, d):
    c = T(spark, d, "customer")
    before = c.filter("c_acctbal > 0").select(c.c_custkey.alias("file"), c.c_acctbal.alias("v"))
    after = c.filter("c_nationkey < 20").select(c.c_custkey.alias("file"), F.when(c.c_nationkey % 2 == 0, c.c_acctbal).otherwise(F.floor("c_acctbal").cast("double")).alias("v"))
    return retrieve.diff(before, after, "file", "v")


@query("s33_git_patches", "SELECT doc_id, 1::BIGINT AS insertions, 1::BIGINT AS deletions FROM documents WHERE upper(string_split(text, chr(10))[1]) <> string_split(text, chr(10))[1]")
def _(spark, d):
    """Every document against itself with its first line in capitals."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    pairs = docs.withColumn("new", F.concat(F.upper(F.substring_index("text", "\n", 1)), F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 1)")))
    return retrieve.patches(pairs, "doc_id", "text", "new").select("doc_id", "insertions", "deletions")


@query("s33_copies_diff")
def _(spark, d):
    """Every document against the least id of those that share its longest line (of equal ones the first): hunks, insertions and deletions."""
    docs = T(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    size = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    longest = F.element_at(F.split("text", "\n"), F.array_position(size, F.array_max(size)).cast("int"))
    rows = docs.select("doc_id", F.sha2(longest, 256).alias("h"))
    base = rows.groupBy("h").agg(F.min("doc_id").alias("base_id"))
    later = rows.join(base, "h").filter("doc_id <> base_id").select("doc_id", "base_id")
    pairs = later.join(docs, "doc_id").join(docs.select(F.col("doc_id").alias("base_id"), F.col("text").alias("before")), "base_id")
    return diffs.totals(pairs, "doc_id", "before", "text").join(later, "doc_id").select("doc_id", "base_id", "hunks", "insertions", "deletions")


@query("s34_git_status", f"SELECT o_orderkey AS entry, {STATUS} AS changelist FROM orders")
def _(spark, d):
    return _status(spark, d).select("entry", "changelist")


@query("s35_annotations_for", ANNOTATIONS + " SELECT target_uri, severity, rule_id FROM a WHERE lang = 'fr' AND rule_id = 'toxic' AND severity IN ('WARNING', 'ERROR')")
def _(spark, d):
    rows = B.annotations(spark, d).filter(in_scope(F.col("target_uri"), "doc:///fr/**") & (F.col("rule_id") == "toxic"))
    return severity_floor(rows, "WARNING").select("target_uri", "severity", "rule_id")
