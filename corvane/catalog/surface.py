"""The SQL surface: dialect forms, the read-only gate, typed and tabular results, tools and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..plans import dialect, results
from ..plans.bridge import Refused, Server, Tool
from ..plans.engine import Engine
from ..sources import bindings as B
from . import query
from .relational import FILES, MEMORY_SQL, MOUNT_SQL, memory_files, mounts, values

T = B.table


def engine(spark, d) -> Engine:
    e = Engine(spark)
    for name in ("documents", "orders", "lineitem", "customer", "nation", "part", "events"):
        e.register(name, T(spark, d, name))
    e.register("Filesystems", mounts(spark))
    e.register("Files", B.documents(spark, d))
    return e


def _both(name: str, sql: str, oracle: str | None = None) -> None:
    """A statement in the external dialect, run through the engine and, as it is, by the other side."""
    query(name, oracle or sql)(lambda spark, d: engine(spark, d).sql(sql))


_both("p02_columns_by_predicate", "SELECT COLUMNS(c -> c IN ('uri', 'source_uri')) FROM Filesystems WHERE scheme = 'git'", f"WITH {MOUNT_SQL} SELECT uri FROM mounts WHERE scheme = 'git'")
_both("w01_qualify", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 3")
_both("a04_pivot_using", "PIVOT (SELECT lang, source, n_chars FROM documents) ON source IN ('src0', 'src1') USING sum(n_chars) GROUP BY lang", "SELECT lang, sum(n_chars) FILTER (WHERE source = 'src0')::BIGINT AS src0, sum(n_chars) FILTER (WHERE source = 'src1')::BIGINT AS src1 FROM documents GROUP BY lang")
_both("f08_arrow_extract", "SELECT event_id, props ->> '$.k' AS k FROM events")
_both("f08_json_in_where", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INTEGER > 50")
_both("f03_trim_dialect", "SELECT uri, trim(path_prefix, '/') AS t, starts_with(path_prefix, '/data') AS s FROM Filesystems", f"WITH {MOUNT_SQL} SELECT uri, trim(path_prefix, '/') AS t, coalesce(starts_with(path_prefix, '/data'), false) AS s FROM mounts")
_both("p03_from_first", "FROM nation WHERE n_regionkey = 1")
_both("a02_filter_clause", "SELECT lang, count(*) FILTER (WHERE n_chars > 1000) AS long_ones, string_agg(DISTINCT lang, ',') AS l FROM documents GROUP BY lang")
_both("j14_labelled_like", "SELECT CASE WHEN uri LIKE 'doc:///en/%' THEN 'en' ELSE 'other' END AS side, count(*) AS n FROM Files GROUP BY ALL", f"WITH {FILES} SELECT CASE WHEN uri LIKE 'doc:///en/%' THEN 'en' ELSE 'other' END AS side, count(*) AS n FROM files GROUP BY ALL")

@query("j02_prefix_join_dialect", f"WITH {MOUNT_SQL}, {MEMORY_SQL} SELECT m.uri, count(f.uri) FILTER (WHERE f.extension = '.md') AS notes FROM mounts m LEFT JOIN memory_files f ON starts_with(f.uri, 'concept:///' || m.scheme || '/' || trim(m.path_prefix, '/') || '/') GROUP BY m.uri")
def _(spark, d):
    """A prefix join as it is written in the external dialect, renamed columns and all."""
    e = engine(spark, d)
    e.register("Memory", memory_files(spark))
    return e.sql("""WITH m AS (SELECT COLUMNS(c -> c IN ('uri', 'source_uri')), scheme, path_prefix FROM Filesystems)
SELECT m.uri, count(f.uri) FILTER (WHERE f.extension = '.md') AS notes FROM m LEFT JOIN Memory f ON starts_with(f.uri, 'concept:///' || m.scheme || '/' || trim(m.path_prefix, '/') || '/') GROUP BY m.uri""")


@query("s_version_fallback", f"WITH {MOUNT_SQL} SELECT uri AS line FROM mounts WHERE uri LIKE 'git://%'")
def _(spark, d):
    """The newer statement names a column that an older relation lacks; the older one is answered."""
    return engine(spark, d).first_of("SELECT mounted_at, uri AS line FROM Filesystems", "SELECT uri AS line FROM Filesystems WHERE uri LIKE 'git://%'")


GATED = [("SELECT 1", True), ("with a as (select 1) select * from a", True), ("DROP TABLE x", False), ("SELECT 1; SELECT 2", False), ("SELECT ';' AS x -- ; drop", True), ("SET a = 1", False), ("PRAGMA x", False), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False), ("DESCRIBE SELECT 1", True), ("", False), ("EXPLAIN DELETE FROM t", False), ("SELECT 'DROP TABLE x' AS t;", True)]


@query("p15_read_only_gate", "WITH " + values("g", "statement, passes", GATED) + " SELECT * FROM g")
def _(spark, d):
    def passes(sql: str) -> bool:
        try:
            return bool(dialect.gate(sql))
        except dialect.Refused:
            return False

    return spark.createDataFrame([(s, passes(s)) for s, _ in GATED], "statement string, passes boolean")


@query("p14_describe", "SELECT column_name, column_type FROM (DESCRIBE SELECT doc_id, lang, n_chars FROM documents)")
def _(spark, d):
    return engine(spark, d).describe("SELECT doc_id, lang, n_chars FROM documents")


@query("p10_response_mask", "SELECT lang, doc_id FROM documents")
def _(spark, d):
    return results.masked(T(spark, d, "documents"), ["lang", "doc_id"])


@query("k01_tsv_lines", "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS line FROM nation")
def _(spark, d):
    return results.tsv_lines(T(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("k01_tsv_result", "SELECT 0::BIGINT AS n, 'n_name' || chr(9) || 'n_regionkey' AS line UNION ALL SELECT row_number() OVER (ORDER BY n_name), n_name || chr(9) || n_regionkey FROM (SELECT * FROM nation ORDER BY n_name LIMIT 3)")
def _(spark, d):
    lines = list(engine(spark, d).query("SELECT n_name, n_regionkey FROM nation ORDER BY n_name LIMIT 3").tsv())[1:-1]
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


@query("k02_typed_cells", "SELECT doc_id::VARCHAR AS doc_id, lang, n_chars::VARCHAR AS n_chars FROM documents")
def _(spark, d):
    return results.cells(T(spark, d, "documents").select("doc_id", "lang", "n_chars"))


@query("k02_truncation", "SELECT 50::BIGINT AS returned, count(*) AS total_rows, count(*) > 50 AS truncated, 'doc_id BIGINT, lang VARCHAR' AS columns FROM documents")
def _(spark, d):
    r = engine(spark, d).query("SELECT doc_id, lang FROM documents", 50)
    return spark.createDataFrame([(len(r.rows), r.total_rows, r.truncated, ", ".join(f"{n} {t}" for n, t in r.columns))], "returned long, total_rows long, truncated boolean, columns string")


@query("t03_max_rows", "SELECT least(count(*), 200) AS returned, count(*) AS total_rows FROM events")
def _(spark, d):
    r = engine(spark, d).query("SELECT event_id FROM events")
    return spark.createDataFrame([(len(r.rows), r.total_rows)], "returned long, total_rows long")


@query("t04_default_limits", "SELECT count(*) AS n FROM (SELECT vec_id FROM embeddings LIMIT 10)")
def _(spark, d):
    from ..operators import search

    return search.similar(T(spark, d, "embeddings"), F.col("vec_id") == 1, 0).agg(F.count("*").alias("n"))


@query("k06_script_artifacts", "SELECT 'artifact:///langs.txt' AS uri, 'text/plain' AS media_type, 11::BIGINT AS size, 'de,en,es,fr' AS text")
def _(spark, d):
    done = engine(spark, d).execute("rows = query('SELECT DISTINCT lang FROM documents ORDER BY lang')\nartifact('langs.txt', ','.join([r['lang'] for r in rows]))")
    return spark.createDataFrame([(a["uri"], a["media_type"], a["size"], a["text"]) for a in done["artifacts"]], "uri string, media_type string, size long, text string")


SCRIPTS = [("result = sum([int(r['n_nationkey']) for r in query('SELECT n_nationkey FROM nation')])", "300", ""), ("import os", "null", "syntax"), ("result = data[9]", "null", "runtime"), ("x = 0\nfor i in range(10000000):\n    x += 1", "null", "memory"), ("result = data.__class__", "null", "syntax")]


@query("x01_execute", "WITH " + values("s", "n, result, error", [(i, r, e) for i, (_, r, e) in enumerate(SCRIPTS)]) + " SELECT n::BIGINT AS n, result, error FROM s")
def _(spark, d):
    import json

    e = engine(spark, d)
    rows = []
    for i, (script, _r, _e) in enumerate(SCRIPTS):
        done = e.execute(script, [1, 2])
        rows.append((i, json.dumps(done["result"]), (done["error"] or {}).get("kind", "")))
    return spark.createDataFrame(rows, "n long, result string, error string")


@query("x02_table_macro", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def _(spark, d):
    T(spark, d, "orders").createOrReplaceTempView("corvane_orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION corvane_orders_of(who BIGINT) RETURNS TABLE(o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM corvane_orders WHERE o_custkey = who")
    return spark.sql("SELECT * FROM corvane_orders_of(7)")


@query("x05_tool_catalogue", "SELECT * FROM (VALUES ('query', true), ('read', true), ('explore', true), ('execute', true)) v(name, read_only)")
def _(spark, d):
    return engine(spark, d).tools().select("name", "read_only")


@query("s36_tool_parameters", "SELECT * FROM (VALUES ('read', 1::BIGINT, 'address'), ('read', 2, 'token_budget')) v(name, ordinal, parameter)")
def _(spark, d):
    return engine(spark, d).tool_parameters().filter("name = 'read'")


@query("x05_call_by_name", "SELECT n_name FROM nation WHERE n_nationkey < 3")
def _(spark, d):
    r = engine(spark, d).call("query", '{"sql": "SELECT n_name FROM nation WHERE n_nationkey < 3"}')
    return spark.createDataFrame(r.rows, "n_name string")


@query("f09_ask", "SELECT string_agg(line, chr(10) ORDER BY line) AS answer FROM (SELECT n_nationkey || chr(9) || n_name AS line FROM nation ORDER BY line LIMIT 3)")
def _(spark, d):
    e = engine(spark, d)
    rows = T(spark, d, "nation").select("n_nationkey", "n_name")
    lines = results.tsv_lines(rows).orderBy("line").limit(3).selectExpr("split(line, '\\t')[0] AS a", "split(line, '\\t')[1] AS b")
    return spark.createDataFrame([(e.ask(lines, "anything", 100),)], "answer string")


@query("f10_host_meta", "SELECT 'corvane' AS name, NULL::VARCHAR AS none")
def _(spark, d):
    e = engine(spark, d)
    e.meta["name"] = "corvane"
    return spark.createDataFrame([(e.host_meta("name"), e.host_meta("absent"))], "name string, none string")


@query("d17_result_reuse", "SELECT true AS reused, false AS after_change")
def _(spark, d):
    e = engine(spark, d)
    first = e.query("SELECT count(*) AS n FROM nation", cache_seconds=60)
    again = e.query("SELECT  count(*) AS n\nFROM nation", cache_seconds=60)
    e.register("extra", T(spark, d, "region"))
    return spark.createDataFrame([(again is first, e.query("SELECT count(*) AS n FROM nation", cache_seconds=60) is first)], "reused boolean, after_change boolean")


@query("p09_engine_read", f"WITH {FILES}, l AS (SELECT uri, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_number FROM files WHERE lang = 'en') SELECT uri, line_number, line FROM l WHERE contains(lower(line), 'heron') ORDER BY uri, line_number LIMIT 100")
def _(spark, d):
    return engine(spark, d).read("doc:///en/** => grep: heron")




@query("x02_parse_join", "SELECT n_name, team FROM nation JOIN (VALUES (0, 'Security'), (1, 'Billing')) v(k, team) ON n_nationkey = k")
def _(spark, d):
    return engine(spark, d).sql("SELECT n_name, p.team FROM nation JOIN parse('k,team\\n0,Security\\n1,Billing') p ON n_nationkey = p.k::INTEGER")


@query("x02_grep_in_sql", f"WITH {FILES}, l AS (SELECT uri, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files WHERE lang = 'en'), g AS (SELECT * FROM l WHERE contains(lower(line), 'heron') ORDER BY uri, n LIMIT 50) SELECT uri, count(*) AS hits FROM g GROUP BY uri")
def _(spark, d):
    return engine(spark, d).sql("SELECT g.uri, count(*) AS hits FROM grep_matches('heron', 'doc:///en/**', 50) g JOIN Files f ON f.uri = g.uri GROUP BY g.uri")


@query("x02_co_change_in_sql", "WITH l AS (SELECT l_partkey::VARCHAR AS uri, l_orderkey AS hash FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) ON l_orderkey = o_orderkey) SELECT a.uri AS a, b.uri AS b, count(*) AS together FROM l a JOIN l b ON a.hash = b.hash AND a.uri < b.uri GROUP BY ALL")
def _(spark, d):
    e = engine(spark, d)
    e.register("commits", B.commits(spark, d))
    e.register("commit_files", B.commit_files(spark, d).select("hash", F.col("file").cast("string").alias("uri")))
    return e.sql("SELECT a.uri AS a, b.uri AS b, count(*) AS together FROM git_log('**', 200) a JOIN git_log('**', 200) b ON a.hash = b.hash AND a.uri < b.uri GROUP BY ALL")


SOURCES = [("file:///a.py", "text/x-python;kind=code.python", "import os\nclass A(B):\n    def run(self):\n        pass\n"), ("file:///b.go", "text/x-go;kind=code.go", "package b\nimport \"fmt\"\ntype T struct {\n}\nfunc New() {"), ("file:///c.md", "text/markdown;kind=markdown.doc", "# Title\n\nSome text. More.")]


@query("a02_indexed_views", "SELECT * FROM (VALUES ('edge', 8::BIGINT), ('files', 3), ('functions', 2), ('go_types', 1), ('node', 9), ('python_imports', 1), ('types', 2)) v(relation, n)")
def _(spark, d):
    e = Engine(spark)
    e.index(spark.createDataFrame(SOURCES, "uri string, mime string, text string"))
    names = ("edge", "files", "functions", "go_types", "node", "python_imports", "types")
    return e.sql(" UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n FROM {n}" for n in names))


@query("j01_hits_joined_with_types", "SELECT 'file:///a.py' AS uri, 'A' AS name")
def _(spark, d):
    e = Engine(spark)
    e.index(spark.createDataFrame(SOURCES, "uri string, mime string, text string"))
    return e.sql("SELECT s.uri, t.name FROM search_pipeline('class run', 'file:///*.py', 10) s JOIN Types t ON t.uri = s.uri")


@query("m05_list_vocabulary", "SELECT * FROM (VALUES ('heron', 'a bird', 'birds'), ('nation', 'a country', 'law')) v(term, meaning, domain)")
def _(spark, d):
    from ..operators.lineage import fresh_dir
    from ..sources import readers

    at, kind = fresh_dir(spark, "vocabulary"), "term string, meaning string, aliases array<string>, scope array<string>, domain string"
    for term, meaning, domain in (("heron", "a bird", "birds"), ("nation", "a country", "law")):
        readers.capture_terms(spark.createDataFrame([(term, meaning, [], [], domain)], kind), at)
    return readers.vocabulary(spark, at).select("term", "meaning", "domain")


@query("s40_write_phase_stats", "SELECT l_returnflag AS write_kind, l_linestatus AS phase, count(*) AS operations, round(avg(l_quantity), 6) AS avg_ms, max(l_quantity) AS max_ms FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    rows = T(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("write_kind"), F.col("l_linestatus").alias("phase"))
    return rows.agg(F.count("*").alias("operations"), F.round(F.avg("l_quantity"), 6).alias("avg_ms"), F.max("l_quantity").alias("max_ms"))


@query("s40_operations", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'deferred' END AS state FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("deferred")
    rows = T(spark, d, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"), "o_orderdate")
    return rows.orderBy(F.col("o_orderdate").desc_nulls_last(), "id").limit(20).select("id", "state")


@query("s40_coverage_functions", "SELECT count(*) FILTER (WHERE quality = 0) AS uncovered, count(*) AS files FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en'")
def _(spark, d):
    e = engine(spark, d)
    e.register("coverage", B.coverage(spark, d))
    return e.sql("SELECT (SELECT count(*) FROM uncovered_symbols('doc:///en/**')) AS uncovered, (SELECT count(*) FROM file_coverage('doc:///en/**')) AS files")


def bridged(spark, d) -> Engine:
    """An engine with tools of three servers: one connected, one whose credential ran out, one shadowed and one off."""
    e = engine(spark, d)
    for server in (
        Server("orders", "stdio", "project"),
        Server("orders", "http", "user"),
        Server("tickets", "http", "project", state="needsAuth", auth_status="expired", auth_action="sign in again"),
        Server("wiki", "http", "user", enabled=False),
    ):
        e.add_server(server)
    e.add_tool(Tool("of_customer", "orders of a customer", ("who",), lambda who: T(spark, d, "orders").filter(F.col("o_custkey") == who).select("o_orderkey", "o_totalprice"), server="orders"))
    e.add_tool(Tool("drop", "removes an order", ("key",), lambda key: None, read_only=False, server="orders"))
    e.add_tool(Tool("find", "tickets", ("text",), lambda text: [], server="tickets"))
    return e


@query("s36_tool_macro", "SELECT n_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_custkey = 7 GROUP BY n_name")
def _(spark, d):
    return bridged(spark, d).sql("SELECT n_name, count(*) AS n FROM mcp_orders_of_customer(7) m JOIN orders o ON o.o_orderkey = m.o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")


SERVERS = [("orders", "stdio", "connected", "none", None, 2), ("tickets", "http", "needsAuth", "expired", "sign in again", 1)]
FOUND = [("orders", "project", "active"), ("orders", "user", "shadowed"), ("tickets", "project", "active"), ("wiki", "user", "disabled")]
FAILED = [("blocked", "orders", "drop", False), ("unavailable", "tickets", "find", True)]


@query("s36_servers", "WITH " + values("s", "name, transport, state, auth_status, auth_action, tool_count", SERVERS) + " SELECT name, transport, state, auth_status, auth_action, tool_count::BIGINT AS tool_count FROM s")
def _(spark, d):
    return bridged(spark, d).sql("SELECT name, transport, state, auth_status, auth_action, tool_count FROM mcp_servers()")


@query("s36_server_sources", "WITH " + values("s", "name, source, status", FOUND) + " SELECT * FROM s")
def _(spark, d):
    return bridged(spark, d).sql("SELECT name, source, status FROM mcp_server_sources()")


@query("s36_bridge_errors", "WITH " + values("s", "error_category, server, tool, retryable", FAILED) + " SELECT * FROM s")
def _(spark, d):
    e = bridged(spark, d)
    for name, given in (("drop", '{"key": 1}'), ("find", '{"text": "x"}')):
        try:
            e.call(name, given)
        except Refused:
            pass
    return e.sql("SELECT error_category, server, tool, retryable FROM mcp_bridge_errors()")


@query("s33_git_patches_sql", "SELECT doc_id, 1::BIGINT AS insertions, 0::BIGINT AS deletions FROM documents WHERE lang = 'en' AND source = 'src0'")
def _(spark, d):
    """Staged changes in a scope: a line added to every document of one source, the others not yet staged."""
    e = engine(spark, d)
    docs = T(spark, d, "documents")
    uri = F.concat(F.lit("doc:///"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    e.register("worktree", docs.select(uri.alias("uri"), F.col("text").alias("before"), F.concat_ws("\n", F.lit("added"), "text").alias("after"), (F.col("source") == "src0").alias("staged")))
    return e.sql("SELECT substring_index(uri, '/', -1)::BIGINT AS doc_id, insertions, deletions FROM git_patches('doc:///en/**', false)")


RELATIONS = ("documents", "orders", "lineitem", "customer", "nation", "part", "events")


@query("s39_relation_sizes", " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in RELATIONS))
def _(spark, d):
    return engine(spark, d).sql(f"SELECT relation, row_count AS n FROM pragma_database_size() WHERE relation IN {RELATIONS}")
