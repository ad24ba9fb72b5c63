import subprocess

import pytest
from corvane.plans import dialect, results
from corvane.plans.engine import Engine, Tool, run_script
from corvane.sources import mounts, readers
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("files", spark.createDataFrame([("doc:///a/1", "alpha beta\nGamma"), ("doc:///a/2", "beta"), ("doc:///b/3", None)], "uri string, text string"))
    e.register("t", spark.createDataFrame([(1, "x", bytearray(b"\x01"), [1, None]), (2, None, None, None)], "n int, s string, b binary, l array<int>"))
    return e


@pytest.mark.parametrize("sql", ["INSERT INTO t VALUES (1)", "select 1; select 2", "", "-- nothing", "SET x = 1", "WITH a AS (SELECT 1) DELETE FROM t", "EXPLAIN DROP TABLE t"])
def test_the_gate_refuses(engine, sql):
    with pytest.raises(dialect.Refused):
        engine.sql(sql)


@pytest.mark.parametrize(
    "sql",
    ["SELECT ';' AS a -- ; DROP TABLE t", "SELECT 'trim(x, y) QUALIFY' AS a", "SELECT 1 AS a /* INSERT */", "(SELECT 1 AS a)", "SELECT replace('a', 'a', 'b') AS a", "SELECT 1 AS a;"],
)
def test_quoted_text_and_comments_are_left_alone(engine, sql):
    assert len(engine.query(sql).rows) == 1
    if "QUALIFY" in sql:
        assert engine.query(sql).rows == [("trim(x, y) QUALIFY",)]


def test_rewrites():
    r = dialect.rewrite
    assert r("SELECT trim(a, '/')") == "SELECT trim(BOTH '/' FROM a)"
    assert r("SELECT a.b::VARCHAR, f(x)::INT8") == "SELECT CAST(a.b AS STRING), CAST(f(x) AS BIGINT)"
    assert r("SELECT j ->> '$.a'") == "SELECT get_json_object(j, '$.a')"
    assert r('SELECT "a b" FROM t') == "SELECT `a b` FROM t"
    assert r("SELECT starts_with(trim(a, 'x'), lower(b))") == "SELECT coalesce(startswith(trim(BOTH 'x' FROM a), lower(b)), false)"
    with pytest.raises(dialect.Refused):
        r("PIVOT t ON a USING sum(b)")
    assert dialect.intent("-- what is it?\nSELECT 1") == "what is it?"


def test_qualify_inside_a_common_table(engine):
    rows = engine.query("WITH a AS (SELECT n, s FROM t QUALIFY row_number() OVER (ORDER BY n DESC) = 1) SELECT n FROM a ORDER BY n LIMIT 5").rows
    assert rows == [("2",)]


def test_cells_and_footer(engine):
    r = engine.query("SELECT * FROM t ORDER BY n")
    assert r.rows == [("1", "x", "AQ==", "[1,null]"), ("2", None, None, None)]
    assert [t for _, t in r.columns] == ["INTEGER", "VARCHAR", "BLOB", "INTEGER[]"]
    lines = list(r.tsv())
    assert lines[0].startswith("[2 rows | ") and lines[1] == "n\ts\tb\tl" and lines[-1] == ""


def test_caps_and_masks(engine):
    r = engine.query("SELECT n FROM t", max_rows=1)
    assert len(r.rows) == 1 and r.total_rows == 2 and r.truncated
    with pytest.raises(ValueError, match="INVALID_ARGUMENT"):
        results.masked(engine.sql("SELECT n FROM t"), ["absent"])


def test_reading_by_address(engine):
    got = {r["uri"]: r["body"] for r in engine.read("doc:///a/* => headline").collect()}
    assert got == {"doc:///a/1": "alpha beta", "doc:///a/2": "beta"}
    assert [r["line"] for r in engine.read("doc:///** => regex: ^G").collect()] == ["Gamma"]
    assert engine.read("doc:///** => similar: doc:///a/2").first()["uri"] == "doc:///a/1"
    assert engine.explore("beta", uri_glob="doc:///a/**").count() >= 1
    with pytest.raises(ValueError):
        engine.read("doc:///** => history")


def test_tools_and_commands(engine):
    engine.add_tool(Tool("double", "twice", ("n",), lambda n: 2 * n))
    assert engine.call("double", '{"n": 4}') == 8
    for name, args in (("absent", "{}"), ("double", '{"m": 1}')):
        with pytest.raises(ValueError, match="INVALID_ARGUMENT"):
            engine.call(name, args)
    assert engine.command("config read spark.sql.session.timeZone") == "UTC" and "help" in engine.command("help")
    with pytest.raises(ValueError):
        engine.command("config set spark.master x")


@pytest.mark.parametrize(
    ("script", "kind"),
    [("1 +", "syntax"), ("import os", "syntax"), ("x = (1).__class__", "syntax"), ("open('x')", "runtime"), ("while True:\n  pass", "syntax"), ("raise 1", "runtime"), ("x = [i for i in range(10**9)]", "timeout")],
)
def test_scripts_are_confined(script, kind):
    done = run_script(script, lambda sql: [], timeout_s=0.5, most=10**12)
    assert done["error"]["kind"] == kind


def test_a_script_returns_prints_and_keeps(engine):
    done = engine.execute("print('hi')\nresult = {'n': [int(r['n']) for r in query('SELECT n FROM t ORDER BY n')], 'd': data['k']}\nartifact('a', 'b')", {"k": 1})
    assert done["result"] == {"n": [1, 2], "d": 1} and done["output"] == "hi\n" and done["artifacts"][0]["size"] == 1 and done["error"] is None


def test_inline_tables(spark):
    rows = readers.parse(spark, '{"a": 1}\n{"a": null, "b": [1, 2]}').collect()
    assert [tuple(r) for r in rows] == [("1", None), (None, "[1,2]")]
    for bad in ("", "- not a mapping"):
        with pytest.raises(ValueError):
            readers.parse(spark, bad)


def test_git_repositories_are_attached(spark, tmp_path):
    origin = tmp_path / "origin"
    origin.mkdir()
    (origin / "a.py").write_text("x = 1\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=origin, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    w = mounts.Workspace(spark, str(tmp_path / "store"))
    w.add_git("git://here/", str(origin), str(tmp_path / "clone"))
    assert [(r["uri"], r["mime"]) for r in w.files("git://here/*.py").collect()] == [("git://here/a.py", readers.MIMES[".py"])]
    assert w.mounts() == ["git://here/"] and w.remove("git://here/") and w.mounts() == [] and w.files().collect() == []


def test_the_marker_is_idempotent(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert mounts.marker(str(deep)) == deep and mounts.marker(str(deep)) == deep
    (tmp_path / ".git").mkdir()
    assert mounts.marker(str(deep)) == tmp_path


def test_a_csv_schema_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    assert [r["tokens"] for r in readers.csv_schema(spark, str(tmp_path / "a.csv")).collect()] == [0, 0]


def test_json_text_keeps_null_fields(spark):
    from corvane.functions.scalars import json_text

    df = spark.range(1).select(json_text(F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))).alias("j"))
    assert df.first()["j"] == '{"a":null,"b":1}'


def test_git_trees_are_copied_to_the_shared_folder_and_removed(spark, tmp_path):
    origin = tmp_path / "origin"
    (origin / "deep").mkdir(parents=True)
    (origin / "deep" / "a.py").write_text("x = 1\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=origin, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    w = mounts.Workspace(spark, str(tmp_path / "store"))
    for _ in range(2):
        w.add_git("git://here/", f"file://{origin}")
        assert [r["uri"] for r in w.files().collect()] == ["git://here/deep/a.py"]
        assert not list((tmp_path / "store" / "clones").iterdir())


def bridge(spark, *servers, **tools):
    from corvane.plans.bridge import Bridge, Tool

    b = Bridge(spark)
    for s in servers:
        b.add_server(s)
    for name, (server, call, reads) in tools.items():
        b.tools[name] = Tool(name, name, ("x",), call, reads, server)
    return b


def test_bridged_calls_are_gated_and_errors_kept_without_secrets(spark):
    from corvane.plans.bridge import Refused, Server

    def fails(x):
        raise RuntimeError(f"denied, token: abc123 and Bearer {x}")

    b = bridge(spark, Server("s", "http"), ask=("s", fails, True), write=("s", lambda x: "done", False), lost=("gone", lambda x: x, True))
    with pytest.raises(RuntimeError, match="abc123"):
        b.call(b.tools["ask"], {"x": "zzz"})
    for name, kind in (("write", "blocked"), ("lost", "unavailable")):
        with pytest.raises(Refused) as e:
            b.call(b.tools[name], {"x": "1"})
        assert e.value.kind == kind
    b.writable.add("write")
    assert b.call(b.tools["write"], {"x": "1"}) == "done"
    rows = b.errors().collect()
    assert [(r["error_category"], r["server"], r["tool"], r["retryable"]) for r in rows] == [("failed", "s", "ask", False), ("blocked", "s", "write", False), ("unavailable", "gone", "lost", True)]
    assert rows[0]["redacted_message"] == "denied, token: *** and Bearer ***" and len({r["correlation_id"] for r in rows}) == 3
    (s,) = b.servers().collect()
    assert (s["tool_count"], s["last_error"]) == (2, rows[1]["redacted_message"])
    assert {r["name"]: (r["callable"], r["macro"]) for r in b.listed().collect()} == {"ask": (True, "mcp_s_ask"), "write": (True, "mcp_s_write"), "lost": (False, "mcp_gone_lost")}


def test_bridged_answers_become_rows(spark):
    from corvane.plans.bridge import Server

    b = bridge(spark, Server("s", "http"), a=("s", lambda x: [{"k": "1"}, {"k": "2", "m`n": [x]}], True), b=("s", lambda x: {"n": x}, True), c=("s", lambda x: [], True))
    assert [tuple(r) for r in b.rows(b.tools["a"], {"x": 5}).collect()] == [("1", None), ("2", "[5]")]
    assert [r["result"] for r in b.rows(b.tools["b"], {"x": 5}).collect()] == ['{"n": 5}']
    assert [r["result"] for r in b.rows(b.tools["c"], {"x": 5}).collect()] == ["[]"]


def test_an_empty_bridge_has_empty_relations(spark):
    from corvane.plans.engine import Engine

    e = Engine(spark)
    for name in ("mcp_servers", "mcp_server_sources", "mcp_bridge_errors", "pragma_database_size"):
        assert e.sql(f"SELECT * FROM {name}()").collect() == []


def test_sheets_with_poor_headers_and_missing_sheets(spark, tmp_path):
    from corvane.catalog.sources import workbook
    from corvane.sources import office

    (tmp_path / "a.xlsx").write_bytes(workbook({"S": [["k", None, "k", "row"], [1, 2, 3, 4]]}))
    cells = office.xlsx(spark, str(tmp_path))
    table = office.xlsx_table(cells, "S")
    assert table.columns == ["uri", "row", "k", "column_2", "k_3", "row_4"] and [tuple(r)[1:] for r in table.collect()] == [(2, "1", "2", "3", "4")]
    with pytest.raises(ValueError, match="no sheet named T"):
        office.xlsx_table(cells, "T")
