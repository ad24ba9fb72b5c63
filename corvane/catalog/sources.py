"""Readers and writers: each query writes files of a known content in the shared folder and reads them back."""

from __future__ import annotations

import io
import subprocess
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import joins, search
from ..operators.lineage import fresh_dir
from ..plans.engine import Engine
from ..sources import bindings as B
from ..sources import code, connectors, mounts, office, readers
from . import query
from .relational import FILES, MOUNT_SQL, registry, values
from .relational import mounts as mount_rows

T = B.table


def put(spark, files: dict[str, str | bytes]) -> str:
    """A folder in the shared store with these files, written by the file system that the store is on."""
    root = fresh_dir(spark, "files")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, body in files.items():
        out = fs.create(path(f"{root}/{name}"), True)
        out.write(bytearray(body.encode() if isinstance(body, str) else body))
        out.close()
    return root


TREE = {"src/a.py": "import os\n", "src/deep/b.go": "package b\n", "README.md": "# Title\n\ntext\n", "data/t.csv": "a,b\n1,2\n", "x.bin": "zz"}
SCAN = [("file:///src/a.py", "a.py", ".py", "code.python", 10), ("file:///src/deep/b.go", "b.go", ".go", "code.go", 10), ("file:///README.md", "README.md", ".md", "markdown.doc", 14), ("file:///data/t.csv", "t.csv", ".csv", "csv.table", 8), ("file:///x.bin", "x.bin", ".bin", None, 2)]


@query("s01_workspace_scan", "WITH " + values("s", "uri, name, extension, kind, byte_size", SCAN) + " SELECT uri, name, extension, kind, byte_size::BIGINT AS byte_size FROM s")
def _(spark, d):
    rows = readers.workspace(spark, put(spark, TREE))
    return rows.select("uri", "name", "extension", scalars.media_type_kind(F.col("mime")).alias("kind"), "byte_size")


@query("s02_import_mounts", "SELECT * FROM (VALUES ('git://team/api/', 'import', 2::BIGINT), ('local:///data/', 'import', 5::BIGINT)) v(mount, kind, file_count)")
def _(spark, d):
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    w.add_folder("git://team/api/", put(spark, {"a.md": "x", "b/c.md": "y"}))
    w.add_folder("local:///data/", put(spark, TREE))
    return w.listing().select("mount", "kind", "file_count")


@query("s03_git_clone", "SELECT 'git://here/src/a.py' AS uri, 'code.python' AS kind, 10::BIGINT AS byte_size UNION ALL SELECT 'git://here/README.md', 'markdown.doc', 14")
def _(spark, d):
    """A repository made on the driver, cloned at a branch that lacks the last commit."""
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    with tempfile.TemporaryDirectory() as origin:
        git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=origin, check=True, capture_output=True)
        git("init", "-q")
        for name in ("src/a.py", "README.md", "data/t.csv"):
            (Path(origin) / name).parent.mkdir(exist_ok=True)
            (Path(origin) / name).write_text(TREE[name])
            git("add", ".")
            if name == "README.md":
                git("commit", "-qm", "one")
                git("branch", "first")
        git("commit", "-qm", "two")
        w.add_git("git://here/", f"file://{origin}", ref="first")
    return w.files("git://here/**").select("uri", scalars.media_type_kind(F.col("mime")).alias("kind"), "byte_size")


@query("k08_workspace_marker", "SELECT * FROM (VALUES (1::BIGINT, 'none', 'a/b'), (2, 'marker', 'a/b'), (3, 'marker above', 'a/b'), (4, 'git root above', '.')) v(step, state, workspace)")
def _(spark, d):
    """Where the workspace of a/b/c or a/b is: made here, found again, found from below, and the git root before any marker."""
    rows = []
    with tempfile.TemporaryDirectory() as top:
        deep = Path(top).resolve() / "a" / "b"
        (deep / "c").mkdir(parents=True)
        for step, state, start in ((1, "none", deep), (2, "marker", deep), (3, "marker above", deep / "c"), (4, "git root above", deep / "c")):
            if step == 4:
                (Path(top) / ".git").mkdir()
            rows.append((step, state, str(mounts.marker(str(start)).relative_to(Path(top).resolve()))))
    return spark.createDataFrame(rows, "step long, state string, workspace string")


@query("s04_import_object_prefix", "WITH " + values("s", "uri", [("s3://bucket/app/" + n,) for n in ("src/a.py", "src/deep/b.go")]) + " SELECT * FROM s")
def _(spark, d):
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    w.add_folder("s3://bucket/app/", put(spark, TREE))
    return w.files("s3://bucket/app/src/**").select("uri")


@query("s05_import_local_directory", "SELECT 'local:///data/README.md' AS uri, 'markdown.doc' AS kind, 14::BIGINT AS byte_size")
def _(spark, d):
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    w.add_folder("local:///data/", put(spark, TREE), "*.md")
    return w.files().select("uri", scalars.media_type_kind(F.col("mime")).alias("kind"), "byte_size")


@query("s06_sarif", f"WITH {FILES} SELECT 'file:///' || doc_id || '.md' AS target_uri, 1::BIGINT AS line, CASE WHEN quality = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity, 'lint' AS source, 'toxic' AS rule_id FROM labels WHERE toxic = 1")
def _(spark, d):
    bad = T(spark, d, "labels").filter("toxic = 1")
    level = F.when(F.col("quality") == 0, "error").otherwise("warning")
    at = F.struct(F.struct(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("uri")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.lit("toxic").alias("ruleId"), level.alias("level"), F.struct(F.lit("toxic text").alias("text")).alias("message"), F.array(at).alias("locations"))
    report = bad.select(F.array(F.struct(F.struct(F.struct(F.lit("lint").alias("name")).alias("driver")).alias("tool"), F.array(result).alias("results"))).alias("runs"))
    root = fresh_dir(spark, "sarif")
    report.write.json(root)
    return readers.sarif_lines(spark, root).select("target_uri", "line", "severity", "source", "rule_id")


@query("s07_connector", "SELECT 'counting:///' || p || '/' || i || '.md' AS uri, 'item ' || i || ' of part ' || p AS text FROM range(3) a(p), range(4) b(i)")
def _(spark, d):
    return connectors.connector(spark, "corvane.sources.connectors:Counting", parts="3", items="4").select("uri", "text")


HELP = [("help:///schema/files", "Files: uri, name, extension, mime, byte_size, token_count, headline"), ("help:///schema/functions", "grep(uri, pattern), similar(uri, seed)"), ("help:///address", "scheme://path#fragment => modifier")]


@query("s08_help_mount", "WITH " + values("h", "uri, text", HELP) + " SELECT uri FROM h WHERE contains(lower(text), 'uri')")
def _(spark, d):
    return search.grep(spark.createDataFrame(HELP, "uri string, text string"), "uri").select("uri")


@query("s09_concept_store", "SELECT * FROM (VALUES ('concept:///rule/One.md', 'first'), ('concept:///Two.md', 'second')) v(capsule, text)")
def _(spark, d):
    return readers.concepts(spark, put(spark, {"rule/One.md": "first", "Two.md": "second", "rule/README.md": "not a note", "rule/x.txt": "nor this"}))


TERMS = [("heron", "a wading bird, \"tall\"", ["herons", "egret"], ["doc:///en/**"], "birds"), ("nation", "a country", [], [], "law")]


@query("s10_vocabulary_store", "SELECT term, meaning, len(aliases) AS aliases, domain FROM (VALUES ('heron', 'a wading bird, \"tall\"', ['herons', 'egret'], 'birds'), ('nation', 'a country', []::VARCHAR[], 'law')) v(term, meaning, aliases, domain)")
def _(spark, d):
    at = fresh_dir(spark, "vocabulary")
    rows = spark.createDataFrame(TERMS, "term string, meaning string, aliases array<string>, scope array<string>, domain string")
    readers.capture_terms(rows, at)
    return readers.vocabulary(spark, at).select("term", "meaning", F.size("aliases").cast("long").alias("aliases"), "domain")


@query("s11_worktree_mounts", f"WITH {MOUNT_SQL} SELECT uri, kind FROM mounts WHERE kind = 'worktree'")
def _(spark, d):
    return mount_rows(spark).filter("kind = 'worktree'").select("uri", "kind")


@query("s12_federated_remote", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def _(spark, d):
    """One call, one remote: the remote is a partition selector, and others are never read."""
    remotes = {str(i): T(spark, d, "customer").filter(F.col("c_nationkey") == i) for i in range(3, 6)}
    return remotes["3"].select("c_custkey")


@query("s13_parse_inline", "SELECT * FROM (VALUES ('csv', 'Auth', 'Security'), ('csv', 'Payment', 'Billing'), ('json', 'Auth', '1'), ('yaml', 'Auth', NULL), ('yaml', 'Pay', 'x: y')) v(form, name, team)")
def _(spark, d):
    forms = {"csv": "name,team\nAuth,Security\nPayment,Billing", "json": '[{"name": "Auth", "team": 1}]', "yaml": "- name: Auth\n  team:\n- name: 'Pay'\n  team: \"x: y\""}
    parts = [readers.parse(spark, t).select(F.lit(f).alias("form"), "name", "team") for f, t in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _csv(spark, d, name: str = "customer") -> str:
    at = fresh_dir(spark, "csv")
    T(spark, d, name).write.option("header", "true").csv(at)
    return at


@query("s14_csv_data", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return readers.csv_data(spark, _csv(spark, d), schema=T(spark, d, "customer").schema)


@query("s14_csv_schema", "SELECT 1::BIGINT AS ordinal, 'n_nationkey' AS name, 'int' AS type, sum(ceil(length(n_nationkey::VARCHAR) / 4.0))::BIGINT AS tokens FROM nation UNION ALL SELECT 2, 'n_name', 'string', sum(ceil(length(n_name) / 4.0))::BIGINT FROM nation UNION ALL SELECT 3, 'n_regionkey', 'int', sum(ceil(length(n_regionkey::VARCHAR) / 4.0))::BIGINT FROM nation")
def _(spark, d):
    return readers.csv_schema(spark, _csv(spark, d, "nation"))


@query("s14_csv_preview", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return readers.csv_preview(spark, _csv(spark, d, "region"))


@query("s14_csv_files", "SELECT 'file:///data/t.csv' AS uri")
def _(spark, d):
    return readers.csv_files(readers.workspace(spark, put(spark, TREE)), "file:///**").select("uri")


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of inline strings and numbers."""
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    safe = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;")
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/s{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = "".join((f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{safe(v)}</t></is></c>') for c, v in enumerate(row) if v is not None)
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i + 1}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _book(spark, d):
    rows = [[r["r_regionkey"], r["r_name"], "$1,250.50" if r["r_regionkey"] == 1 else None] for r in T(spark, d, "region").orderBy("r_regionkey").collect()]  # a table of five rows
    return office.xlsx(spark, put(spark, {"book.xlsx": workbook({"Regions": [["key", "name", "amount"], *rows], "Empty": [["only", "header"]]})}))


@query("s15_xlsx_data", "SELECT r_regionkey::VARCHAR AS key, r_name AS name, CASE WHEN r_regionkey = 1 THEN '$1,250.50' END AS amount FROM region")
def _(spark, d):
    return office.xlsx_data(_book(spark, d), "Regions", ["key", "name", "amount"]).select("key", "name", "amount")


@query("s15_xlsx_sql", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    """A sheet under its header's names, joined in SQL to a stored table."""
    rows = [[r["r_regionkey"], r["r_name"]] for r in T(spark, d, "region").orderBy("r_regionkey").collect()]  # a table of five rows
    e = Engine(spark)
    e.register("nation", T(spark, d, "nation"))
    at = put(spark, {"book.xlsx": workbook({"Regions": [["key", "name"], *rows]})})
    return e.sql(f"SELECT n_name AS name, x.name AS region FROM xlsx_data('{at}', 'Regions') x JOIN nation ON n_regionkey = CAST(x.key AS BIGINT)")


@query("s15_xlsx_sheets", "SELECT * FROM (VALUES ('Regions', 5::BIGINT, 3::BIGINT), ('Empty', 0::BIGINT, 2::BIGINT)) v(sheet, rows, columns)")
def _(spark, d):
    return office.xlsx_sheets(_book(spark, d)).select("sheet", "rows", "columns")


@query("s15_xlsx_schema", "SELECT * FROM (VALUES ('Regions', 1::BIGINT, 'key', 'double'), ('Regions', 2, 'name', 'string'), ('Regions', 3, 'amount', 'string'), ('Empty', 1, 'only', 'string'), ('Empty', 2, 'header', 'string')) v(sheet, ordinal, name, type)")
def _(spark, d):
    return office.xlsx_schema(_book(spark, d)).select("sheet", "ordinal", "name", "type")


@query("s15_xlsx_find_amounts", "SELECT 'Regions' AS sheet, 3::BIGINT AS \"row\", 1250.5::DOUBLE AS amount")
def _(spark, d):
    return office.xlsx_find_amounts(_book(spark, d), 100).select("sheet", "row", "amount")


PDF = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /Outlines 8 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [7 0 R 10 0 R] >> endobj
4 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R >> endobj
5 0 obj << /Length 30 >> stream
BT (Hello) Tj (world) Tj ET
endstream endobj
6 0 obj << /Length 20 >> stream
BT (Second \\(page\\)) Tj ET
endstream endobj
7 0 obj << /Type /Annot /Subtype /Text /Contents (a note) >> endobj
8 0 obj << /Type /Outlines /First 9 0 R >> endobj
9 0 obj << /Title (Chapter two) /Parent 8 0 R /Dest [4 0 R /Fit] >> endobj
10 0 obj << /Type /Annot /Subtype /Widget /FT /Tx /T (name) /V (Ada) /P 3 0 R >> endobj
trailer << /Root 1 0 R >>
"""
PDF_ROWS = [("pdf_page", 1, None, "Hello world"), ("pdf_annotation", 1, "Text", "a note"), ("pdf_page", 2, None, "Second (page)"), ("pdf_form_field", 1, "name", "Ada"), ("pdf_bookmark", 2, "Chapter two", None)]


@query("s16_pdf_parts", "WITH " + values("p", "kind, page, name, text", PDF_ROWS) + " SELECT kind, page::BIGINT AS page, name, text FROM p")
def _(spark, d):
    return office.pdf(spark, put(spark, {"a.pdf": PDF})).select("kind", "page", "name", "text")


@query("s16_pdf_pages", "SELECT 2::BIGINT AS page, 'Second (page)' AS text")
def _(spark, d):
    return office.pdf_pages(office.pdf(spark, put(spark, {"a.pdf": PDF})), 2, 9).select("page", "text")


def document() -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{para("Intro", "Heading1")}{para("plain")}<w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr></w:tbl><w:p><w:drawing><wp:inline xmlns:wp="urn:wp"><wp:docPr name="picture 1"/></wp:inline></w:drawing></w:p>{para("Part", "Heading2")}</w:body></w:document>')
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment>{para("why?")}</w:comment></w:comments>')
    return out.getvalue()


DOCX = [(1, "docx_heading", 1, "Intro"), (2, "docx_table", 0, "a\tb"), (3, "docx_image", 0, "picture 1"), (4, "docx_heading", 2, "Part"), (5, "docx_comment", 0, "why?")]


@query("s17_docx_nodes", "WITH " + values("x", "ordinal, kind, level, text", DOCX) + " SELECT ordinal::BIGINT AS ordinal, kind, level::BIGINT AS level, text FROM x")
def _(spark, d):
    return office.docx(spark, put(spark, {"a.docx": document()})).select("ordinal", "kind", "level", "text")


@query("s16_pdf_sql", "SELECT 'bookmark' AS part, 2::BIGINT AS page, 'Chapter two' AS name UNION ALL SELECT 'field', 1, 'name' UNION ALL SELECT 'annotation', 1, 'Text'")
def _(spark, d):
    at, e = put(spark, {"a.pdf": PDF}), Engine(spark)
    return e.sql(f"SELECT 'bookmark' AS part, page, name FROM pdf_bookmarks('{at}') UNION ALL SELECT 'field', page, name FROM pdf_form_fields('{at}') UNION ALL SELECT 'annotation', page, name FROM pdf_annotations('{at}')")


@query("s17_docx_sql", "SELECT 1::BIGINT AS ordinal, 'Intro' AS text UNION ALL SELECT 4, 'Part' UNION ALL SELECT 5, 'why?'")
def _(spark, d):
    at, e = put(spark, {"a.docx": document()}), Engine(spark)
    return e.sql(f"SELECT ordinal, text FROM docx_heading('{at}') UNION ALL SELECT ordinal, text FROM docx_comment('{at}')")


@query("s18_json_data", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    at = fresh_dir(spark, "json")
    T(spark, d, "events").select("event_id", "event_type", "value").write.json(at)
    return readers.json_data(spark, at).select("event_id", "event_type", "value")


@query("s19_json_files", "SELECT 'event:///' || event_type || '/' || event_id || '.json' AS uri FROM events WHERE event_type IN ('click', 'view')")
def _(spark, d):
    e = T(spark, d, "events")
    uri = F.concat(F.lit("event:///"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".json"))
    return readers.json_files(e.select(uri.alias("uri"), F.lit(readers.MIMES[".json"]).alias("mime")), "event:///{click,view}/*").select("uri")


@query("s20_json_keys", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def _(spark, d):
    return readers.json_keys(T(spark, d, "events"), "event_id", "props", "^k$")


NESTED = '{"a": {"b": [1, "x", {"c": true}], "n": null}, "t": "line\\nend", "e": {}}'


@query("s20_json_keys_nested", "SELECT * FROM (VALUES ('a.b.0', '1'), ('a.b.1', 'x'), ('a.b.2.c', 'true'), ('t', 'line' || chr(10) || 'end')) v(path, value)")
def _(spark, d):
    docs = spark.createDataFrame([(1, NESTED), (2, "not json"), (3, None)], "id long, text string")
    return readers.json_keys(docs, "id").select("path", "value")


SNIPPETS = {
    "csharp": "namespace Acme.Core;\npublic class Store : IStore\n{\n    private readonly int size = 3;\n    public async Task Save(int x) {\n    }\n}\ninterface IStore {}",
    "go": "package a\nimport \"fmt\"\n//go:embed files/*\nvar files embed.FS\nconst Max = 3\ntype Store struct {\n\tName string\n}\nfunc (s *Store) Save(x int) error {\nfunc New() *Store {\nfunc TestNew(t *testing.T) {\nrequire github.com/x/y v1.2.3\nreplace github.com/x/y => ../y\n\tRed Color = iota\n//go:build linux",
    "python": "import os\nfrom a.b import c\nclass Store(Base):\n    async def save(self):\n        pass\ndef make():\n    return 1\n",
    "ruby": "module Acme\nclass Base\nend\nclass Store < Base\n  include Logging\n  has_many :items\n  def save!\n  end\nend",
    "rust": "#[derive(Debug, Clone)]\npub struct Store {\n}\nimpl Saver for Store {\n    fn save(&self) {\n    }\n}\npub fn make() -> Store {",
    "typescript": "import { a } from './b';\nexport class Store {\n  private name: string;\n  save(x: number) {\n  }\n}\nexport function Panel() {\nexport interface Row {",
    "cpp": "#include <vector>\nnamespace acme {\ntemplate <typename T>\nclass Store {\nenum class Kind { A };\nint Store::save(int x) {\nREGISTER_TYPE(Store)",
    "php": "<?php\nclass Store extends Base implements Saver\n{\n    use Logs;\n    private ?string $name;\n    public function save($x)\n    {",
}
DECLARED = {
    "csharp": [("csharp_namespaces", "Acme.Core", None, None, 1), ("csharp_types", "Store", "class", None, 2), ("csharp_members", "size", "int", "Store", 4), ("csharp_members", "Save", "Task", "Store", 5), ("csharp_types", "IStore", "interface", None, 8)],
    "go": [("go_imports", "fmt", None, None, 2), ("go_directives", "embed", "files/*", None, 3), ("go_embeds", "files/*", None, None, 3), ("go_variables", "files", "embed.FS", None, 4), ("go_constants", "Max", None, None, 5), ("go_types", "Store", "struct", None, 6), ("go_fields", "Name", "string", "Store", 7), ("go_methods", "Save", "Store", "Store", 9), ("go_functions", "New", None, None, 10), ("go_functions", "TestNew", None, None, 11), ("go_tests", "TestNew", None, None, 11), ("go_dependencies", "github.com/x/y", "v1.2.3", None, 12), ("go_replaces", "github.com/x/y", "../y", None, 13), ("go_enum_blocks", "Red", None, None, 14), ("go_directives", "build", "linux", None, 15)],
    "python": [("python_imports", "os", None, None, 1), ("python_imports", "a.b", "c", None, 2), ("python_types", "Store", "Base", None, 3), ("python_methods", "save", "async", "Store", 4), ("python_methods", "make", None, None, 6)],
    "ruby": [("ruby_types", "Acme", "module", None, 1), ("ruby_types", "Base", "class", None, 2), ("ruby_types", "Store", "class", None, 4), ("ruby_mixins", "Logging", "include", "Store", 5), ("ruby_associations", "items", "has_many", "Store", 6), ("ruby_methods", "save!", None, "Store", 7)],
    "rust": [("rust_derives", "Debug, Clone", None, None, 1), ("rust_types", "Store", "struct", None, 2), ("rust_impls", "Store", "Saver", None, 4), ("rust_methods", "save", "&self", "Store", 5), ("rust_functions", "make", None, None, 8)],
    "typescript": [("typescript_imports", "./b", "{ a }", None, 1), ("typescript_declarations", "Store", "class", None, 2), ("typescript_members", "name", None, "Store", 3), ("typescript_members", "save", None, "Store", 4), ("typescript_declarations", "Panel", "function", None, 7), ("typescript_components", "Panel", None, None, 7), ("typescript_declarations", "Row", "interface", None, 8)],
    "cpp": [("cpp_includes", "vector", "<", None, 1), ("cpp_namespace_members", "acme", None, None, 2), ("cpp_templates", "typename T", None, None, 3), ("cpp_classes", "Store", "class", None, 4), ("cpp_enums", "Kind", "class", None, 5), ("cpp_functions", "Store::save", None, None, 6), ("cpp_macro_invocations", "REGISTER_TYPE", "Store", "Store", 7)],
    "php": [("php_types", "Store", "class", None, 2), ("php_inheritance", "Base", "extends", None, 2), ("php_trait_usage", "Logs", None, "Store", 4), ("php_members", "name", None, "Store", 5), ("php_members", "save", "function", "Store", 6)],
}


def _declared(lang: str):
    def run(spark, d):
        docs = spark.createDataFrame([(f"file:///x.{lang}", SNIPPETS[lang])], "uri string, text string")
        return code.declarations(docs, lang).select("view", "name", "detail", "container", "line_number")

    return run


for _id, _lang in zip(("s22", "s23", "s24", "s25", "s26", "s27", "s28", "s29"), SNIPPETS, strict=True):
    query(f"{_id}_{_lang}_views", "WITH " + values("c", "view, name, detail, container, line_number", DECLARED[_lang]) + " SELECT view, name, detail::VARCHAR AS detail, container::VARCHAR AS container, line_number::BIGINT AS line_number FROM c")(_declared(_lang))


@query("s25_ruby_mro", "SELECT * FROM (VALUES ('Acme', 'Acme', 0::BIGINT), ('Base', 'Base', 0), ('Store', 'Store', 0), ('Store', 'Base', 1), ('Store', 'Logging', 1)) v(seed, node, depth)")
def _(spark, d):
    docs = spark.createDataFrame([("file:///x.rb", SNIPPETS["ruby"])], "uri string, text string")
    return code.ruby_mro(code.declarations(docs, "ruby"), docs)


@query("a03_types_and_functions", "SELECT * FROM (VALUES ('type', 'csharp', 2::BIGINT), ('type', 'go', 1), ('type', 'python', 1), ('function', 'go', 3), ('function', 'python', 2)) v(relation, lang, n)")
def _(spark, d):
    rows = None
    for lang in ("csharp", "go", "python"):
        docs = spark.createDataFrame([(f"file:///x.{lang}", SNIPPETS[lang])], "uri string, text string")
        one = code.declarations(docs, lang)
        rows = one if rows is None else rows.unionByName(one)
    both = code.types(rows).select(F.lit("type").alias("relation"), "lang").unionByName(code.functions(rows).select(F.lit("function").alias("relation"), "lang"))
    return both.groupBy("relation", "lang").agg(F.count("*").alias("n"))


@query("s42_list_imports", "SELECT 'doc:///' || lang || '/' AS mount, 'import' AS kind, count(*) AS file_count, sum(octet_length(encode(text)))::BIGINT AS byte_size FROM documents WHERE lang IN ('fr', 'es') GROUP BY lang")
def _(spark, d):
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    for lang in ("fr", "es"):
        w.add(f"doc:///{lang}/", B.documents(spark, d, f"doc:///{lang}/**").select("uri", F.lit("text/markdown;kind=markdown.doc").alias("mime"), "text"))
    return w.listing().select("mount", "kind", "file_count", "byte_size")


@query("k05_remove_mount", "SELECT 'doc:///es/' AS mount, count(*) AS file_count FROM documents WHERE lang = 'es'")
def _(spark, d):
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    for lang in ("fr", "es"):
        w.add(f"doc:///{lang}/", B.documents(spark, d, f"doc:///{lang}/**").select("uri", F.lit("text/markdown").alias("mime"), "text"))
    w.remove("doc:///fr/")
    return w.listing().select("mount", "file_count")


@query("k07_reindex", "SELECT source, count(*) AS files, count(*) FILTER (WHERE source = 'src1') AS renewed FROM documents WHERE lang = 'de' GROUP BY source")
def _(spark, d):
    w = mounts.Workspace(spark, fresh_dir(spark, "workspace"))
    docs = B.documents(spark, d, "doc:///de/**").select("uri", F.lit("text/markdown").alias("mime"), "text")
    w.add("doc:///de/", docs)
    w.reindex("doc:///de/src1/**", "doc:///de/", docs.withColumn("text", F.lit("new")))
    return w.files().groupBy(F.split_part("uri", F.lit("/"), F.lit(5)).alias("source")).agg(F.count("*").alias("files"), F.count_if(F.col("text") == "new").alias("renewed"))


@query("k03_capture_concept", "SELECT 'concept:///rules/New.md' AS capsule, 'RULE' AS category UNION ALL SELECT 'concept:///rules/Old.md', 'PATTERN'")
def _(spark, d):
    """Only what passes the checks is appended to the table of notes."""
    from ..operators import memory
    from .memory import CAPSULE

    day = __import__("datetime").date(2024, 1, 1)
    rows = spark.createDataFrame([("concept:///rules/New.md", "x", "RULE", None, ["**"], False, None, day), ("concept:///rules/Old.md", "y", "PATTERN", None, ["**"], False, 3, day), ("bad name", "z", "RULE", None, ["**"], False, None, day)], CAPSULE)
    at = fresh_dir(spark, "capsules")
    good = memory.violations(rows).filter(F.size("problems") == 0).select("capsule")
    rows.join(good, "capsule", "left_semi").write.mode("append").parquet(at)
    return spark.read.parquet(at).select("capsule", "category")


@query("k04_capture_vocabulary", "SELECT alias, EXISTS (SELECT 1 FROM documents WHERE contains(text, alias)) AS redundant FROM (VALUES ('herons'), ('the')) v(alias)")
def _(spark, d):
    """The entry is stored either way; redundant aliases are reported."""
    at = fresh_dir(spark, "vocabulary")
    readers.capture_terms(spark.createDataFrame([("heron", "a bird", ["herons", "the"], [], "birds")], "term string, meaning string, aliases array<string>, scope array<string>, domain string"), at)
    return joins.redundant(readers.vocabulary(spark, at).select(F.explode("aliases").alias("alias")), T(spark, d, "documents"))


@query("s40_registry", "SELECT stage, count(*) AS files, sum(failures)::BIGINT AS failures FROM (SELECT CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'complete' WHEN event_type = 'signup' THEN 'discovered' ELSE 'failed' END AS stage, (event_type = 'error')::INT AS failures FROM events) GROUP BY stage")
def _(spark, d):
    return registry(spark, d).groupBy("stage").agg(F.count("*").alias("files"), F.sum("failures").alias("failures"))


@query("s40_failed_files", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    return registry(spark, d).filter("failures > 0").select("event_id")


@query("s40_file_audit", "SELECT event_id, row_number() OVER w AS ordinal, coalesce(lag(event_type) OVER w || ' -> ', '') || event_type AS diff FROM events WHERE user_id = 1 WINDOW w AS (ORDER BY ts, event_id) QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 20")
def _(spark, d):
    from pyspark.sql import Window as W

    e = T(spark, d, "events").filter("user_id = 1")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    diff = F.concat(F.coalesce(F.concat(F.lag("event_type").over(w), F.lit(" -> ")), F.lit("")), "event_type")
    rows = e.select("event_id", "ts", F.row_number().over(w).cast("long").alias("ordinal"), diff.alias("diff"))
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "ordinal", "diff")


@query("s39_engine_storage")
def _(spark, d):
    """What the engine itself holds: an executor per row, with its memory for storage, used and free, in bytes."""
    return Engine(spark).sql("SELECT executor, most_bytes, free_bytes FROM duckdb_memory()")


