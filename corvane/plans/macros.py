"""Table functions of the SQL surface: ``FROM grep_matches('text', 'doc:///**', 50) g JOIN Files f ON f.uri = g.uri``.

A call in a FROM or JOIN with literal arguments is answered by a DataFrame function and stands in the statement as a
view of its result, so the planner sees through it: it prunes, pushes down and joins as if it were written out.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.address import in_scope
from ..operators import joins, retrieve, search
from ..sources import code, office, readers
from . import dialect

if TYPE_CHECKING:
    from .engine import Engine

Macro = Callable[..., DataFrame]


def _value(text: str) -> Any:
    """A literal argument: text with \\n and \\t read as escapes, a number, a truth value, or null."""
    word = text.strip()
    if word.startswith("'"):
        return word[1:-1].replace("''", "'").replace("\\n", "\n").replace("\\t", "\t")
    if word.upper() in ("TRUE", "FALSE", "NULL"):
        return {"TRUE": True, "FALSE": False, "NULL": None}[word.upper()]
    try:
        return ast.literal_eval(word)
    except (ValueError, SyntaxError):
        raise dialect.Refused(f"{word}: arguments of table functions are literals") from None


def expand(engine: Engine, sql: str) -> str:
    """sql with every call of a table function replaced by a view of its result."""
    parts, out, at = dialect.tokens(sql), [], 0
    last = ""
    while at < len(parts):
        token, after = parts[at], at + 1
        while after < len(parts) and parts[after].isspace():
            after += 1
        if token.lower() in engine.macros and last in ("FROM", "JOIN", ",") and after < len(parts) and parts[after] == "(":
            args, end = dialect._arguments(parts, after)
            named = [a.split(":=", 1) for a in args]
            given = [_value(a[0]) for a in named if len(a) == 1]
            rows = engine.macros[token.lower()](*given, **{a[0].strip(): _value(a[1]) for a in named if len(a) == 2})
            name = f"{engine.prefix}_{token.lower()}_{engine.next_number()}"
            rows.createOrReplaceTempView(name)
            engine.views[name] = rows
            out.append(name)
            tail = end + 1
            while tail < len(parts) and parts[tail].isspace():
                tail += 1
            if tail >= len(parts) or not parts[tail].replace("_", "a").isalnum() or parts[tail].upper() in ("WHERE", "JOIN", "LEFT", "INNER", "ORDER", "GROUP", "LIMIT", "ON", "QUALIFY", "UNION", "CROSS", "FULL", "RIGHT", "HAVING"):
                out.append(f" AS {token}")
            at, last = end + 1, ")"
            continue
        if not token.isspace():
            last = token.upper()
        out.append(token)
        at += 1
    return "".join(out)


def standard(engine: Engine) -> dict[str, Macro]:
    """The table functions over the relations that the engine has; a missing relation is an error when it is asked for."""

    def have(name: str) -> DataFrame:
        if name not in engine.views:
            raise ValueError(f"register a relation named {name} first")
        return engine.views[name]

    def scoped(name: str, scope: str, key: str = "uri") -> DataFrame:
        return have(name).filter(in_scope(F.col(key), scope))

    spark = engine.spark
    return {
        "grep_matches": lambda pattern, scope="**", max_results=0: search.grep(scoped("files", scope), pattern, False, max_results),
        "regex_matches": lambda pattern, scope="**", max_results=0: search.grep(scoped("files", scope), pattern, True, max_results),
        "search_pipeline": lambda query, scope="**", k=10: search.search_pipeline(scoped("files", scope), query, k),
        "snippet_glob": lambda pattern, max_results=20: retrieve.snippets(have("files"), pattern, max_results),
        "glob_files": lambda pattern: scoped("files", pattern).select("uri"),
        "parse": lambda text: readers.parse(spark, text),
        "csv_data": lambda path: readers.csv_data(spark, path),
        "csv_schema": lambda path: readers.csv_schema(spark, path),
        "csv_preview": lambda path, n=10: readers.csv_preview(spark, path, n),
        "csv_files": lambda pattern="**": readers.csv_files(have("files"), pattern),
        "json_data": lambda path: readers.json_data(spark, path),
        "json_files": lambda pattern="**": readers.json_files(have("files"), pattern),
        "json_keys": lambda pattern="**", key_pattern=None: readers.json_keys(scoped("files", pattern), "uri", wanted=key_pattern),
        "git_log": lambda scope="**", max_commits=100: retrieve.log(have("commits"), scoped("commit_files", scope, "uri").withColumnRenamed("uri", "file"), max_commits).withColumnRenamed("file", "uri"),
        "git_hotspots": lambda scope="**", max_results=20: retrieve.hotspots(have("commits"), scoped("commit_files", scope, "uri").withColumnRenamed("uri", "file"), max_results).withColumnRenamed("file", "uri"),
        "git_blame": lambda scope, start_line=1, end_line=2**31 - 1: scoped("blame", scope).filter(F.col("line_number").between(start_line, end_line)),
        "git_diff": lambda from_ref, to_ref, scope="**": retrieve.diff(*(scoped("snapshots", scope).filter(F.col("ref") == r) for r in (from_ref, to_ref)), "uri", "digest"),
        "git_status": lambda scope="**": scoped("status", scope),
        "annotations_for": lambda scope="**", kind=None: scoped("annotations", scope, "target_uri").filter(F.lit(True) if kind is None else F.col("rule_id") == kind),
        "file_coverage": lambda scope="**": scoped("coverage", scope).groupBy("uri").agg(*(F.count_if(F.col("mark") == m).alias(m) for m in ("covered", "uncovered", "unmeasured"))),
        "symbol_coverage": lambda uri: scoped("coverage", uri),
        "uncovered_symbols": lambda scope="**": scoped("coverage", scope).filter("mark = 'uncovered'"),
        "indexing_file_audit": lambda uri, n=20: scoped("audit", uri).orderBy(F.col("ordinal").desc()).limit(n),
        "indexing_stuck_candidates": lambda n=20: have("indexing_queue").orderBy(F.col("in_progress_ms").desc_nulls_last(), F.col("waiting_ms").desc_nulls_last()).limit(n),
        "operation_deferrals": lambda id: have("deferrals").filter(F.col("id") == id),
        "mcp_tools": lambda: engine.tools(),
        "mcp_tool_params": lambda: engine.tool_parameters(),
        "mcp_servers": lambda: engine.bridge.servers(),
        "mcp_server_sources": lambda: engine.bridge.sources(),
        "mcp_bridge_errors": lambda: engine.bridge.errors(),
        "git_patches": lambda scope="**", include_unstaged=True: retrieve.patches(scoped("worktree", scope).filter(F.lit(include_unstaged) | F.col("staged")), "uri", "before", "after"),
        "pragma_database_size": lambda: engine.relation_sizes(),
        "duckdb_memory": lambda: engine.memory(),
        "duckdb_temporary_files": lambda: engine.stored().filter("disk_bytes > 0"),
        "csv": lambda path: readers.csv_data(spark, path),
        "xlsx": lambda path: office.xlsx(spark, path),
        "xlsx_sheets": lambda path: office.xlsx_sheets(office.xlsx(spark, path)),
        "xlsx_schema": lambda path: office.xlsx_schema(office.xlsx(spark, path)),
        "xlsx_data": lambda path, sheet: office.xlsx_table(office.xlsx(spark, path), sheet),
        "xlsx_preview": lambda path, sheet, n=10: office.xlsx_table(office.xlsx(spark, path), sheet).orderBy("uri", "row").limit(n),
        "xlsx_files": lambda pattern="**": office.xlsx_files(have("files"), pattern),
        "xlsx_find_amounts": lambda path, least=0.0: office.xlsx_find_amounts(office.xlsx(spark, path), least),
        "docx": lambda path: office.docx(spark, path),
        **{k: (lambda path, k=k: office.docx(spark, path).filter(F.col("kind") == k).drop("kind")) for k in ("docx_heading", "docx_table", "docx_image", "docx_comment")},
        "pdf": lambda path: office.pdf(spark, path),
        "pdf_pages": lambda path, first=1, last=2**31 - 1: office.pdf_pages(office.pdf(spark, path), first, last),
        **{f"{k}s": (lambda path, k=k: office.pdf(spark, path).filter(F.col("kind") == k).drop("kind")) for k in ("pdf_bookmark", "pdf_form_field", "pdf_annotation")},
    }


def index(engine: Engine, files: DataFrame) -> None:
    """Register Files, Types, Functions, the views of each language, node and edge over files (uri, mime, text).

    Views are plans, not copies: a query that asks for one language parses the files of that language.
    """
    kind = scalars.media_type_kind(F.col("mime"))
    name = F.substring_index("uri", "/", -1)
    described = files.select(
        "uri", "mime", "text", name.alias("name"), F.lower(F.regexp_extract("uri", r"(\.[^./]+)$", 1)).alias("extension"), F.octet_length("text").cast("long").alias("byte_size"),
        scalars.token_count(F.col("text")).alias("token_count"), scalars.headline(F.col("text")).alias("headline"), scalars.summary(F.col("text")).alias("summary"), scalars.structure(F.col("text")).alias("structure"),
    )
    engine.register("files", described)
    every = None
    for lang in [*code.PATTERNS, "python"]:
        found = code.declarations(files.filter(kind == f"code.{lang}"), lang)
        for view in code.VIEWS:
            if view.startswith(f"{lang}_") and view != "ruby_mro":
                engine.register(view, found.filter(F.col("view") == view).drop("view"))
        every = found if every is None else every.unionByName(found)
    engine.register("types", code.types(every))
    engine.register("functions", code.functions(every))
    nodes = described.select("uri", F.lit("file").alias("kind"), "name").unionByName(every.select(F.concat("uri", F.lit("#symbol="), "name").alias("uri"), F.col("view").alias("kind"), "name"))
    engine.register("node", nodes)
    holds = every.select(F.col("uri").alias("src"), F.concat("uri", F.lit("#symbol="), "name").alias("dst"), F.lit("contains").alias("kind"))
    links = every.filter(F.col("view").rlike("_imports$|_includes$")).select(F.col("uri").alias("src"), F.col("name").alias("dst"), F.lit("imports").alias("kind"))
    engine.register("edge", holds.unionByName(links))
    engine.register("references", joins.references(links, described.select("uri")))
