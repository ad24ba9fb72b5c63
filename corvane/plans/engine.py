"""The engine: views, read-only queries in the external dialect, addresses, tools and small scripts over them."""

from __future__ import annotations

import ast
import contextlib
import functools
import io
import json
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.address import in_scope, parse_address
from ..operators import joins, ranking, retrieve, search
from . import dialect, macros, results
from .bridge import Bridge, Server, Tool

#: Session settings that may be read and set by name.
SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.session.timeZone")


class Engine:
    """Relations by name, and the operators over them. Nothing it offers writes to a relation."""

    def __init__(self, spark: SparkSession, prefix: str = "corvane_v"):
        self.spark, self.prefix = spark, prefix
        self.views: dict[str, DataFrame] = {}
        self.meta: dict[str, str] = {}
        self.version = 0
        self.macros: dict[str, macros.Macro] = macros.standard(self)
        self._number = 0
        self._cache: dict[tuple, tuple[float, results.Result]] = {}
        self.bridge = Bridge(spark)
        self._tools = self.bridge.tools
        scalars.register(spark)
        for tool in (
            Tool("query", "one reading SQL statement", ("sql", "max_rows", "cache_seconds"), self.query),
            Tool("read", "what an address names", ("address", "token_budget"), self.read),
            Tool("explore", "ranked matches of keywords", ("keywords", "question", "uri_glob", "breadth"), self.explore),
            Tool("execute", "a small script over query()", ("script", "data", "timeout_s"), self.execute),
        ):
            self.add_tool(tool)

    # -- relations and SQL --------------------------------------------------------------------------------------------

    def register(self, name: str, rows: DataFrame) -> None:
        rows.createOrReplaceTempView(name)
        self.views[name.lower()] = rows
        self.version += 1

    def next_number(self) -> int:
        self._number += 1
        return self._number

    def index(self, files: DataFrame) -> None:
        """Files, symbols and edges as relations; see macros.index()."""
        macros.index(self, files)

    def sql(self, statement: str) -> DataFrame:
        """A statement that passes the gate, as a DataFrame. Errors of the analyser come out as they are."""
        text = macros.expand(self, dialect.gate(statement))
        used = [t.lower() for t in dialect.tokens(text)]
        known = list(dict.fromkeys(c for v, rows in self.views.items() if v in used for c in rows.columns))
        return self.spark.sql(dialect.rewrite(text, known))

    def query(self, sql: str, max_rows: int = 0, cache_seconds: float = 0, response_mask: Sequence[str] = ()) -> results.Result:
        """Typed rows, capped, with the true count. Within cache_seconds the same text over the same data is not run again."""
        key = (" ".join(t for t in dialect.tokens(sql) if not t.isspace()), max_rows, tuple(response_mask), self.version)
        held = self._cache.get(key)
        if held and cache_seconds and time.monotonic() - held[0] <= cache_seconds:
            return held[1]
        out = results.typed(results.masked(self.sql(sql), list(response_mask)), max_rows)
        if cache_seconds:
            self._cache[key] = (time.monotonic(), out)
        return out

    def first_of(self, *statements: str) -> DataFrame:
        """The first statement that the present relations can answer: newer forms first, older ones after."""
        last: Exception | None = None
        for statement in statements:
            try:
                return self.sql(statement)
            except Exception as error:  # analysis errors have no common class across modes
                last = error
        raise last or ValueError("no statement")

    def describe(self, sql: str) -> DataFrame:
        """column_name, column_type of a statement, which is analysed and not run."""
        schema = self.sql(sql).schema
        return self.spark.createDataFrame([(f.name, results.type_name(f.dataType)) for f in schema], "column_name string, column_type string")

    # -- addresses ----------------------------------------------------------------------------------------------------

    def _files(self) -> DataFrame:
        if "files" not in self.views:
            raise ValueError("register a relation named files with uri and text first")
        return self.views["files"]

    def read(self, address: str, token_budget: int = 0) -> DataFrame:
        """An address with its modifier, as the operator that the modifier names."""
        one = parse_address(address)[0]
        files, argument = self._files(), one.argument or ""
        scope = files.filter(in_scope(F.col("uri"), one.pattern))
        if one.modifier in (None, *retrieve.LEVELS):
            return retrieve.read(files, address, token_budget)
        if one.modifier == "tree":
            return retrieve.tree(scope, depth={"folders": 3}.get(argument, 0))
        if one.modifier in ("grep", "regex"):
            return search.grep(scope, argument, one.modifier == "regex")
        if one.modifier == "find":
            return search.find(ranking.at_most(scope, 96), argument)
        if one.modifier == "question":
            return search.explain(scope, argument, argument, token_budget or 5_000)
        if one.modifier == "similar":
            return self._similar(files, scope, argument)
        held = {"history": "history", "blame": "blame", "changes": "changes", "lint": "annotations", "coverage": "coverage", "references": "edges", "concepts": "concepts"}[one.modifier]
        if held not in self.views:
            raise ValueError(f"register a relation named {held} first")
        rows = self.views[held]
        key = next(c for c in ("uri", "target_uri", "src") if c in rows.columns)
        return rows.filter(in_scope(F.col(key), one.pattern))

    @staticmethod
    def _similar(files: DataFrame, scope: DataFrame, seed: str) -> DataFrame:
        """By the words of the seed's own text; a slice of a file stands for the file."""
        wanted = seed.split("#")[0]
        text = files.filter(F.col("uri") == wanted).select("text").limit(1).collect()
        if not text:
            raise ValueError(f"nothing is at {wanted}")
        return search.fused([search.vector_scores(scope.filter(F.col("uri") != wanted), text[0]["text"] or "", "uri")], "uri", 10)

    def explore(self, keywords: str, question: str = "", uri_glob: str = "**", breadth: int = 0) -> DataFrame:
        scope = self._files().filter(in_scope(F.col("uri"), uri_glob))
        best = search.explore(scope, keywords, question)
        return ranking.breadth(best.drop("rank"), "score", "uri", breadth)

    # -- what the engine holds ----------------------------------------------------------------------------------------

    def memory(self) -> DataFrame:
        """executor, most_bytes, free_bytes: the memory for storage of each executor."""
        rows, it = [], self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().iterator()
        while it.hasNext():
            entry = it.next()
            rows.append((entry._1(), int(entry._2()._1()), int(entry._2()._2())))
        return self.spark.createDataFrame(rows, "executor string, most_bytes long, free_bytes long")

    def stored(self) -> DataFrame:
        """id, name, partitions, memory_bytes, disk_bytes: what is kept of results, in memory and in files."""
        info = self.spark.sparkContext._jsc.sc().getRDDStorageInfo()
        rows = [(i.id(), i.name(), i.numCachedPartitions(), i.memSize(), i.diskSize()) for i in info]
        return self.spark.createDataFrame(rows, "id long, name string, partitions long, memory_bytes long, disk_bytes long")

    def relation_sizes(self) -> DataFrame:
        """relation, row_count of each registered relation, views of table functions left out."""
        counts = [df.agg(F.lit(n).alias("relation"), F.count("*").alias("row_count")) for n, df in self.views.items() if not n.startswith(f"{self.prefix}_")]
        return functools.reduce(DataFrame.unionByName, counts, self.spark.createDataFrame([], "relation string, row_count long"))

    # -- tools and scripts --------------------------------------------------------------------------------------------

    def add_tool(self, tool: Tool) -> None:
        """Offer a tool by name; one of another server is a table function mcp_SERVER_TOOL as well."""
        self._tools[tool.name] = tool
        if name := self.bridge.macro(tool):
            self.macros[name] = lambda *a, **k: self.bridge.rows(tool, dict(zip(tool.parameters, a, strict=False)) | k)

    def add_server(self, server: Server) -> None:
        self.bridge.add_server(server)

    def tools(self) -> DataFrame:
        """name, about, parameters, read_only, server, macro, callable, reason."""
        return self.bridge.listed()

    def tool_parameters(self) -> DataFrame:
        """name, ordinal, parameter."""
        rows = [(t.name, i + 1, p) for t in self._tools.values() for i, p in enumerate(t.parameters)]
        return self.spark.createDataFrame(rows, "name string, ordinal long, parameter string")

    def call(self, name: str, arguments: str = "{}") -> Any:
        """A tool by name with JSON arguments; an unknown tool or argument is an argument error."""
        if name not in self._tools:
            raise ValueError(f"INVALID_ARGUMENT: unknown tool {name}; known: {', '.join(sorted(self._tools))}")
        given, tool = json.loads(arguments or "{}"), self._tools[name]
        if extra := sorted(set(given) - set(tool.parameters)):
            raise ValueError(f"INVALID_ARGUMENT: {name} takes {', '.join(tool.parameters)}, not {', '.join(extra)}")
        return self.bridge.call(tool, given)

    def execute(self, script: str, data: Any = None, timeout_s: float = 30.0) -> dict[str, Any]:
        """A script over query(); see run_script()."""

        def rows(sql: str) -> list[dict]:
            got = self.query(sql)
            return [dict(zip((n for n, _ in got.columns), row, strict=True)) for row in got.rows]

        return run_script(script, rows, data, timeout_s)

    def ask(self, rows: DataFrame, intent: str, max_tokens: int = 200) -> str:
        """What the rows say to an intent: those that hold most of its words, as text within the tokens. Extracted, not generated."""
        wanted = search.terms(intent)
        line = results.tsv_lines(rows)
        n = F.size(F.array_intersect(joins.tokens(F.col("line")), F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)
        best = ranking.fit_budget(line.withColumn("n", n), [F.col("n").desc(), F.col("line").asc()], scalars.token_count(F.col("line")), max_tokens)
        return "\n".join(r["line"] for r in best.orderBy("used").collect())  # at most max_tokens rows

    def host_meta(self, key: str) -> str | None:
        return self.meta.get(key)

    def config(self, name: str, value: str | None = None) -> str | None:
        """Read a setting, or set it; only those of SETTINGS."""
        if name not in SETTINGS:
            raise ValueError(f"unknown setting {name}; known: {', '.join(SETTINGS)}")
        if value is not None:
            self.spark.conf.set(name, value)
        return self.spark.conf.get(name)

    def command(self, line: str) -> Any:
        """``config list|read|set``, ``import list``, ``diagnostics memory``, ``help``; what a host process would do is not here."""
        words = line.split()
        match words:
            case ["config", "list"]:
                return {name: self.spark.conf.get(name, None) for name in SETTINGS}
            case ["config", "read", name]:
                return self.config(name)
            case ["config", "set", name, value]:
                return self.config(name, value)
            case ["import", "list"]:
                return sorted(self.views)
            case ["diagnostics", "memory"]:
                return str(self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus())
            case ["help"] | []:
                return ["config list", "config read NAME", "config set NAME VALUE", "import list", "diagnostics memory", "help"]
        raise ValueError(f"unknown command {line!r}; try help")


_NODES = (
    ast.Module, ast.Expr, ast.Assign, ast.AugAssign, ast.Name, ast.Load, ast.Store, ast.Constant, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.If, ast.For,
    ast.Break, ast.Continue, ast.Pass, ast.Call, ast.keyword, ast.Subscript, ast.Slice, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp,
    ast.comprehension, ast.Attribute, ast.JoinedStr, ast.FormattedValue, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Return, ast.FunctionDef, ast.arguments, ast.arg, ast.Raise,
)
_METHODS = {"append", "extend", "get", "items", "keys", "values", "split", "strip", "lower", "upper", "join", "replace", "startswith", "endswith", "sort", "count", "index"}
_NAMES = {"len": len, "sum": sum, "min": min, "max": max, "sorted": sorted, "range": range, "enumerate": enumerate, "zip": zip, "str": str, "int": int, "float": float, "bool": bool, "list": list, "dict": dict, "set": set, "round": round, "abs": abs, "any": any, "all": all}


def run_script(script: str, query: Callable[[str], list[dict]], data: Any = None, timeout_s: float = 30.0, most: int = 1_000_000) -> dict[str, Any]:
    """result, output, artifacts and error (kind, message) of a script in a small part of Python.

    It has query(sql), data, print(), artifact(name, text), and names without access to anything else: no imports, no
    attributes but common methods of text and collections, no loops but over what is there. The last value assigned
    to ``result`` is returned. Errors are syntax, runtime, timeout or memory.
    """
    import sys

    out: dict[str, Any] = {"result": None, "output": "", "artifacts": [], "error": None}
    try:
        tree = ast.parse(script)
        for node in ast.walk(tree):
            if not isinstance(node, _NODES):
                raise SyntaxError(f"{type(node).__name__} is not part of the language")
            if isinstance(node, ast.Attribute) and node.attr not in _METHODS:
                raise SyntaxError(f"no method {node.attr}")
            if isinstance(node, ast.Name) and node.id.startswith("_"):
                raise SyntaxError(f"no name {node.id}")
    except SyntaxError as error:
        return out | {"error": {"kind": "syntax", "message": str(error)}}
    until, shown, steps = time.monotonic() + timeout_s, io.StringIO(), 0

    def watch(frame, event, arg):
        nonlocal steps
        if frame.f_code.co_filename != "<script>":
            return None
        steps += 1
        if time.monotonic() > until:
            raise TimeoutError(f"more than {timeout_s} s")
        if steps > most:
            raise MemoryError(f"more than {most} steps")
        return watch

    def artifact(name: str, text: str, media_type: str = "text/plain") -> None:
        out["artifacts"].append({"uri": f"artifact:///{name}", "media_type": media_type, "size": len(str(text).encode()), "label": name, "text": str(text)})

    names = {"__builtins__": {}, "query": query, "data": data, "artifact": artifact, "print": lambda *a: print(*a, file=shown), "result": None, **_NAMES}
    before = sys.gettrace()
    try:
        code = compile(tree, "<script>", "exec")
        sys.settrace(watch)
        with contextlib.redirect_stdout(shown):
            exec(code, names)  # noqa: S102  only what the walk above let through
        out["result"] = json.loads(json.dumps(names.get("result"), default=str))
    except TimeoutError as error:
        out["error"] = {"kind": "timeout", "message": str(error)}
    except (MemoryError, RecursionError) as error:
        out["error"] = {"kind": "memory", "message": str(error)}
    except Exception as error:
        out["error"] = {"kind": "runtime", "message": f"{type(error).__name__}: {error}"}
    finally:
        sys.settrace(before)
        out["output"] = shown.getvalue()
    return out
