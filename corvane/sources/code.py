"""Declarations of source files as relations, one family of views for each language.

Python files are parsed by their own grammar. The other languages are read line by line with a table of patterns,
which is native, finds declarations as they are usually written, and resolves nothing: no types, no references.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins
from .bindings import lines

_CS = r"(?:(?:public|internal|private|protected|static|abstract|sealed|partial|readonly|virtual|override|async)\s+)"
_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_PHP = r"(?:(?:public|private|protected|static|abstract|final|readonly)\s+)"
#: language -> (view, pattern, group of the name, group of the detail or 0). A pattern tells one line.
PATTERNS: dict[str, list[tuple[str, str, int, int]]] = {
    "csharp": [
        ("csharp_namespaces", r"^\s*namespace\s+([\w.]+)", 1, 0),
        ("csharp_types", rf"^\s*{_CS}*(class|interface|struct|enum|record)\s+(\w+)", 2, 1),
        ("csharp_members", rf"^\s+{_CS}+(?!class\b|interface\b|struct\b|enum\b|record\b)([\w<>\[\],.?]+)\s+(\w+)\s*(?:\(|\{{|=|;)", 2, 1),
    ],
    "go": [
        ("go_types", r"^type\s+(\w+)\s+(struct|interface|[\w.\[\]*]+)", 1, 2),
        ("go_functions", r"^func\s+(\w+)\s*[\[(]", 1, 0),
        ("go_methods", r"^func\s+\(\s*\w*\s*\*?(\w+)(?:\[[^\]]*\])?\s*\)\s+(\w+)", 2, 1),
        ("go_fields", r"^\t([A-Za-z]\w*)\s+([\w.*\[\]]+)(?:\s+`[^`]*`)?$", 1, 2),
        ("go_imports", r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"$""", 1, 0),
        ("go_dependencies", r"^\s*(?:require\s+)?([\w-]+\.[\w./-]+)\s+(v[\w.+-]+)", 1, 2),
        ("go_replaces", r"^\s*replace\s+(\S+)(?:\s+\S+)?\s+=>\s*(\S+)", 1, 2),
        ("go_constants", r"^(?:const)\s+(\w+)", 1, 0),
        ("go_enum_blocks", r"^\s+(\w+)\s+(?:\w+\s+)?=\s*iota", 1, 0),
        ("go_variables", r"^var\s+(\w+)\s+([^\s=]+)?", 1, 2),
        ("go_tests", r"^func\s+((?:Test|Benchmark|Fuzz|Example)\w*)\(", 1, 0),
        ("go_directives", r"^//go:(\w+)\s*(.*)$", 1, 2),
        ("go_embeds", r"^//go:embed\s+(.+)$", 1, 0),
    ],
    "ruby": [
        ("ruby_types", r"^\s*(class|module)\s+([\w:]+)", 2, 1),
        ("ruby_methods", r"^\s*def\s+(?:self\.)?([\w?!=]+)", 1, 0),
        ("ruby_mixins", r"^\s*(include|extend|prepend)\s+([\w:]+)", 2, 1),
        ("ruby_associations", r"^\s*(has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:(\w+)", 2, 1),
    ],
    "rust": [
        ("rust_types", rf"^\s*{_PUB}(struct|enum|trait|union|type)\s+(\w+)", 2, 1),
        ("rust_functions", rf"^{_PUB}(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", 1, 0),
        ("rust_methods", rf"^\s+{_PUB}(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)\s*(?:<[^>]*>)?\(\s*((?:&\s*(?:mut\s+)?)?self)?", 1, 2),
        ("rust_impls", r"^\s*impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?(\w+)", 2, 1),
        ("rust_derives", r"^\s*#\[derive\(([^)]*)\)\]", 1, 0),
    ],
    "typescript": [
        ("typescript_declarations", r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|type|enum|function|const|namespace)\s+(\w+)", 2, 1),
        ("typescript_members", r"^\s+(?:(?:public|private|protected|static|readonly|async|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|const\b|catch\b)(\w+)\??\s*(\(|:)", 1, 0),
        ("typescript_components", r"^(?:export\s+)?(?:default\s+)?(?:function|const)\s+([A-Z]\w*)", 1, 0),
        ("typescript_imports", r"""^import\s+(?:(.*)\s+from\s+)?['"]([^'"]+)['"]""", 2, 1),
    ],
    "cpp": [
        ("cpp_classes", r"^\s*(class|struct)\s+(\w+)[^;]*$", 2, 1),
        ("cpp_functions", r"^(?!#)(?:[\w:<>,*&~]+\s+)+[*&]?([\w:~]+)\s*\([^;]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{", 1, 0),
        ("cpp_includes", r"""^\s*#include\s+([<"])([^>"]+)[>"]""", 2, 1),
        ("cpp_templates", r"^\s*template\s*<([^>]*)>", 1, 0),
        ("cpp_enums", r"^\s*enum\s+(class\s+)?(\w+)", 2, 1),
        ("cpp_macro_invocations", r"^\s*([A-Z][A-Z0-9_]{2,})\s*\(([^)]*)\)", 1, 2),
        ("cpp_namespace_members", r"^\s*namespace\s+([\w:]+)", 1, 0),
    ],
    "php": [
        ("php_types", r"^\s*(?:abstract\s+|final\s+)?(class|interface|trait|enum)\s+(\w+)", 2, 1),
        ("php_members", rf"^\s+{_PHP}+(?:(function)\s+|(?:\??[\w\\]+\s+)?\$)(\w+)", 2, 1),
        ("php_inheritance", r"^\s*(?:abstract\s+|final\s+)?class\s+\w+\s+(extends|implements)\s+([\w\\]+)", 2, 1),
        ("php_trait_usage", r"^\s+use\s+([\w\\]+)", 1, 0),
    ],
}
#: Views whose names hold what comes after them, until the next.
CONTAINERS = ("csharp_types", "go_types", "ruby_types", "rust_impls", "rust_types", "typescript_declarations", "cpp_classes", "php_types")
VIEWS = sorted({v for p in PATTERNS.values() for v, *_ in p} | {"python_types", "python_methods", "python_imports", "ruby_mro"})


def declarations(docs: DataFrame, lang: str, uri: str = "uri", text: str = "text") -> DataFrame:
    """uri, view, name, detail, container, line_number of the declarations of files in one language."""
    if lang == "python":
        return _python(docs, uri, text)
    if lang not in PATTERNS:
        raise ValueError(f"no views for {lang!r}; known: {', '.join(sorted([*PATTERNS, 'python']))}")
    each = lines(docs, uri, text)
    found = F.array(
        *(
            F.when(
                F.col("line").rlike(p),
                F.struct(F.lit(v).alias("view"), F.regexp_extract("line", p, n).alias("name"), (F.nullif(F.trim(F.regexp_extract("line", p, d)), F.lit("")) if d else F.lit(None).cast("string")).alias("detail")),
            )
            for v, p, n, d in PATTERNS[lang]
        )
    )
    marked = each.select(uri, "line_number", F.array_compact(found).alias("all"))
    held = F.try_element_at(F.filter("all", lambda x: x.view.isin(*CONTAINERS)), F.lit(1)).getField("name")
    above = F.last(held, ignorenulls=True).over(W.partitionBy(uri).orderBy("line_number").rowsBetween(W.unboundedPreceding, -1))
    rows = marked.withColumn("container", above).select(uri, "line_number", "container", F.explode("all").alias("x"))
    inside = ~F.col("x.view").isin(*CONTAINERS, "csharp_namespaces", "go_imports", "go_functions", "go_dependencies", "go_replaces", "go_tests", "go_embeds", "go_directives", "go_constants", "go_variables", "go_enum_blocks", "rust_functions", "rust_derives", "typescript_imports", "typescript_components", "cpp_includes", "cpp_namespace_members", "cpp_templates", "cpp_enums", "cpp_functions")
    owner = F.when(F.col("x.view") == "go_methods", F.col("x.detail")).when(inside, F.col("container"))
    return rows.select(uri, F.col("x.view").alias("view"), F.col("x.name").alias("name"), F.col("x.detail").alias("detail"), owner.alias("container"), "line_number")


def _nodes(text: str) -> Iterator[tuple]:
    """(view, name, detail, container, line) of a Python file; a file that does not parse has none."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError):
        return

    def walk(node: ast.AST, owner: str | None) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield "python_types", child.name, ", ".join(ast.unparse(b) for b in child.bases) or None, owner, child.lineno
                yield from walk(child, child.name if owner is None else f"{owner}.{child.name}")
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "async" if isinstance(child, ast.AsyncFunctionDef) else None
                yield "python_methods", child.name, kind, owner, child.lineno
                yield from walk(child, child.name if owner is None else f"{owner}.{child.name}")
            elif isinstance(child, ast.Import):
                for name in child.names:
                    yield "python_imports", name.name, name.asname, owner, child.lineno
            elif isinstance(child, ast.ImportFrom):
                for name in child.names:
                    yield "python_imports", "." * child.level + (child.module or ""), name.name, owner, child.lineno
            else:
                yield from walk(child, owner)

    yield from walk(module, None)


def _python(docs: DataFrame, uri: str, text: str) -> DataFrame:
    names = [uri, "view", "name", "detail", "container", "line_number"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(where, *row) for where, source in zip(batch[uri], batch[text], strict=True) for row in _nodes(source or "")]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.select(uri, text).mapInPandas(run, f"`{uri}` string, view string, name string, detail string, container string, line_number long")


def ruby_mro(rows: DataFrame, docs: DataFrame, uri: str = "uri", text: str = "text") -> DataFrame:
    """seed, node, depth: the ancestors of each class, nearest first: mixins and superclasses, a step each."""
    parent = r"^\s*class\s+([\w:]+)\s*<\s*([\w:]+)"
    above = lines(docs, uri, text).select(F.regexp_extract("line", parent, 1).alias("src"), F.regexp_extract("line", parent, 2).alias("dst")).filter("src <> ''")
    mixed = rows.filter("view = 'ruby_mixins' and container is not null").select(F.col("container").alias("src"), F.col("name").alias("dst"))
    seeds = rows.filter("view = 'ruby_types'").select(F.col("name").alias("node")).distinct()
    return joins.reachable(above.unionByName(mixed), seeds)


def types(rows: DataFrame) -> DataFrame:
    """The Types relation: uri, name, type_kind, lang, line_number."""
    kept = rows.filter(F.col("view").isin("csharp_types", "go_types", "python_types", "ruby_types", "rust_types", "cpp_classes", "php_types", "typescript_declarations"))
    return kept.filter("view <> 'typescript_declarations' or detail in ('class', 'interface', 'type', 'enum')").select("uri", "name", F.col("detail").alias("type_kind"), F.substring_index("view", "_", 1).alias("lang"), "line_number")


def functions(rows: DataFrame) -> DataFrame:
    """The Functions relation: uri, name, declaring_type, lang, line_number."""
    kept = rows.filter(F.col("view").isin("go_functions", "go_methods", "python_methods", "ruby_methods", "rust_functions", "rust_methods", "cpp_functions") | ((F.col("view") == "php_members") & (F.col("detail") == "function")) | ((F.col("view") == "typescript_declarations") & (F.col("detail") == "function")))
    return kept.select("uri", "name", F.col("container").alias("declaring_type"), F.substring_index("view", "_", 1).alias("lang"), "line_number")
