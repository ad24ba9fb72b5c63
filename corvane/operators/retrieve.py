"""Reading, trees, history, diagnostics and coverage of what an address names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.address import Address, in_scope, parse_address, symbol_filter
from ..sources.bindings import lines
from . import joins, ranking


def sliced(docs: DataFrame, first: int, last: int, uri: str = "uri", text: str = "text") -> DataFrame:
    """uri, line_number, line of the lines first to last, both in, counted from 1; what is not there is left out."""
    parts = F.slice(F.split(text, "\n"), F.lit(max(1, first)), F.lit(max(0, last - max(1, first) + 1)))
    rows = docs.select(uri, F.posexplode(parts).alias("n", "line"))
    return rows.select(uri, (F.col("n") + max(1, first)).cast("long").alias("line_number"), "line")


def symbols_in(symbols: DataFrame, wanted: str, name: str = "name") -> DataFrame:
    return symbols.filter(symbol_filter(F.col(name), wanted))


#: Representations from the cheapest on, with the tokens that they need a file.
LEVELS = ("headline", "structure", "content")


def read(docs: DataFrame, address: str, budget: int = 0, level: str = "auto", uri: str = "uri", text: str = "text") -> DataFrame:
    """uri, shown_as, body of what the address names: slices as they are, files at a level.

    With auto, the level follows from the budget of tokens over the number of files. zero_result() tells an empty
    answer from one with empty texts.
    """
    parts = None
    for one in parse_address(address):
        held = docs.filter(in_scope(F.col(uri), one.pattern))
        rows = _slice(held, one, uri, text) if one.lines else _level(held, one, budget, level, uri, text)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.dropDuplicates([uri, "shown_as"])


def _slice(docs: DataFrame, one: Address, uri: str, text: str) -> DataFrame:
    first, last = one.lines
    body = F.array_join(F.slice(F.split(text, "\n"), F.lit(max(1, first)), F.lit(max(0, last - max(1, first) + 1))), "\n")
    return docs.select(uri, F.lit(f"lines {first}-{last}").alias("shown_as"), body.alias("body"))


def _level(docs: DataFrame, one: Address, budget: int, level: str, uri: str, text: str) -> DataFrame:
    level = one.modifier if one.modifier in LEVELS else level
    if level in LEVELS:
        shown = F.lit(level)
    elif budget:
        count = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("__n"))
        docs = docs.join(F.broadcast(count))  # one row
        shown = ranking.representation(F.floor(F.lit(budget) / F.col("__n")))
    else:
        shown = F.lit("content")
    body = F.when(shown == "headline", scalars.headline(F.col(text))).when(shown == "structure", scalars.structure(F.col(text))).otherwise(F.col(text))
    return docs.select(uri, shown.alias("shown_as"), body.alias("body"))


def zero_result(rows: DataFrame) -> DataFrame:
    """One row: whether nothing was matched, as a flag beside the rows."""
    return rows.agg((F.count("*") == 0).alias("zero_result"))


def tree(files: DataFrame, size: str | None = None, depth: int = 0, uri: str = "uri") -> DataFrame:
    """folder, depth, files, bytes of every folder above a file, so far as depth says."""
    folders = F.transform(joins.prefixes(F.col(uri)), lambda p: F.regexp_replace(p, "/+$", "/"))
    rows = files.select(F.explode(F.array_distinct(folders)).alias("folder"), (F.col(size) if size else F.lit(0)).alias("b"))
    level = F.size(F.filter(F.split("folder", "/"), lambda x: x != "")).cast("long")
    found = rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("b").cast("long").alias("bytes")).withColumn("depth", level)
    found = found.filter(F.col("depth") <= depth) if depth else found
    return found.select("folder", "depth", "files", "bytes")


def log(commits: DataFrame, changes: DataFrame, most: int, when: str = "authored_at") -> DataFrame:
    """commits × changed files of the latest ``most`` commits: the limit is on commits, before they fan out."""
    latest = commits.orderBy(F.col(when).desc_nulls_last(), F.col("hash").asc_nulls_last()).limit(most)
    return changes.join(F.broadcast(latest) if most <= 10_000 else latest, "hash")


def history(commits: DataFrame, changes: DataFrame, file: Column, most: int, keyword: str | None = None, when: str = "authored_at") -> DataFrame:
    """Commits that touched a file, newest first or those with the keyword first, with files_changed of each."""
    touched = changes.filter(file).select("hash").distinct()
    sizes = changes.join(touched, "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("files_changed"))
    rows = commits.join(sizes, "hash")
    score = F.contains(F.lower("message"), F.lit(keyword.lower())).cast("int") if keyword else F.lit(0)
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), F.col(when).desc_nulls_last(), "hash").limit(most)


def blame_totals(blamed: DataFrame, by: str, hash_: str = "hash") -> DataFrame:
    """Lines and distinct commits of each file."""
    return blamed.groupBy(by).agg(F.count("*").alias("total_lines"), F.count_distinct(hash_).alias("commits"))


#: Changes that one task counts distinct commits and authors of, about, before it passes them on.
TASK_CHANGES = 1_000_000


def hotspots(commits: DataFrame, changes: DataFrame, most: int) -> DataFrame:
    """file, commits, authors of the files that changed most. Distinct values hardly shrink within a task, so the changes are
    counted first and dealt by commit to tasks of about TASK_CHANGES, however large the input."""
    parts = max(1, -(-changes.count() // TASK_CHANGES))
    rows = changes.repartition(parts, "hash").join(commits, "hash").groupBy("file").agg(F.count_distinct("hash").alias("commits"), F.count_distinct("author").alias("authors"))
    return rows.orderBy(F.col("commits").desc(), F.col("authors").desc(), "file").limit(most)


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change of what differs between two snapshots: A only after, D only before, M with another value."""
    a = before.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(True).alias("a"))
    b = after.select(F.col(key).alias("k"), F.col(value).alias("y"), F.lit(True).alias("b"))
    both = a.join(b, "k", "full_outer")
    change = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "D").when(~F.col("x").eqNullSafe(F.col("y")), "M")
    return both.select(F.col("k").alias(key), change.alias("change")).filter("change is not null")


def patches(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, patch, insertions, deletions: unified diffs, by batches in Python as no expression can make them."""

    @F.pandas_udf("patch string, insertions long, deletions long")
    def made(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(old, new, strict=True):
            out = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
            rows.append(("\n".join(out), sum(x.startswith("+") for x in out[2:]), sum(x.startswith("-") for x in out[2:])))
        return pd.DataFrame(rows, columns=["patch", "insertions", "deletions"])

    changed = pairs.filter(~F.col(before).eqNullSafe(F.col(after)))
    return changed.select(key, made(F.col(before), F.col(after)).alias("p")).select(key, "p.*")


def changes(status: DataFrame, group: str, key: str, insertions: str, deletions: str) -> DataFrame:
    """Entries by group with their counts: how many, and the lines added and removed."""
    return status.groupBy(group).agg(F.count(key).alias("entries"), F.sum(insertions).cast("long").alias("insertions"), F.sum(deletions).cast("long").alias("deletions"))


def coverage(symbols: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """symbols with mark: covered, uncovered, or unmeasured where nothing was measured."""
    m = marks.select(key, F.col("covered").alias("__c"))
    return symbols.join(m, key, "left").withColumn("mark", F.when(F.col("__c"), "covered").when(~F.col("__c"), "uncovered").otherwise("unmeasured")).drop("__c")


def snippets(docs: DataFrame, pattern: str, most: int, width: int = 3, uri: str = "uri", text: str = "text") -> DataFrame:
    """uri, snippet: the first lines that are not blank of the files in scope."""
    body = F.array_join(F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, width), "\n")
    return docs.filter(in_scope(F.col(uri), pattern)).select(uri, body.alias("snippet")).orderBy(uri).limit(most)


def gaps(rows: DataFrame, by: str, sequence: str) -> DataFrame:
    """by, sequence, missed: where the sequence of a run skips, and by how many."""
    before = F.lag(sequence).over(W.partitionBy(by).orderBy(sequence))
    return rows.select(by, sequence, (F.col(sequence) - before - 1).alias("missed")).filter("missed > 0")


