"""Scalar functions of the query surface, as column expressions; each is built in, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Code points of one token: the estimate used everywhere.
TOKEN = 4


def media_type_kind(mime: Column) -> Column:
    """The kind parameter of a media type; null without one."""
    return F.nullif(F.trim(F.regexp_extract(mime, r";\s*kind=([^;]+)", 1)), F.lit(""))


def token_count(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(TOKEN)).cast("long")


def starts_with(text: Column, prefix: Column) -> Column:
    """False, not null, when either side is null."""
    return F.coalesce(F.startswith(text, prefix), F.lit(False))


def trim_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def memory_path(scheme: Column, authority: Column, path_prefix: Column) -> Column:
    """Where the memory of a mount lies below the memory schemes: its parts without empty ones, joined by slashes."""
    empty = F.lit("")
    return F.concat_ws("/", scheme, F.nullif(authority, empty), F.nullif(trim_chars(path_prefix, "/"), empty))


def counted(n: Column, one: str, many: str) -> Column:
    """``3 concepts``, ``1 concept``; null for none, so that it drops out of a joined list."""
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many))))


def percent(done: Column, total: Column) -> Column:
    """Whole percents, at most 100; null when the total is not above zero or either is missing."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).cast("long")


def described(operation: Column, filesystem: Column) -> Column:
    """A running operation in words: first indexing and imports have them; housekeeping and worktrees do not."""
    source = F.regexp_replace(F.substring(operation, F.lit(8), F.length(operation)), r"^/+|/+$", "")
    named = F.regexp_replace(source, r"^github\.com/", "github://")
    address = F.when(F.coalesce(filesystem, F.lit("")) != "", F.regexp_replace(filesystem, r"/+$", "")).otherwise(named)
    told = F.when((address != "") & ~address.startswith("worktree://"), F.concat(F.lit("importing "), address))
    return F.when(operation == "startup", F.lit("indexing this repository")).when(operation.startswith("import:"), told)


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def digest16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def readiness(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, "^[A-Z]+_LEVEL_|^READINESS_", ""))


def command_words(line: Column) -> Column:
    """Words of a command line; quotes hold a word together and go."""
    found = F.regexp_extract_all(line, F.lit("\"[^\"]*\"|'[^']*'|[^\\s]+"), F.lit(0))
    return F.transform(found, lambda w: F.regexp_replace(w, "^\"(.*)\"$|^'(.*)'$", "$1$2"))


def patch_targets(patch: Column) -> Column:
    """Files that a patch adds, updates or moves to, first mention first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Add File|Update File|Move to): (.+)$"), F.lit(1)), lambda t: F.trim(t)))


def applied_targets(report: Column) -> Column:
    """Files a patch report says were added or modified: the lines right after its heading, up to the first other line."""
    listed = F.regexp_extract(report, r"Updated the following files:[ \t]*\r?\n((?:[ \t]*[AMD][ \t]+[^\r\n]+(?:\r?\n|$)|[ \t]*\r?\n)*)", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(listed, F.lit(r"(?m)^[ \t]*[AM][ \t]+([^\r\n]+)$"), F.lit(1)), lambda t: F.trim(t)))


#: Commands that show one file, and words that a plain pipeline cannot hold.
READERS = ("cat", "head", "tail", "sed", "nl", "less", "more", "bat")
_UNSAFE = r"[;&<>`$()\\]"


def shell_target(line: Column) -> Column:
    """The one file that a plain pipeline shows, or null: a reader, then stages that only number or cut lines."""
    bare = F.regexp_replace(F.regexp_replace(line, "'[^']*'", ""), '"[^"$`\\\\]*"', "")
    plain = ~bare.rlike(_UNSAFE + "|['\"]")
    masked = F.regexp_replace(line, r"\|(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)", "\u0001")
    stages = F.transform(F.split(masked, "\u0001"), lambda s: command_words(F.trim(s)))
    cutter = lambda w: F.array_join(w, " ").rlike(
        r"^(?:nl(?: -\S+)*|(?:head|tail)(?: -n \+?[0-9]+| -(?:n\+?)?[0-9]+)*|sed -n (?:[0-9]+|\$)(?:,(?:[0-9]+|\$))?p)$"
    )
    first = F.element_at(stages, 1)
    name = F.element_at(first, 1)
    tail = F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0)))
    taken = F.when(name == "sed", F.array(F.lit("-e"), F.lit("--expression"), F.lit("-f"))).when(name.isin("head", "tail"), F.array(F.lit("-n"), F.lit("-c"))).otherwise(F.array().cast("array<string>"))
    scripted = F.arrays_overlap(tail, F.array(F.lit("-e"), F.lit("--expression"), F.lit("-f")))
    free = F.filter(tail, lambda w, i: ~w.startswith("-") & ~F.coalesce(F.array_contains(taken, F.try_element_at(tail, F.when(i > 0, i).otherwise(F.lit(-1000)))), F.lit(False)))
    free = F.when((name == "sed") & ~scripted, F.slice(free, F.lit(2), F.greatest(F.size(free) - 1, F.lit(0)))).otherwise(free)
    good = plain & F.forall(stages, lambda w: F.size(w) > 0) & F.forall(F.slice(stages, F.lit(2), F.greatest(F.size(stages) - 1, F.lit(0))), cutter)
    return F.when(good & name.isin(*READERS) & (F.size(free) == 1), F.element_at(free, 1))


def headline(text: Column) -> Column:
    """The first line that is not blank, without markup marks, at most 120 characters; null without one."""
    first = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(1))
    return F.substring(F.trim(F.regexp_replace(first, r"^[#>*\-\s]+", "")), 1, 120)


def structure(text: Column) -> Column:
    """Headings and declarations of a document, a line each."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*(?:#{1,6}\s|(?:export |public |private |async |static )*(?:class|interface|struct|enum|trait|impl|def|fn|func|function|module|namespace)\b)"))
    return F.array_join(lines, "\n")


def summary(text: Column, sentences: int = 2) -> Column:
    """The first sentences: an extract, not a rewording."""
    return F.array_join(F.slice(F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"[^.!?]+[.!?]*\s?"), F.lit(0)), 1, sentences), "")


def json_text(value: Column) -> Column:
    """Any value as compact JSON; null fields stay, binary is base64."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def register(spark: SparkSession) -> None:
    """The names of the query surface that Spark SQL lacks, as temporary SQL functions."""
    for text in (
        "starts_with(s STRING, p STRING) RETURNS BOOLEAN RETURN coalesce(startswith(s, p), false)",
        "json_extract_string(j STRING, p STRING) RETURNS STRING RETURN get_json_object(j, p)",
        "json_extract(j STRING, p STRING) RETURNS STRING RETURN get_json_object(j, p)",
        "media_type_kind(m STRING) RETURNS STRING RETURN nullif(trim(regexp_extract(m, ';\\\\s*kind=([^;]+)', 1)), '')",
        f"token_count(t STRING) RETURNS BIGINT RETURN cast(ceil(length(t) / {TOKEN}) AS BIGINT)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
