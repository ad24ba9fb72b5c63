"""Durable notes and vocabulary: what governs an address, what occurs in a text, and what a session has seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from . import joins, ranking

CATEGORIES = ("KNOWLEDGE", "RULE", "DECISION", "PATTERN", "WARNING")
#: Entries and characters that are shown when a call does not say, and what it may ask for at most.
SHOWN, MOST_SHOWN = 5, 20
CHARACTERS, MOST_CHARACTERS = 2_000, 4_000


def concepts(targets: DataFrame, capsules: DataFrame, uri: str = "uri") -> DataFrame:
    """Capsules that govern each target, narrow before universal; universal ones apply everywhere.

    Columns: those of both sides, and place from 1 within a target.
    """
    narrow = joins.governs(targets, capsules.filter(~F.col("is_universal")), uri, "relevance")
    broad = targets.join(F.broadcast(_few(capsules.filter("is_universal"))))  # checked to be few
    rows = narrow.unionByName(broad)
    order = W.partitionBy(uri).orderBy(F.col("is_universal").asc(), F.size("relevance").asc(), F.col("capsule").asc_nulls_last())
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def _few(rows: DataFrame, most: int = 1_000) -> DataFrame:
    return ranking.at_most(rows, most, "universal capsules")


def counted(governing: DataFrame, uri: str = "uri", shown: int = SHOWN) -> DataFrame:
    """Per target: narrow_shown, universal_applicable, total."""
    universal = F.col("is_universal")
    return governing.groupBy(uri).agg(F.count_if(~universal & (F.col("place") <= shown)).alias("narrow_shown"), F.count_if(universal).alias("universal_applicable"), F.count("*").alias("total"))


def unseen(rows: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """rows that the session has not been shown; nulls compare as values."""
    held = seen.select(*(F.col(c).alias(f"__{c}") for c in by)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rows.join(held, on, "left_anti")


def surfaced_concepts(governing: DataFrame, seen: DataFrame, limit: int = SHOWN, session: str = "session", uri: str = "uri") -> DataFrame:
    """The first ``limit`` capsules of each session that it has not seen, in order of its targets; 1 to MOST_SHOWN."""
    if not 1 <= limit <= MOST_SHOWN:
        raise ValueError(f"limit must be from 1 to {MOST_SHOWN}")
    new = unseen(governing, seen, [session, "capsule"])
    first = new.groupBy(session, "capsule").agg(F.min(F.struct(F.col("is_universal"), uri, "place")).alias("x"))
    order = [F.col("x").asc(), F.col("capsule").asc()]
    return ranking.top_per_group(first, [session], order, limit).select(session, "capsule", F.col(f"x.{uri}").alias(uri), "place")


def surfaced_terms(texts: DataFrame, senses: DataFrame, key: str, entries: int = 0, characters: int = 0, text: str = "text") -> DataFrame:
    """key, term, meaning, place of the senses whose term or alias occurs in a text, within both limits.

    0 means the default. A definition is shown whole or not at all, and those after one that does not fit are not
    shown. Terms named more often come first.
    """
    entries, characters = min(entries or SHOWN, MOST_SHOWN), min(characters or CHARACTERS, MOST_CHARACTERS)
    names = senses.select("term", "meaning", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("__name"))
    hits = joins.contains(texts.select(key, text), names, text, "__name").groupBy(key, "term", "meaning").agg(F.count("*").alias("n"))
    order = W.partitionBy(key).orderBy(F.col("n").desc(), "term", "meaning")
    rows = hits.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= entries)
    used = F.sum(F.length("term") + F.length("meaning") + 2).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("used", used).filter(F.col("used") <= characters).select(key, "term", "meaning", "place")


def violations(capsules: DataFrame) -> DataFrame:
    """capsule, problems of each capsule to be captured: an empty array when it may be written."""
    checks = [
        (~F.coalesce(F.col("capsule").rlike(r"^concept:///[a-z0-9][a-z0-9/-]*/[A-Z][A-Za-z0-9]*\.md$"), F.lit(False)), "name: folders in lower case, then a capitalised name and .md"),
        (~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), f"category: one of {', '.join(CATEGORIES)}"),
        (F.coalesce(F.trim("invariant"), F.lit("")) == "", "invariant: is empty"),
        ((F.col("category") == "KNOWLEDGE") & (F.coalesce(F.trim("verification"), F.lit("")) == ""), "verification: required for KNOWLEDGE"),
        (F.col("ttl_days") <= 0, "ttl_days: must be above zero"),
        (~F.col("is_universal") & (F.size(F.coalesce("relevance", F.array().cast("array<string>"))) == 0), "relevance: required unless universal"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in checks)))
    return capsules.select("capsule", found.alias("problems"))


def expired(capsules: DataFrame, today: Column) -> Column:
    """Whether a capsule has outlived its days; without a limit it never has."""
    return F.coalesce(F.date_add("captured", F.col("ttl_days").cast("int")) < today, F.lit(False))


def provenance(delivered: DataFrame, edited: DataFrame, seen: DataFrame, session: str = "session", uri: str = "uri") -> DataFrame:
    """Delivered addresses that the session is itself editing in a worktree and has not been told about."""
    now = edited.select(session, uri, "worktree").distinct()
    return unseen(delivered.select(session, uri).distinct().join(now, [session, uri]), seen, [session, uri])


# Mounts that a listing leaves out, as who asks knows them, and the names that memory goes by.
UNLISTED_SCHEMES = ("file", "help", "concept", "vocabulary", "worktree")
UNLISTED_KINDS = ("primary", "worktree")
NOTES, WORDS = "concept:///", "vocabulary:///"


def mount_memory(mounts: DataFrame, files: DataFrame) -> DataFrame:
    """uri, section, label, concepts, words of every mount that is listed: how much memory lies below its path.

    Notes are ``.md`` files other than a README. A mount of a new kind or without one is listed; its kind is the label.
    """
    kind = F.coalesce("kind", F.lit(""))
    shown = mounts.filter(~F.col("scheme").isin(*UNLISTED_SCHEMES) & ~kind.isin(*UNLISTED_KINDS))
    section = F.when(kind == "workspace", "workspace").otherwise("import")
    label = F.when(~kind.isin("workspace", "import", ""), kind)
    path = scalars.memory_path(F.col("scheme"), F.col("authority"), F.col("path_prefix"))
    rows = shown.select("uri", section.alias("section"), label.alias("label"), path.alias("__path"))
    note = (F.col("extension") == ".md") & (F.lower("name") != "readme.md")
    held = files.filter((F.col("uri").startswith(NOTES) & note) | F.col("uri").startswith(WORDS))
    below = {n: F.concat(F.lit(root), F.col("__path"), F.lit("/")) for n, root in (("concepts", NOTES), ("words", WORDS))}
    return joins.prefix_counts(rows, held, below, ["uri"]).drop("__path")


def memory_lines(listed: DataFrame) -> DataFrame:
    """section, line: the address, and in brackets its label and what it holds."""
    held = F.concat_ws(", ", "label", scalars.counted(F.col("concepts"), "concept", "concepts"), scalars.counted(F.col("words"), "vocab word", "vocab words"))
    return listed.select("section", F.when(held == "", F.col("uri")).otherwise(F.concat("uri", F.lit(" ("), held, F.lit(")"))).alias("line"))
