"""Aggregations of the query surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def mounts(files: DataFrame, by: list[str], indexed: Column, embedded: Column, languages: Column) -> DataFrame:
    """Per mount: file_count, indexed_count, embedded_count, embed_pct (null without files) and languages in order."""
    return (
        files.groupBy(*by)
        .agg(
            F.count("*").alias("file_count"),
            F.count_if(indexed).alias("indexed_count"),
            F.count_if(embedded).alias("embedded_count"),
            F.array_join(F.array_sort(F.collect_set(languages)), ",").alias("languages"),
        )
        .withColumn("embed_pct", scalars.percent(F.col("embedded_count"), F.col("file_count")))
    )


def engine_status(registry: DataFrame) -> DataFrame:
    """One row over a registry (stage, failures, active, dirty, embedded): counts and the state that they imply.

    Overlays such as dirty overlap stages and are not part of the total.
    """
    one = registry.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("stage") == "complete").alias("complete"),
        F.count_if(F.col("failures") > 0).alias("failed"),
        F.count_if(F.col("stage") == "discovered").alias("discovered"),
        F.count_if("active").alias("active"),
        F.count_if("dirty").alias("dirty"),
        F.count_if("embedded").alias("embedded"),
        F.coalesce(F.bool_and("embedded"), F.lit(True)).alias("semantic_ready"),
    )
    state = F.when(F.col("complete") + F.col("failed") < F.col("total_files"), "indexing").when(~F.col("semantic_ready"), "embedding").otherwise("ready")
    return one.withColumn("semantic_percent", scalars.percent(F.col("embedded"), F.col("total_files"))).withColumn("state", state)


def source_rows(sources: DataFrame, room: int = 8, uri: str = "uri", files: str = "files") -> DataFrame:
    """Sources as lines (position, label, files): each its own while they fit into ``room``, otherwise counted by scheme.

    The workspace comes first, then larger schemes, then by name; a scheme of one keeps the name of its source.
    ``room`` is compared with the whole set, by one aggregate that joins back as a single row.
    """
    keyed = sources.select(F.col(uri).alias("u"), F.col(files).alias("f"), scalars_scheme(F.col(uri)).alias("s"))
    total = keyed.agg(F.count("*").alias("all"))
    many = keyed.groupBy("s").agg(F.count("*").alias("n"), F.sum("f").alias("f"), F.min("u").alias("u"))
    label = F.when(F.col("n") == 1, F.col("u")).otherwise(F.concat(F.col("s"), F.lit(" × "), F.col("n").cast("string")))
    grouped = many.select(F.when(F.col("s") == "workspace", 0).otherwise(1).alias("w"), (-F.col("n")).alias("o"), F.col("s").alias("k"), label.alias("label"), "f").join(F.broadcast(total.filter(F.col("all") > room)))
    each = keyed.select(F.lit(0).alias("w"), F.lit(0).cast("long").alias("o"), F.col("u").alias("k"), F.col("u").alias("label"), "f").join(F.broadcast(total.filter(F.col("all") <= room)))
    rows = grouped.unionByName(each)
    place = F.row_number().over(W.orderBy("w", "o", "k"))  # one row per scheme, or at most room rows
    return rows.select(place.cast("long").alias("position"), "label", F.col("f").cast("long").alias("files"))


def scalars_scheme(uri: Column) -> Column:
    at = F.instr(uri, "://")
    return F.when(at > 0, F.substring(uri, F.lit(1), at + 2)).otherwise(uri)


def state_summary(rows: DataFrame, state: str, words: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``6 online · 2 not answering``: each state's count in the given order and words, without those of none."""
    counts = rows.groupBy(*(by or [])).agg(*(F.count_if(F.col(state) == s).alias(f"n{i}") for i, s in enumerate(words)))
    parts = [F.when(F.col(f"n{i}") > 0, F.concat(F.col(f"n{i}").cast("string"), F.lit(f" {w}"))) for i, w in enumerate(words.values())]
    return counts.select(*(by or []), F.concat_ws(" · ", *parts).alias("summary"))


def totals(rows: DataFrame, shown: int) -> DataFrame:
    """One row: total_rows of everything, returned_rows, truncated."""
    return rows.agg(F.count("*").alias("total_rows")).select("total_rows", F.least("total_rows", F.lit(shown)).alias("returned_rows"), (F.col("total_rows") > shown).alias("truncated"))
