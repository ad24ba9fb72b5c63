"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import fresh_dir, settle, shared_dir, spread

__all__ = ["fresh_dir", "settle", "shared_dir", "spread"]

#: A word: no space and no control among tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of this very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


#: Texts of an Arrow batch that are Python objects at a time.
AT_ONCE = 256


def few(texts: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts of an Arrow batch in UTF-8, AT_ONCE at a time: a batch of 10,000 long texts is held once, by Arrow."""
    for at in range(0, len(texts), AT_ONCE):
        yield texts.slice(at, AT_ONCE).cast(pa.binary()).to_pylist()


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def keep_columns(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    return docs.select(*(col(n) for n in names))


#: Keys that are sent to every task because they hold many rows, at most; a key of fewer rows is never one of them.
MOST_HOT, LEAST_HOT = 5_000, 1_000


def skew_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows left-joined with few, which has each key once, whatever share of the rows one key has.

    The keys of more than a MOST_HOT-th of all rows, and of LEAST_HOT rows at least, are counted first: there are at
    most MOST_HOT of them, so their rows of ``few`` are broadcast and the rows stay where they are. The others meet
    their key in a shuffle, where no key is large. A null key finds nothing. ``rows`` is read three times: settle it.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    hot = settle(counts.filter(F.col("__n") > max(LEAST_HOT, rows.count() // MOST_HOT)).select(key))
    if hot.isEmpty():
        return rows.join(few, key, "left")
    found = F.broadcast(hot.join(few, key, "left"))  # at most MOST_HOT rows
    cold = rows.join(F.broadcast(hot), key, "left_anti")
    return cold.join(few, key, "left").unionByName(rows.join(found, key))
