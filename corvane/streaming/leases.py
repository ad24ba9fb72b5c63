"""Leases kept by beats, and idle times between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leases(beats: DataFrame, client: str, at: str, timeout_s: int) -> DataFrame:
    """client, began, ended, beats: a lease lasts from its first beat to a timeout after its last.

    Beats of one client closer than the timeout keep one lease, by the server's stamps alone; a later one begins a
    new lease under the same client. The same for a table and, with a watermark, for a stream.
    """
    window = F.session_window(at, f"{timeout_s} seconds")
    return beats.groupBy(client, window.alias("w")).agg(F.count("*").alias("beats")).select(client, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "beats")


def active_at(held: DataFrame, at: str) -> DataFrame:
    """One row: leases that hold at a moment."""
    moment = F.lit(at).cast("timestamp")
    return held.agg(F.count_if((F.col("began") <= moment) & (F.col("ended") > moment)).alias("active"))


def idle(held: DataFrame, least_s: int) -> DataFrame:
    """began, ended of the times of at least ``least_s`` seconds in which no lease holds.

    Leases are first merged within hours, so that what is put in one order is no more than the pieces of hours that
    there are, however many leases; the pieces of an hour that is covered whole are one.
    """
    hour = 3600
    cut = held.select(F.col("began").cast("double").alias("a"), F.col("ended").cast("double").alias("b"))
    hours = F.sequence(F.floor(F.col("a") / hour), F.floor(F.col("b") / hour))
    parts = cut.select("a", "b", F.explode(hours).alias("h")).select("h", F.greatest("a", F.col("h") * hour).alias("a"), F.least("b", (F.col("h") + 1) * hour).alias("b"))
    merged = _merged(parts, ["h"])
    whole = _merged(merged.withColumn("one", F.lit(1)), ["one"])
    gap = whole.select(F.lag("b").over(W.orderBy("a")).alias("x"), F.col("a").alias("y")).filter(F.col("y") - F.col("x") >= least_s)
    return gap.select(F.timestamp_micros((F.col("x") * 1_000_000).cast("long")).alias("began"), F.timestamp_micros((F.col("y") * 1_000_000).cast("long")).alias("ended"))


def _merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans a to b merged where they touch, within each group."""
    w = W.partitionBy(*by).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("n", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    grouped = marked.withColumn("g", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(*by, "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("g")
