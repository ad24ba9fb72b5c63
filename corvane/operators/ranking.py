"""Order, limits and budgets. Every order states where nulls go and ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group, with place from 1. Spark keeps n rows a group before it shuffles."""
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows with rank from 1 without gaps: cut by a top-k first, so that the numbering sees few rows."""
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def fit_budget(rows: DataFrame, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order while their costs together stay within the budget, with used, the running sum.

    Costs count at least 1, so no more than ``budget`` rows can fit: a top-k of that many goes first, and the running
    sum over one partition never sees more.
    """
    priced = rows.withColumn("cost", F.greatest(F.coalesce(cost, F.lit(1)), F.lit(1)).cast("long"))
    first = priced.orderBy(*order).limit(max(0, budget))
    run = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return first.withColumn("used", F.sum("cost").over(run)).filter(F.col("used") <= budget)


def breadth(rows: DataFrame, score: str, tie: str, wanted: int = 0, window: int = 10) -> DataFrame:
    """The best ``wanted`` rows; with 0, those before the largest relative gap among the best ``window``."""
    order = [F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last()]
    if wanted:
        return ranked(rows, order, wanted)
    best = ranked(rows, order, window)
    after = F.lead(score).over(W.orderBy("rank"))
    gap = F.when(F.col(score) > 0, (F.col(score) - after) / F.col(score))
    gaps = best.withColumn("__gap", gap)
    cut = F.first(F.when(F.col("__gap") == F.max("__gap").over(W.partitionBy()), F.col("rank")), ignorenulls=True)
    return gaps.withColumn("__cut", cut.over(W.partitionBy().orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).filter(F.col("__cut").isNull() | (F.col("rank") <= F.col("__cut"))).drop("__gap", "__cut")


def shared_limit(answers: DataFrame, target: str, position: str, count: str, most: int = 5, targets: int = 8) -> DataFrame:
    """Targets in order until ``most`` entries are shown or ``targets`` are tried; shown says how many each may show.

    A repeated target counts where it first stands. An answer counts at least 1 while it is not empty, an empty one 0.
    """
    first = answers.groupBy(target).agg(F.min(position).alias(position), F.min_by(count, position).alias(count))
    tried = first.orderBy(F.col(position).asc_nulls_last(), target).limit(targets)
    before = F.coalesce(F.sum(count).over(W.orderBy(position, target).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = tried.withColumn("__left", F.lit(most) - before)
    return left.filter(F.col("__left") > 0).withColumn("shown", F.least(F.col(count), F.col("__left")).cast("long")).drop("__left")


def representation(budget_per_file: Column) -> Column:
    """What a file is shown as: its headline, its structure from 500 tokens a file, its content from 2000."""
    return F.when(budget_per_file >= 2000, "content").when(budget_per_file >= 500, "structure").otherwise("headline")


def near_best(rows: DataFrame, score: str, share: float = 0.5) -> DataFrame:
    """Rows that score at least a share of the best: a threshold taken from the answer itself."""
    best = rows.agg(F.max(score).alias("__best"))
    return rows.join(F.broadcast(best)).filter(F.col(score) >= F.col("__best") * share).drop("__best")  # one row


def within(rows: DataFrame, most: int) -> DataFrame:
    """All rows, however many, with fits: whether the scope holds no more than ``most`` of them. The count stops beyond that."""
    found = rows.select(F.lit(1)).limit(most + 1).agg((F.count("*") <= most).alias("fits"))
    return rows.join(F.broadcast(found))  # one row


def at_most(rows: DataFrame, most: int, what: str = "files") -> DataFrame:
    """rows, or an error that asks for a narrower scope when there are more."""
    found = rows.limit(most + 1).count()
    if found > most:
        raise ValueError(f"the scope holds more than {most} {what}: narrow it")
    return rows
