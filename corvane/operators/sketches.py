"""Stored sketches of groups: distinct values and quantiles, rolled up to coarser groups without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch of distinct values are 2 to this power (a standard error of 1.6 %, exact-like while few); size of a sketch of quantiles
#: (ranks within 0.5 % in 99 of 100 cases).
REGISTERS, QUANTILES = 12, 800
#: Bounds that hold but for a rare case: three standard errors of a count, and of a rank.
COUNT_ERROR, RANK_ERROR = 0.05, 0.01


def sketched(rows: DataFrame, by: Sequence[str], distinct: Column, value: Column) -> DataFrame:
    """by, seen (a sketch of distinct values) and spread (one of quantiles): a row a group, of some kilobytes.

    Tasks sketch their own rows, so what is shuffled is a sketch a task and group, however many rows a group has.
    Nulls are in neither; a group of nulls alone has empty sketches.
    """
    return rows.groupBy(*by).agg(F.hll_sketch_agg(distinct, REGISTERS).alias("seen"), F.kll_sketch_agg_double(value.cast("double"), QUANTILES).alias("spread"))


def rolled(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups, or of more rows: of stored ones and those of what has arrived since, by union."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("seen").alias("seen"), F.kll_merge_agg_double("spread").alias("spread"))


def estimated(sketches: DataFrame, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """by, n (values, exact), distinct_values, and for each name in shares the value at that share; null where there is none."""
    n = F.kll_sketch_get_n_double("spread")
    at = lambda share: F.when(n > 0, F.kll_sketch_get_quantile_double("spread", F.lit(share)))
    return sketches.select(*by, n.alias("n"), F.hll_sketch_estimate("seen").alias("distinct_values"), *(at(share).alias(name) for name, share in shares.items()))


def verified(rows: DataFrame, estimates: DataFrame, by: Sequence[str], distinct: Column, value: Column, name: str, share: float) -> DataFrame:
    """by, n, distinct_near, rank_near: whether the estimates of ``name`` keep their bounds, against all the rows.

    A value is near a share of the rows when no more than that and RANK_ERROR are less, and no fewer than that less
    RANK_ERROR are less or equal; in small groups one row may be more.
    """
    held = rows.select(*by, distinct.alias("__d"), value.cast("double").alias("__v"))
    told = estimates.select(*(F.col(c).alias(f"__{c}") for c in by), "n", "distinct_values", F.col(name).alias("__at"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = held.join(F.broadcast(told), on) if not by else held.join(told, on)  # one row without groups
    sums = both.groupBy(*by, "n", "distinct_values", "__at").agg(F.count_distinct("__d").alias("d"), F.count_if(F.col("__v") < F.col("__at")).alias("less"), F.count_if(F.col("__v") <= F.col("__at")).alias("upto"))
    room = F.lit(RANK_ERROR) * F.col("n") + 1
    near = F.coalesce((F.col("less") <= F.lit(share) * F.col("n") + room) & (F.col("upto") >= F.lit(share) * F.col("n") - room), F.col("n") == 0)
    return sums.select(*by, "n", (F.abs(F.col("distinct_values") - F.col("d")) <= F.lit(COUNT_ERROR) * F.col("d") + 1).alias("distinct_near"), near.alias("rank_near"))
