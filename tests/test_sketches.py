"""Sketches in parts and at levels against the rows."""

import pytest
from corvane.operators import sketches
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    n = spark.range(40_000)
    return n.select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 7)).alias("a"), (F.col("id") % 5).alias("b"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("d"), F.when(F.col("id") % 11 > 0, F.pow(F.rand(1), F.lit(4)) * 1000).alias("v"))


@pytest.mark.parametrize("by", [["a", "b"], ["a"], []])
@pytest.mark.parametrize("share", [0.05, 0.5, 0.99])
def test_levels_keep_their_bounds(rows, by, share):
    """A group of nulls as key, a hot group, and null values."""
    base = sketches.sketched(rows, ["a", "b"], F.col("d"), F.col("v"))
    told = sketches.estimated(sketches.rolled(base, by), by, {"x": share})
    got = sketches.verified(rows, told, by, F.col("d"), F.col("v"), "x", share).collect()
    assert len(got) == (40 + 5 if by == ["a", "b"] else 9 if by else 1) and all(r["distinct_near"] and r["rank_near"] for r in got)
    assert sum(r["n"] for r in got) == rows.filter("v is not null").count()


def test_parts_that_arrive_later_are_added(rows):
    whole = sketches.sketched(rows, ["a"], F.col("d"), F.col("v"))
    parts = sketches.sketched(rows.filter("b < 2"), ["a"], F.col("d"), F.col("v")).unionByName(sketches.sketched(rows.filter("b >= 2"), ["a"], F.col("d"), F.col("v")))
    told = lambda s: sorted(((r["a"] or "", r["n"], r["distinct_values"]) for r in sketches.estimated(s, ["a"], {}).collect()))
    joined, once = told(sketches.rolled(parts, ["a"])), told(whole)
    assert [x[:2] for x in joined] == [x[:2] for x in once]
    assert all(abs(x[2] - y[2]) <= 0.1 * y[2] for x, y in zip(joined, once, strict=True))


def test_groups_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("x", None, None), ("y", 1, 2.0)], "k string, d long, v double")
    told = {r["k"]: r for r in sketches.estimated(sketches.sketched(df, ["k"], F.col("d"), F.col("v")), ["k"], {"m": 0.5}).collect()}
    assert (told["x"]["n"], told["x"]["distinct_values"], told["x"]["m"]) == (0, 0, None) and (told["y"]["n"], told["y"]["m"]) == (1, 2.0)
    assert sketches.estimated(sketches.sketched(df.limit(0), ["k"], F.col("d"), F.col("v")), ["k"], {"m": 0.5}).collect() == []
