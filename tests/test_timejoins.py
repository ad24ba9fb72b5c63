"""Joins by time against brute force, with a key that holds most rows, ties, nulls and clashing columns."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from corvane.operators import timejoins
from pyspark.sql import functions as F

BEGAN = datetime(2024, 1, 1)


def moment(s):
    return None if s is None else BEGAN + timedelta(seconds=s)


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([rng.randint(0, 3000), rng.randint(0, 3000), 77, None])) for i in range(n)]


LEFT, RIGHT = rows(700, 1), rows(400, 2)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(i, k, moment(t), "x") for i, k, t in LEFT], "id long, key string, at timestamp, __p string").repartition(5)
    right = spark.createDataFrame([(i, k, moment(t)) for i, k, t in RIGHT], "n long, who string, since timestamp").repartition(3)
    return left, right


@pytest.mark.parametrize("tolerance", [None, 40])
def test_as_of_equals_brute_force_over_many_partitions(spark, sides, tolerance):
    def want(k, t):
        met = [(s, n) for n, w, s in RIGHT if w is not None and w == k and s is not None and t is not None and s <= t]
        best = max(met, default=None)
        return None if best is None or (tolerance is not None and t - best[0] > tolerance) else best[1]

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight ranges, of which the hot key is most
    try:
        got = timejoins.as_of(*sides, [("key", "who")], "at", "since", ["n"], tolerance, "n")
        assert got.columns == ["id", "key", "at", "__p", "since", "n"]
        assert Counter((r["id"], r["n"]) for r in got.collect()) == Counter((i, want(k, t)) for i, k, t in LEFT)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_hot_key_is_many_partitions(spark):
    left = spark.range(20_000).select(F.lit("one").alias("key"), F.timestamp_seconds("id").alias("at"))
    right = spark.createDataFrame([("one", moment(0).timestamp(), 5)], "who string, s double, n long").select("who", F.timestamp_seconds(F.lit(100)).alias("since"), "n")
    got = timejoins.as_of(left, right, [("key", "who")], "at", "since", ["n"])
    assert got.filter("n = 5").count() == 19_900  # one right row, carried through all ranges after its own


def test_nothing_on_one_side(spark, sides):
    left, right = sides
    assert timejoins.as_of(left, right.limit(0), [("key", "who")], "at", "since", ["n"]).filter("n is not null").count() == 0
    assert timejoins.as_of(left.limit(0), right, [("key", "who")], "at", "since", ["n"]).collect() == []


def test_spans_of_any_length(spark, sides):
    rng = random.Random(5)
    spans = [(rng.choice(["hot", "a", None]), b, b + rng.choice([0, 1, 59, 60, 400, 3000, 10**8]), n) for n, b in enumerate(rng.choices(range(3000), k=60))] + [("a", 50, 10, 99), ("a", None, 10, 98)]
    df = spark.createDataFrame([(w, moment(b), moment(e), n) for w, b, e, n in spans], "who string, began timestamp, ended timestamp, span long")
    got = timejoins.in_spans(sides[0], df, ("key", "who"), "at", "began", "ended")
    want = Counter((i, n) for i, k, t in LEFT for w, b, e, n in spans if k is not None and k == w and t is not None and b is not None and b <= t <= e)
    assert Counter((r["id"], r["span"]) for r in got.collect()) == want
    assert timejoins.in_spans(sides[0], df.limit(0), ("key", "who"), "at", "began", "ended").collect() == []
