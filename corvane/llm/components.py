"""Connected components by alternating stars, with no link ever sent to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _marks(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the links: equal in two rounds only when nothing moved."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of that node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component): each linked node with the least node that it reaches.

    Every round is a few aggregations and equi-joins on the links that are left, kept by a reliable checkpoint; the
    rounds grow with the logarithm of the longest chain. Self links and nulls carry no information and go first.
    An empty table gives an empty table. Not converging within ``rounds`` is an error, never a partial result.
    """
    edges = settle(edges.filter("a <> b").select("a", "b").distinct())
    before = _marks(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        edges = settle(_small_star(_large_star(edges)))
        after = _marks(edges)
        if after == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
