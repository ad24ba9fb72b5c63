"""Strongly connected components of a directed graph, its condensation, and levels of that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

#: Edges of a node from which on it counts as a hub, at least; there are at most MOST_HUBS, which are sent to every task.
LEAST_HUB, MOST_HUBS = 1000, 5000
#: Steps along the edges between two looks at whether anything still moves.
HOPS = 3


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges that lie on a way from a cycle to a cycle, and their number: again and again without those whose start has no edge in or whose end none out."""
    edges = settle(edges)
    n = edges.count()
    while n:
        now = edges
        for _ in range(HOPS):
            now = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            now = now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        now = settle(now)
        m = now.count()
        if m == n:
            return now, n
        edges, n = now, m
    return edges, n


class Graph:
    """Distinct edges a -> b between different nodes, kept, with the hubs on either side; trimmed: without what can be on no cycle."""

    def __init__(self, edges: DataFrame, trimmed: bool = False):
        edges = edges.filter("a <> b").distinct()
        if trimmed:
            self.edges, self.n = _trimmed(edges)
        else:
            self.edges = settle(edges)
            self.n = self.edges.count()
        self.hubs = {c: self._hubs(c) for c in ("a", "b")} if self.n > LEAST_HUB else {}

    def _hubs(self, side: str) -> DataFrame | None:
        degree = self.edges.groupBy(side).agg(F.count("*").alias("n")).filter(F.col("n") > max(LEAST_HUB, self.n // MOST_HUBS))
        found = settle(degree.select(F.col(side).alias("node")))
        return None if found.isEmpty() else found

    def meet(self, values: DataFrame, side: str) -> DataFrame:
        """The edges with the columns of values (node, ...) of the node on that side.

        Edges of hubs stay where they are, as their few values come to them; the others meet in a shuffle.
        """
        hubs = self.hubs.get(side)
        on = lambda e, v: e.join(v, e[side] == v["node"]).drop("node")
        if hubs is None:
            return on(self.edges, values)
        few = F.broadcast(values.join(F.broadcast(hubs), "node", "left_semi"))  # MOST_HUBS rows at most
        cold = self.edges.join(F.broadcast(hubs.withColumnRenamed("node", side)), side, "left_anti")
        return on(cold, values).unionByName(on(self.edges, few))

    def least(self, values: DataFrame, along: bool = True, within: bool = False) -> DataFrame:
        """values (node, c[, o]) with the least c that reaches each node along the edges (or against them), within nodes of one o if asked."""
        start, end = ("a", "b") if along else ("b", "a")
        values = settle(values)
        while True:
            now = values
            for _ in range(HOPS):
                sent = self.meet(now, start).withColumnRenamed(end, "node")
                if within:
                    sent = sent.groupBy("node", "o").agg(F.min("c").alias("m"))
                    now = now.join(sent, ["node", "o"], "left")
                else:
                    now = now.join(sent.groupBy("node").agg(F.min("c").alias("m")), "node", "left")
                now = now.withColumn("c", F.least("c", "m")).drop("m")
            now = settle(now)
            moved = now.alias("x").join(values.alias("y"), "node").filter("not (x.c <=> y.c)")
            if moved.isEmpty():
                return now
            values = now


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 1000) -> DataFrame:
    """node, component of every node of an edge: the least node of those that it reaches and that reach it, itself included.

    Colouring: the least node that reaches a node is its colour; from each node of its own colour, those of the colour
    that reach it are its component. What is on no way between cycles is one alone, and goes first. The rest goes on
    with the edges within a colour. Edges with a null end carry nothing; loops and repeats do no harm. Not ending within ``rounds``
    is an error.
    """
    rows = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    left = settle(rows.select(F.col("a").alias("node")).unionByName(rows.select(F.col("b").alias("node"))).distinct())
    graph, done = Graph(rows, trimmed=True), None
    for _ in range(rounds):
        if not graph.n:
            last = left.select("node", F.col("node").alias("component"))
            return last if done is None else done.unionByName(last)
        inner = settle(graph.edges.select(F.col("a").alias("node")).unionByName(graph.edges.select(F.col("b").alias("node"))).distinct())
        alone = left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
        coloured = graph.least(inner.select("node", F.col("node").alias("c")))
        back = coloured.select("node", F.col("c").alias("o"), F.when(F.col("c") == F.col("node"), F.col("c")).alias("c"))
        found = graph.least(back, along=False, within=True)
        own = found.filter("c is not null").select("node", F.col("o").alias("component"))
        new = own.unionByName(alone)
        done = settle(new if done is None else done.unionByName(new))
        rest = found.filter("c is null").select("node", "o")
        left = settle(rest.select("node"))
        kept = graph.meet(rest.select("node", F.col("o").alias("x")), "a").join(rest.select(F.col("node").alias("b"), F.col("o").alias("y")), "b").filter("x = y")
        graph = Graph(kept.select("a", "b"), trimmed=True)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def condensed(edges: DataFrame, parts: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src, dst: the distinct edges between different components."""
    graph = Graph(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null"))
    half = graph.meet(parts.select("node", F.col("component").alias("s")), "a")
    both = half.join(parts.select(F.col("node").alias("b"), F.col("component").alias("d")), "b")
    return both.filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def levels(edges: DataFrame, parts: DataFrame, rounds: int = 1000) -> DataFrame:
    """component, level of an acyclic graph (src, dst) over all components: the longest path that leads to it.

    Each step looks at the components that moved in the one before alone. A cycle is an error.
    """
    graph = Graph(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    known = settle(parts.select(F.col("component").alias("node")).distinct().withColumn("n", F.lit(0).cast("long")))
    front = known
    for _ in range(rounds):
        sent = graph.meet(front, "a").groupBy(F.col("b").alias("node")).agg((F.max("n") + 1).alias("m"))
        moved = settle(sent.join(known, "node").filter("m > n").select("node", F.col("m").alias("n")))
        if moved.isEmpty():
            return known.select(F.col("node").alias("component"), F.col("n").alias("level"))
        known = settle(known.unionByName(moved).groupBy("node").agg(F.max("n").alias("n")))
        front = moved
    raise RuntimeError(f"a path is longer than {rounds}, or a cycle is left")
