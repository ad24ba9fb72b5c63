"""Strongly connected components and levels against brute force."""

import random

import pytest
from corvane.operators import graphs


def brute(edges):
    nodes = {x for e in edges if None not in e for x in e}
    out = {n: {b for a, b in edges if a == n and b is not None} for n in nodes}

    def reached(n):
        seen, todo = {n}, [n]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    reach = {n: reached(n) for n in nodes}
    part = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    inner = {(part[a], part[b]) for a in nodes for b in out[a] if part[a] != part[b]}
    level = dict.fromkeys(part.values(), 0)
    for _ in level:
        for a, b in inner:
            level[b] = max(level[b], level[a] + 1)
    return part, inner, level


def graph(kind):
    rng = random.Random(kind)
    if kind == "random":
        return [(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(55)]
    if kind == "hub":
        return [(0, n) for n in range(1, 60)] + [(n, 0) for n in range(1, 30)] + [(70 + n, 0) for n in range(20)]
    return [(i, i + 1) for i in range(9)] + [(9, 0), (20, 21), (21, 20), (21, 22), (22, 5), (22, 22), (30, 30), (None, 3), (3, None), (1, 2), (40, 39), (39, 38)]


@pytest.mark.parametrize(("kind", "least"), [("random", 1000), ("hub", 10), ("rings", 1000)])
def test_components_condensation_and_levels(spark, monkeypatch, kind, least):
    """Rings, chains against the order of ids, loops, null ends, and hubs apart."""
    monkeypatch.setattr(graphs, "LEAST_HUB", least)
    edges = graph(kind)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    parts = graphs.strongly_connected(df)
    part, inner, level = brute(edges)
    assert sorted(map(tuple, parts.collect())) == sorted(part.items())
    between = graphs.condensed(df, parts)
    assert {tuple(r) for r in between.collect()} == inner
    assert {tuple(r) for r in graphs.levels(between, parts).collect()} == set(level.items())
    if least == 10:
        assert graphs.Graph(df.selectExpr("src a", "dst b")).hubs["a"].collect()[0][0] == 0


def test_no_edges_and_a_cycle_without_levels(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graphs.strongly_connected(none).collect() == []
    ring = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    alone = spark.createDataFrame([(1, 1), (2, 2)], "node long, component long")
    with pytest.raises(RuntimeError, match="longer than 3"):
        graphs.levels(ring, alone, rounds=3)
