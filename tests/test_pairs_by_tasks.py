"""What makes many rows of few is dealt by how many it makes."""

from corvane.operators import joins, retrieve


def test_pairs_and_changes_are_dealt_by_their_number(spark, monkeypatch):
    changes = spark.createDataFrame([(h, f) for h in range(6) for f in range(h, h + 5)], "hash long, file long").coalesce(1)
    commits = spark.createDataFrame([(h, h % 2) for h in range(6)], "hash long, author long")
    monkeypatch.setattr(joins, "TASK_PAIRS", 7)
    monkeypatch.setattr(retrieve, "TASK_CHANGES", 4)
    pairs = joins.co_change(changes)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    want = {}
    for h in range(6):
        for a in range(h, h + 5):
            for b in range(a + 1, h + 5):
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["together"] for r in pairs.collect()} == want
    hot = retrieve.hotspots(commits, changes, 3)
    assert "REPARTITION_BY_NUM" in hot._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in hot.collect()] == [(4, 5, 2), (5, 5, 2), (3, 4, 2)]
    assert joins.co_change(changes.limit(0)).collect() == [] and retrieve.hotspots(commits, changes.limit(0), 3).collect() == []
