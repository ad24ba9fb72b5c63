"""The inverted index against scores that read every text."""

import random

import pytest
from corvane.operators import postings, search
from pyspark.sql import functions as F


def texts():
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))) for i in range(400)]
    return [*out, (900, None), (901, ""), (902, "w1 " * 3000 + "Rare É w2"), (903, "!! --")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, df, tmp_path_factory):
    return postings.TextIndex(spark, str(tmp_path_factory.mktemp("index")), "doc_id").build(df)


def same(got, want):
    return sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("query", ["w1 w3", "rare é", "w7 w7 nowhere", "nowhere", ""])
def test_scores_equal_a_scan(df, index, query):
    assert same(index.bm25(query), search.bm25(df, query, "doc_id"))
    assert same(index.vector_scores(query), search.vector_scores(df, query, "doc_id"))
    assert same(index.explore(query, "w2 rare"), search.explore(df, query, "w2 rare", "doc_id")) or not query


def test_top_of_many_ranges_skips_blocks_and_stays_exact(spark, df, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 8)
    monkeypatch.setattr(postings, "FIRST", 2)
    index = postings.TextIndex(spark, str(tmp_path), "doc_id").build(df)
    words = ["w1", "w40"]
    best = search.bm25(df, "w1 w40", "doc_id").orderBy(F.col("score").desc(), "doc_id").limit(7).collect()
    assert [(r["doc_id"], r["score"]) for r in index.top("w1 w40", 7).collect()] == [(r["doc_id"], r["score"]) for r in best]
    bounds = index.bounds(words, index._frequencies(words))
    true = {}
    for r in index.blocks(index.segments[0], words).select("r", F.explode("keys").alias("k")).distinct().collect():
        true.setdefault(r["r"], []).append(r["k"])
    scores = {r["doc_id"]: r["score"] for r in search.bm25(df, "w1 w40", "doc_id").collect()}
    assert all(max(scores[k] for k in true[r["r"]]) <= r["bound"] + 1e-9 for r in bounds.collect())
    assert bounds.filter(F.col("bound") < best[-1]["score"]).count() > 0  # some ranges cannot hold one of the best


def test_changed_documents_replace_what_was(spark, df, index, tmp_path):
    own = postings.TextIndex(spark, str(tmp_path), "doc_id").build(df)
    first = spark.createDataFrame([(3, "w1 brand new"), (5, None), (2000, "w3 w1 brand")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "w3 only"), (2001, "brand brand")], "doc_id long, text string")
    own.upsert(first)
    again = postings.TextIndex(spark, str(tmp_path), "doc_id")  # another reader sees the version
    assert again.version == 2
    again.upsert(second)
    now = df.join(first, "doc_id", "left_anti").unionByName(first).join(second, "doc_id", "left_anti").unionByName(second)
    for query in ("w1 w3", "brand", "new only"):
        assert same(again.bm25(query), search.bm25(now, query, "doc_id"))
        assert same(again.vector_scores(query), search.vector_scores(now, query, "doc_id"))
        want = search.bm25(now, query, "doc_id").orderBy(F.col("score").desc(), "doc_id").limit(5).collect()
        assert [(r["doc_id"], r["score"]) for r in again.top(query, 5).collect()] == [tuple(r) for r in want]
    with pytest.raises(RuntimeError, match="written by another"):
        own.upsert(first)  # it has not seen version 3


def test_a_query_reads_its_own_words_and_no_text(index):
    found = index.bm25("w1 w3")
    assert "In(term, [w1,w3])" in found._jdf.queryExecution().executedPlan().toString()
    assert all("/terms/bucket=" in x for x in found.inputFiles())


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    empty = postings.TextIndex(spark, str(tmp_path / "a"), "doc_id")
    assert empty.bm25("x").collect() == [] and empty.top("x", 3).collect() == []
    built = postings.TextIndex(spark, str(tmp_path / "b"), "doc_id").build(none)
    assert built.bm25("x").collect() == [] and built.explore("x").collect() == []
