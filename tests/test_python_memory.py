"""What Python workers hold: slices of texts as plain values, whatever a batch holds."""

import tracemalloc
from functools import lru_cache

import pyarrow as pa
import pytest
from corvane.operators import postings, search


def test_a_posting_is_no_object_of_its_own():
    texts = pa.array([[f"w{(i * 31 + j) % 5000}" for j in range(300)] for i in range(postings.SLICE)])
    place = lru_cache(maxsize=None)(search.place_of)
    postings.postings_of(texts, place)
    tracemalloc.start()
    out = postings.postings_of(texts, place)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(len(x) for x in out.field("terms").to_pylist())
    assert held == 300 * postings.SLICE and peak < 200 * held  # as a dict each was some 500 bytes


@pytest.mark.parametrize("slice_", [1, 3])
def test_slices_change_nothing(spark, tmp_path, monkeypatch, slice_):
    rows = [(1, "Heron thre nation heron"), (2, None), (3, ""), (4, "--"), (5, "the Été nation"), (6, "heron"), (7, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(search, "SLICE", 100)
    monkeypatch.setattr(postings, "SLICE", 100)
    said = lambda x: sorted(map(tuple, x.collect()))
    whole = said(search.vector_scores(df, "heron été", "doc_id")), said(search.explore(df, "heron", "nation", "doc_id"))
    monkeypatch.setattr(search, "SLICE", slice_)
    monkeypatch.setattr(postings, "SLICE", slice_)
    index = postings.TextIndex(spark, str(tmp_path), "doc_id").build(df)
    assert (said(search.vector_scores(df, "heron été", "doc_id")), said(search.explore(df, "heron", "nation", "doc_id"))) == whole
    assert (said(index.vector_scores("heron été")), said(index.explore("heron", "nation"))) == whole


def test_counts_are_passed_on_by_few(spark, monkeypatch):
    assert search.COUNTED <= 100_000
    rows = [("Heron thre heron",), (None,), ("",), ("thre nation",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    for most in (0, 1, 100):
        monkeypatch.setattr(search, "COUNTED", most)
        assert {tuple(r) for r in search.word_counts(df, "text", ["nation"]).collect()} == {("heron", 1, 0), ("thre", 2, 1), ("nation", 1, 1)}
