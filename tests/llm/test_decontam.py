import brute
import pytest
from brute import pulled
from corvane.llm import decontam

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs far away from all of it"),
    (2, "short item"),
    (3, None),
    (None, "no identifier here"),
    (4, "!!! ..."),
    (5, "over the lazy dog and then runs far away from all of it and more"),
    (2, "another text for two"),
    (6, "élan vital ÜBER alles"),
]
TEXTS = [
    (1, "x y. The QUICK brown fox, jumps over the lazy dog and then runs far-away from all! of it z"),
    (2, "a Short  item; short item"),
    (3, None),
    (4, ""),
    (5, "--- !!"),
    (6, "short"),
    (7, "nothing of it " * 3000 + "another text for two"),
    (8, "élan vital ÜBER alles und élan vital Über alles"),
    (None, "short item"),
    (2, "a Short  item; short item"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in TEXTS], "doc_id long, text string, n_hit int, items string")
    return docs, spark.createDataFrame([(*x, "e") for x in ITEMS], "item_id long, text string, k string")


@pytest.mark.parametrize("most", [50_000, 3])
def test_hits_equal_brute_force_with_one_automaton_and_with_blocks(tables, most):
    docs, items = tables
    known = [(str(i), t) for i, t in ITEMS if i is not None]
    rows = decontam.contamination(docs, items, block_windows=most).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows), key=repr)
    want = []
    for i, t in TEXTS:
        n, h, names = brute.contamination(t, known)
        want.append((i, n, h, names, h > 0 and 20 * h >= n))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("most", [50_000, 3])
def test_spans_are_places_of_the_original_text(tables, most):
    docs, items = tables
    first = {r["doc_id"]: r for r in decontam.contamination(docs, items, block_windows=most).collect()}
    s = first[1]["spans"][0]
    assert TEXTS[0][1][s["start"] : s["end"]] == "The QUICK brown fox, jumps over the lazy dog and then runs far-away from all! of it"
    s = first[8]["spans"][0]
    assert TEXTS[7][1][s["start"] : s["end"]] == "élan vital ÜBER alles"


def test_no_items_and_no_documents(spark, docs, no_docs, tables):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not [r for r in decontam.contamination(docs, nothing).collect() if r["contaminated"]]
    assert decontam.contamination(no_docs, tables[1]).collect() == []


def test_flag_keeps_all_columns(docs, tables):
    out = decontam.flagged(docs, tables[1], "__flag")
    assert out.columns == [*docs.columns, "__flag"] and out.count() == docs.count()
    assert pulled(out, "doc_id", "text") == pulled(docs, "doc_id", "text")
