"""Registered queries on tables that the shared ones don't resemble."""

from corvane import catalog
from corvane.operators import ranking


def test_a_scope_beyond_the_ceiling_is_answered_whole(spark, tmp_path):
    for n, fits in ((5, True), (6, False)):
        assert [tuple(r) for r in ranking.within(spark.range(n), 5).orderBy("id").collect()] == [(i, fits) for i in range(n)]
    assert ranking.within(spark.range(0), 5).collect() == []
    rows = [(i, "es", "src1" if i < 200 else "src2", "text") for i in range(210)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.queries()["t11_scope_ceiling"](spark, str(tmp_path))
    assert sorted(r["uri"] for r in got.collect()) == sorted(f"doc:///es/src1/{i}" for i in range(200))


def test_symbols_are_counted_by_page_where_pages_share_a_url(spark, tmp_path):
    html = "<title>a</title><h1>b</h1>"
    pages = [(1, "u", html), (2, "u", html), (3, "v", html), (4, None, html), (5, "w", "no symbols"), (6, "w", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality long").write.parquet(str(tmp_path / "labels.parquet"))
    got = catalog.queries()["g09_file_coverage"](spark, str(tmp_path)).select("url", "symbols", "covered", "uncovered", "unmeasured")
    assert {tuple(r) for r in got.collect()} == {("u", 4, 2, 2, 0), ("v", 2, 0, 0, 2), (None, 2, 2, 0, 0)}
