import os

import brute
import corpus_pipeline
import pytest
from corvane.llm import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables are not here")


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_leave_one_of_each_group(spark, docs, texts):
    out = corpus_pipeline.first_of_group(spark, docs, "")
    assert out.columns == docs.columns
    prints = [brute.fingerprint(t) for _, t, *_ in texts]
    groups = brute.components([i for i, *_ in texts], prints)
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(k for k in kept if k is not None) == sorted({g for g in groups if g is not None})
    alone = {brute.fingerprint(t) for i, t, *_ in texts if i is None} - {p for p, g in zip(prints, groups, strict=True) if g is not None}
    assert kept.count(None) == len(alone)


def test_repeated_rows_of_one_document_leave_one(spark):
    rows = [(1, "the same words in a row here", "en", "a", 1)] * 3 + [(2, "something else is said in this one", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.first_of_group(spark, df, "").collect()) == [1, 2]


@needs_data
def test_texts_in_no_language_are_rejected_by_their_score(spark):
    import random

    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)) for n in (3000, 4000, 5000)]
    odd = spark.createDataFrame([(10**9 + i, t, None, "src0", len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert len({i for i in kept if i >= 10**9}) < 3
    assert len({i for i in kept if i < 10**9}) >= 0.97 * docs.select("doc_id").distinct().count()


@needs_data
def test_every_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.known_language(spark, docs, SF)
    assert one.columns == docs.columns and docs.count() - 5 <= one.count() <= docs.count()
    two = corpus_pipeline.first_of_group(spark, docs, SF)
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute.components(ids, [brute.fingerprint(texts[i]) for i in ids])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(want))
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = {r["doc_id"] for r in corpus_pipeline.clean_of_benchmarks(spark, docs, SF).collect()}
    for i in ids:
        n, hit, _ = brute.contamination(texts[i], items)
        assert (i in three) == (not (hit and 20 * hit >= n))
    four = corpus_pipeline.mixed(spark, docs, SF)
    assert four.columns == docs.columns and four.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    five = corpus_pipeline.sharded(spark, four, SF)
    assert sorted(r["doc_id"] for r in five.collect()) == sorted(r["doc_id"] for r in four.collect())


@needs_data
def test_run_ends_with_shards(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "shard", "tier", "shard_docs", "version"] and out.count() > 0


def test_the_pipeline_takes_empty_documents(spark, no_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = no_docs
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
    assert df.collect() == []


def test_the_pipeline_takes_odd_documents(spark, docs, tmp_path):
    spark.createDataFrame([(1, "Two words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = docs
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_equal_their_sql(spark, name):
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    said = con.execute(registry.ORACLE[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(row[i] for i in order)) for row in said.fetchall())
