"""A corpus from raw documents: language, near-duplicates, contamination, mixture, shards.

Every stage takes (spark, docs, sf_dir), works on all the rows it is given and returns documents of the same columns,
the last one where each document lies. Null ids and texts, repeated rows and extra columns go through as the operators
say; names used on the way start with __corvane and don't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, langid, mixing, sharding, simhash
from corvane.llm.common import col, fresh_dir, keep_columns, settle, table
from corvane.operators.lineage import remove

#: Shards of the corpus: a first-tier shard and a full one, in bytes.
SMALL_SHARD, FULL_SHARD = 8 << 20, 128 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones.

    Texts that are null, empty or without a letter go, and those that score below langid.least_score(). Repeated rows
    share their text's fate. The network learns from all labelled documents that are not held out, and the least score
    is set by all that are. Without a labelled document nothing is known and nothing stays.
    """
    model = langid.learn(docs, "doc_id", "text", "lang")
    least = langid.least_score(model, docs, "doc_id", "text", "lang") if model else 0.0
    said = docs.withColumn("__corvane_said", langid.said(spark, model, F.col("text")))
    kept = (F.col("__corvane_said.lang_pred") != langid.UNKNOWN) & (F.col("__corvane_said.score") >= least)
    return keep_columns(said.filter(kept), docs.columns)


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked fingerprints, once; a group without ids keeps one row.

    Texts are read for the fingerprints and once more to return the chosen ones; what decides is a narrow table keyed
    by id and a hash of the text.
    """
    narrow = simhash.clusters(docs, carry={"__corvane_h": F.xxhash64(F.col("text"))})
    chosen = narrow.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = chosen.groupBy("root").agg(F.first("doc_id").alias("__corvane_id"), F.min("__corvane_h").alias("__corvane_h"), F.count("*").alias("__corvane_n"))
    one = settle(one.drop("root"))
    hashed = docs.withColumn("__corvane_t", F.xxhash64(F.col("text")))
    on = hashed["doc_id"].eqNullSafe(one["__corvane_id"]) & (hashed["__corvane_t"] == one["__corvane_h"])
    kept = hashed.join(one, on)
    if not one.filter("__corvane_n > 1").isEmpty():  # rows of one id and one text: the first stays
        twice = kept.filter("__corvane_n > 1").dropDuplicates(["__corvane_id", "__corvane_h"])
        kept = kept.filter("__corvane_n = 1").unionByName(twice)
    return keep_columns(kept, docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; null and empty texts are clean, repeated rows stay."""
    found = decontam.flagged(docs, table(spark, sf_dir, "benchmark"), "__corvane_hit")
    return keep_columns(found.filter("not __corvane_hit"), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; null and blank texts are never taken."""
    carry = {f"__corvane_{i}": col(name) for i, name in enumerate(docs.columns)}
    rows = mixing.Mix(docs, F.array(F.col("source").cast("string"))).copies(docs, carry)
    return rows.select(*(F.col(f"__corvane_{i}").alias(name) for i, name in enumerate(docs.columns)))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mix: doc_id, shard, tier, shard_docs, version. Nulls and repeats are stored as they are."""
    store = sharding.Store(spark, fresh_dir(spark, "shards"), SMALL_SHARD, FULL_SHARD)
    store.append(docs)
    store.compact()
    store.vacuum()
    return store.placed()


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", first_of_group),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]
#: Neither the network nor XXH64 fingerprints can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote goes once the next one has."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs, at = stage(spark, docs, sf_dir), None
        if number < len(STAGES) - 1:
            at = fresh_dir(spark, f"stage{number}")
            docs.write.parquet(at)
            docs = spark.read.schema(docs.schema).parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
