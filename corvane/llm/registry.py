"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, neighbours, oracle, pii, preference, quality, resampling, secrets, sharding, simhash, warc, whitening
from .common import fresh_dir, table


#: The key of the registered query; whoever replaces data of their own brings a secret one.
QUERY_KEY = "key of the registered query"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)),
        F.sha2("base_list", 256).alias("base_sha256"),
        F.col("all_list").alias("spans"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents"), F.array(F.col("source").cast("string")))
    rows = mix.chosen().withColumn("s", F.try_element_at("members", F.lit(1)))
    sources = mix.sources(spark)
    return rows.join(sources, rows["s"].eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Arrivals that the documents come in, and after how many the store is compacted.
ARRIVALS, BETWEEN = 8, 4


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after all arrivals, with compaction between them."""
    store = sharding.Store(spark, fresh_dir(spark, "store"), small=8 << 20, target=64 << 20)
    for number, docs in enumerate(sharding.arrivals(table(spark, sf_dir, "documents"), ARRIVALS), 1):
        store.append(docs)
        if number % BETWEEN == 0 or number == ARRIVALS:
            store.compact()
            store.vacuum()
    return store.placed()


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.checked(pii.surrogates(table(spark, sf_dir, "documents"), QUERY_KEY))
    count = lambda *k: F.size(F.filter("entities", lambda x: x.kind.isin(*k))).cast("long")
    return done.select(
        "doc_id",
        F.size("entities").cast("long").alias("n_entities"),
        count("email").alias("n_email"),
        count("ip").alias("n_ip"),
        count("phone", "local_phone").alias("n_phone"),
        count("card", "iban", "ssn").alias("n_number"),
        count("name").alias("n_name"),
        "distinct_kept",
        "text",
    )


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), at)
    return warc.captures(spark, at)


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with a reply of its partner; 2k and 2k + 1 are partners. Texts are told by digests."""
    pair, second = F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 1  # whole numbers, also below zero
    rows = preference.alternatives(table(spark, sf_dir, "conversations"), pair, second)
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.start, x.end)), ",")
    return rows.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        "chosen_turns",
        "rejected_turns",
        *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")),
        mask("chosen_mask").alias("chosen_mask"),
        mask("rejected_mask").alias("rejected_mask"),
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_copies(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules,
        op2_secret_scan,
        op3_sharding,
        op4_pii_surrogates,
        op5_language_id,
        op6_source_mixing,
        op7_decontamination,
        op8_simhash_dedup,
        op9_warc_transactions,
        op10_preference_pairs,
        op11_embedding_dedup,
        op12_embedding_whitening,
        op13_importance_resampling,
    )
}
ORACLE: dict[str, str] = oracle.every()
