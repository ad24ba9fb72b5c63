"""Importance resampling towards a target: hashed n-grams, gains of buckets, Gumbel scores, ranks by partition offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, settle, spread

#: Buckets of the n-grams, and the longest run of words.
BUCKETS, RUN = 10_000, 2
#: Scores count thousandths; share drawn in per cent, of the documents of that many words or more; seed of the draw.
UNIT, SHARE, LEAST_WORDS, SEED = 1000, 25, 20, 7
#: What parts words: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words as they are written; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _lowered(word: Column) -> Column:
    """A word with A-Z in lower case; lower() is much faster than translate(), but right for ASCII alone."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _starts(w: Column, run: int) -> Column:
    """For each word the ``run`` words from it on, null where the text ends: an array of structs w0, w1, ..."""
    later = [F.slice(w, F.lit(k + 1), F.greatest(F.size(w) - k, F.lit(0))).alias(f"w{k}") for k in range(run)]
    return F.arrays_zip(*later)


def _buckets(start: str, run: int, buckets: int) -> list[Column]:
    """The bucket of the run of each length that begins here; null where the text ends before it does."""
    held = [_lowered(F.col(f"{start}.w{k}")) for k in range(run)]
    joined = [F.concat(*(y for k in range(n) for y in (F.lit(" "), held[k])[0 if k else 1 :])) for n in range(1, run + 1)]
    return [(F.crc32(x) % buckets).cast("int") for x in joined]


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """bucket, n: the features of all texts, added up in each task before they are shuffled; buckets rows at most.

    The outer explosion spares the planner's own check of what is exploded, which would split every text twice.
    """
    held = texts.select(words(col(text)).alias("w")).select(_starts(F.col("w"), run).alias("z")).select(F.explode_outer("z").alias("x"))
    features = held.select(F.explode_outer(F.array(*_buckets("x", run, buckets))).alias("bucket")).filter("bucket is not null")
    return features.groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """bucket, gain of every bucket: how much more frequent it is in the target, in thousandths of a natural logarithm."""
    all_ = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    side = lambda rows, c, name: bucket_counts(rows, c, buckets, run).withColumnRenamed("n", name)
    both = all_.join(side(docs, text, "s"), "bucket", "left").join(side(target, target_text, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = settle(both)  # buckets rows
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(float(UNIT)) * F.log(ratio)).cast("long").alias("gain"))  # one row


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Seeded noise of an id in thousandths; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """id_col, n_words, n_features, weight of every row.

    A row's features are added up in the task that read it, so what is shuffled is a row a document. ``gain`` has
    ``buckets`` rows, which is what is broadcast.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("r"), col(id_col).alias("i"), words(col(text)).alias("w"))
    starts = rows.select("r", "i", F.size("w").alias("words"), _starts(F.col("w"), run).alias("z")).select("r", "i", "words", F.explode_outer("z").alias("x"))
    held = starts.select("r", "i", "words", *(b.alias(f"b{k}") for k, b in enumerate(_buckets("x", run, buckets))))
    for k in range(run):
        held = held.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    some = sum((F.coalesce(f"g{k}", F.lit(0)) for k in range(run)), F.lit(0).cast("long"))
    many = sum((F.when(F.col(f"b{k}").isNotNull(), 1).otherwise(0) for k in range(run)), F.lit(0))
    sums = held.groupBy("r", "i").agg(F.max("words").alias("n_words"), F.sum(many).alias("n_features"), F.sum(some).alias("g"))
    weight = F.expr("CASE WHEN n_features > 0 THEN (g - pmod(g, n_features)) div n_features ELSE 0L END")  # downwards also below zero
    return sums.select(F.col("i").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_features", weight.alias("weight"))


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their places 1, 2, 3... in an order over all of them, and no task that sees all.

    Rows are dealt by ranges of the order and sorted in each; a row's place is its place there and the rows of the
    ranges before. Only the counts of the ranges, one row a partition, are put in one sequence.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    m = F.monotonically_increasing_id()
    held = settle(dealt.withColumn("__part", F.shiftright(m, 33).cast("int")).withColumn("__row", m.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return held.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")  # a row a partition


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """id_col, n_words, n_features, weight, score, rank of every row: ``share`` per cent of the documents of ``least_words`` are drawn.

    Documents whose n-grams are frequent in the target are drawn more often; noise of the id makes the draw one
    without replacement. A null or blank text has no features, weight 0 and is never drawn, whatever its score; null ids
    come after others of their score. Rows of one id and score are ranked by their features. An empty target
    gives gains by the documents alone, an empty table gives an empty one; extra columns play no part.
    """
    docs = spread(docs.select(col(id_col), col(text)))
    scored = weights(docs, gains(docs, spread(target.select(col(target_text))), text, target_text), id_col, text)
    scored = scored.withColumn("score", F.col("weight") + gumbel(col(id_col), seed)).withColumn("__able", F.col("n_words") >= least_words)
    order = [F.col("__able").desc(), F.col("score").desc(), col(id_col).asc_nulls_last(), F.col("n_features").asc()]
    placed = ranked(scored, order)
    drawn = placed.agg(F.expr(f"(count_if(__able) * {share}) div 100").alias("__drawn"))
    rank = F.when(F.col("place") <= F.col("__drawn"), F.col("place"))
    return placed.join(F.broadcast(drawn)).select(col(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))  # one row
