"""Summaries by a walk over the sentences of a document: what shares rare words with much of the text ranks high."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settle, spread

#: A word ends at any ASCII character that is no letter or digit.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a sentence starts with, the steps of the walk, and the thousandths of a step that follow the words.
START, STEPS, FOLLOWED = 1_000_000, 6, 850
#: Words that are sent to every task, at most: a word of more than this part of all rows is one of them.
MOST_HOT = 5000
#: Words that a task counts before it passes their sums on, and texts whose words are Python objects at one time.
COUNTED, SLICE = 100_000, 256
#: In UTF-8: A-Z in lower case, and a blank for what ends a word. Bytes of letters beyond ASCII stay.
_FOLD = bytes(c + 32 if chr(c) in UPPER else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_END = re.compile(rb"([.!?])[ \t]+")


def sentences(text: Column) -> Column:
    """The pieces of a text that end with a line, or with a mark of end and blanks after it."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")


def words(text: Column) -> Column:
    """The distinct words of a text, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), 1))


def _held(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, as words() takes them, with repeats."""
    return text.translate(_FOLD).split()


def rarity(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, df, g of every word: floor(1000 * ln(1 + documents / documents with it)).

    Counts add up over tasks before they are shuffled, in COUNTED words at a time, so a word of every text is a few rows a task.
    """
    n = docs.agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(set(_held(value.as_buffer().to_pybytes())))
                if len(found) > COUNTED:
                    yield _counts(found)
                    found.clear()
        if found:
            yield _counts(found)

    texts = spread(docs.select(F.col(text).alias("t"))).filter("t is not null")
    held = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("df"))
    return held.join(F.broadcast(n)).select("word", "df", F.floor(1000 * F.log(1 + F.col("n").cast("double") / F.col("df"))).alias("g"))  # one row


def _counts(found: Counter) -> pa.RecordBatch:
    words = pa.array(list(found), pa.binary()).cast(pa.string())  # cut at ASCII only, so UTF-8 still
    return pa.RecordBatch.from_arrays([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])


def walk(text: bytes, weight: Callable[[bytes], int], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals and scores of the sentences of one text. Sums are whole numbers below 2^53, so exact as doubles."""
    place: dict[bytes, int] = {}
    at, word = [], []
    for s, piece in enumerate(_END.sub(rb"\1\n", text).split(b"\n")):
        own = set(_held(piece))
        at += [s] * len(own)
        word += [place.setdefault(w, len(place)) for w in own]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ordinals, at = np.unique(np.array(at), return_inverse=True)
    word = np.array(word)
    g = np.array([weight(w) for w in place], np.int64)[word]
    summed = lambda by, x: np.bincount(by, x).astype(np.int64)
    shared, every = np.bincount(word), summed(at, g)[at]
    r = np.full(len(ordinals), START, np.int64)
    for _ in range(steps):
        got = summed(word, r[at] * g // every) // shared
        r = START * (1000 - FOLLOWED) // 1000 + summed(at, got[word]) * FOLLOWED // 1000
    return ordinals, r


def walked(docs: DataFrame, key: str, text: str = "text", steps: int = STEPS) -> DataFrame:
    """key, text, scores: (ordinal, score) of every sentence with a word; ordinals count all pieces of the text from 0.

    A sentence deals its score to its words by their rarity, a word deals what it got to its sentences in equal parts:
    PageRank on the graph whose sentences are linked by the words that they share, without a link ever written down,
    so a step costs what the words of a text are, however many sentences share them. Whole numbers throughout, so
    the result hangs on no order. Words of many texts are sent to every task; the others of a text meet their rarity in
    a shuffle by word, from which those of one text alone need not come back; then each text is walked over in its
    row. Keys are unique; a null text has no sentences. Sums stay within 2^53 up to 10^8 sentences a document.
    """
    known = settle(rarity(docs, text))
    sums = known.agg(F.sum("df").alias("n"), F.max(F.when(F.col("df") == 1, F.col("g"))).alias("alone")).first()
    hot = F.col("df") > (sums["n"] or 0) / MOST_HOT  # at most MOST_HOT words, as the counts of all sum to n
    few = {r["word"].encode(): r["g"] for r in known.filter(hot).select("word", "g").toLocalIterator()}
    alone = sums["alone"] or 0
    sent = docs.sparkSession.sparkContext.broadcast(few)

    @F.arrow_udf("array<string>")
    def rare(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        few = sent.value
        for batch in batches:
            own = [pa.array([], pa.list_(pa.binary()))]
            for i in range(0, len(batch), SLICE):
                own.append(pa.array([set(_held(x.as_buffer().to_pybytes())) - few.keys() if x.is_valid else None for x in batch[i : i + SLICE]], pa.list_(pa.binary())))
            yield pa.concat_arrays(own).cast(pa.list_(pa.string()))

    @F.arrow_udf("array<struct<ordinal: long, score: long>>")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        few = sent.value
        for texts, rarities in batches:
            sizes, ordinals, scores = [0], [], []
            for value, known in zip(texts, rarities, strict=True):
                x = y = np.zeros(0, np.int64)
                if value.is_valid:
                    own = {w.encode(): g for w, g in zip(known.values.field(0).to_pylist(), known.values.field(1).to_pylist(), strict=True)} if known.is_valid else {}
                    x, y = walk(value.as_buffer().to_pybytes(), lambda w, own=own: few.get(w) or own.get(w, alone), steps)
                sizes.append(sizes[-1] + len(x))
                ordinals.append(x), scores.append(y)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(z or [np.zeros(0, np.int64)]), pa.int64()) for z in (ordinals, scores)], ["ordinal", "score"])
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)

    rows = docs.select(F.struct(F.col(key).alias("k")).alias("k"), F.col(text).alias("t"))  # a struct, as a null key is a key
    cold = spread(rows).filter("t is not null").select("k", F.explode(rare("t")).alias("word"))
    again = cold.join(known.filter(~hot & (F.col("df") > 1)).select("word", "g"), "word")
    again = again.groupBy("k").agg(F.collect_list(F.struct("word", "g")).alias("w"))
    done = rows.join(again, "k", "left").select("k", "t", scored("t", "w").alias("scores"))
    return done.select(F.col("k.k").alias(key), F.col("t").alias(text), "scores")


def ranked(docs: DataFrame, key: str, text: str = "text", steps: int = STEPS) -> DataFrame:
    """key, ordinal, score of every sentence with a word, by the walk of walked()."""
    return walked(docs, key, text, steps).select(key, F.explode("scores").alias("x")).select(key, "x.ordinal", "x.score")


def picked(scores: DataFrame, key: str, most: int = 3) -> DataFrame:
    """scores with picked: whether the sentence is among the highest of its document, ties to the earlier one."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "ordinal"))
    return scores.withColumn("picked", place <= most)


def summaries(docs: DataFrame, key: str, text: str = "text", most: int = 3) -> DataFrame:
    """key, summary: the picked sentences in the order of the text; null where no sentence has a word."""
    best = F.slice(F.array_sort(F.transform("scores", lambda x: F.struct((-x.score).alias("least"), x.ordinal.alias("ordinal")))), 1, most)
    at = F.array_sort(F.transform(best, lambda x: x.ordinal))
    body = F.array_join(F.transform(at, lambda i: F.trim(F.element_at(sentences(F.col(text)), i.cast("int") + 1))), " ")
    return walked(docs, key, text).select(key, F.when(F.size("scores") > 0, body).alias("summary"))
