"""Text search and ranking: lines by pattern, BM25, hashed vectors, rank fusion, similar items, vocabulary."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bindings import lines
from . import joins
from .lineage import settle, spread

K1, B = 1.2, 0.75
#: Constant of reciprocal rank fusion, and the candidates that each list contributes at least; as many as are asked for.
FUSION, CANDIDATES = 60, 200
DIMENSIONS = 256
#: Decimals that scores are rounded to before they are ranked, so that ties are ties on every machine.
DIGITS = 9
#: Lines that a call returns when it does not say.
GREP_RESULTS = 100
#: Texts that are Python objects at one time, and words whose place in the hashed vector a worker remembers.
SLICE, PLACES = 256, 50_000


def insensitive(pattern: str, is_regex: bool, case_sensitive: bool | None) -> bool:
    """Without a wish, a literal without capitals matches any case, and an expression is taken as it is."""
    if case_sensitive is not None:
        return not case_sensitive
    return not is_regex and pattern == pattern.lower()


def grep(docs: DataFrame, pattern: str, is_regex: bool = False, most: int = GREP_RESULTS, case_sensitive: bool | None = None, uri: str = "uri", text: str = "text") -> DataFrame:
    """uri, line_number, line (untrimmed) of the first ``most`` matching lines by uri and number; 0 means the default.

    Texts without a match are dropped before any is split into lines.
    """
    if not pattern:
        raise ValueError("an empty pattern matches everything: say what to look for")
    hit = line_match(pattern, is_regex, case_sensitive)
    whole = hit if not is_regex or not re.search(r"[\^$]|\\[AZzbB]", pattern) else lambda c: F.lit(True)
    found = lines(docs.filter(whole(F.col(text))), uri, text)
    return found.filter(hit(F.col("line"))).orderBy(F.col(uri).asc_nulls_last(), "line_number").limit(most or GREP_RESULTS)


def line_match(pattern: str, is_regex: bool = False, case_sensitive: bool | None = None):
    """The predicate of grep() as a function of a column."""
    loose = insensitive(pattern, is_regex, case_sensitive)
    if is_regex:
        return lambda c: c.rlike(("(?i)" if loose else "") + pattern)
    return (lambda c: F.contains(F.lower(c), F.lit(pattern.lower()))) if loose else (lambda c: F.contains(c, F.lit(pattern)))


def terms(text: str) -> list[str]:
    """The words of a query, as joins.tokens() takes those of a text, each once."""
    return list(dict.fromkeys(re.findall(r"\w+", text.lower())))


def _is(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """key, score of the texts that hold a query word; the statistics cover all of docs.

    The counts of the query's own words are found within each row, and the statistics are one row, so a search
    shuffles nothing but a partial sum for each task.
    """
    words = terms(query)
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    def counted(rows: DataFrame) -> DataFrame:
        held = rows.select(key, joins.tokens(F.col(text)).alias("__w"))
        counts = F.struct(F.size("__w").alias("__n"), *(F.size(F.filter("__w", _is(w))).alias(f"__t{i}") for i, w in enumerate(words)))
        return held.select(key, F.explode(F.array(counts)).alias("x")).select(key, "x.*")  # what filters on counts stays above them

    stats = counted(docs).agg(F.count("*").alias("__docs"), F.avg("__n").alias("__mean"), *(F.count_if(F.col(f"__t{i}") > 0).alias(f"__d{i}") for i in range(len(words))))
    some = reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w)) for w in words))  # cheap, and true of all that score
    joined = counted(docs.filter(some)).join(F.broadcast(stats))  # one row
    score = _okapi([(F.col(f"__t{i}"), F.col(f"__d{i}")) for i in range(len(words))])
    return joined.select(key, score.alias("score")).filter("score > 0").select(key, F.round("score", DIGITS).alias("score"))


def _okapi(counts: list[tuple[Column, Column]]) -> Column:
    """BM25 from (count in the text, texts that hold it) of each word, and __n, __docs and __mean."""
    score = F.lit(0.0)
    for tf, df in counts:
        idf = F.log(1 + (F.col("__docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / F.col("__mean")))
    return score


def place_of(word: str) -> tuple[int, int]:
    """(dimension, sign) of a word."""
    code = hashlib.md5(word.encode()).hexdigest()
    return int(code[:2], 16), 1 if int(code[2], 16) % 2 == 0 else -1


def _wanted(query: str) -> Counter:
    """The vector of a query: its dimensions that are not zero."""
    out: Counter = Counter()
    for word, n in Counter(re.findall(r"\w+", query.lower())).items():
        dim, sign = place_of(word)
        out[dim] += sign * (1 + math.log(n))
    return Counter({k: v for k, v in out.items() if v})


#: What one walk over a text finds: its words, how often each word asked for occurs, and its cosine with the query.
FOUND = "n int, tf array<int>, cosine double"


def walked(text: Column, words: list[str], query: str) -> Column:
    """The struct FOUND of a text. Counts and vector come from the same walk, in Python by batches; said with built-in
    functions the vector would deal out every word of every text."""
    wanted = _wanted(query)
    weights = [float(wanted.get(d, 0.0)) for d in range(DIMENSIONS)]
    size = math.sqrt(sum(v * v for v in wanted.values()))

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = lru_cache(maxsize=PLACES)(place_of)
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                ns, tfs, cosines = [], [], []
                for held in batch[i : i + SLICE]:
                    value = held.as_py()
                    counts = Counter(re.findall(r"\w+", value or ""))
                    vector = [0.0] * DIMENSIONS
                    for word, n in counts.items() if size else ():
                        dim, sign = place(word)
                        vector[dim] += sign * (1 + math.log(n))
                    length = math.sqrt(sum(v * v for v in vector)) * size
                    ns.append(None if value is None else counts.total())
                    tfs.append([counts[w] for w in words])
                    cosines.append(sum(a * b for a, b in zip(vector, weights, strict=True)) / length if length else 0.0)
                yield pa.StructArray.from_arrays([pa.array(ns, pa.int32()), pa.array(tfs, pa.list_(pa.int32())), pa.array(cosines, pa.float64())], ["n", "tf", "cosine"])

    return run(F.lower(text))


def vector_scores(docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """key, score: cosine of hashed, signed log counts of words. No statistics of the corpus, so texts stand alone."""
    if not _wanted(query):
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    found = spread(docs.select(key, text)).select(key, walked(F.col(text), [], query).alias("x"))
    return found.select(key, F.round("x.cosine", 6).alias("score")).filter("score > 0")


def fused(lists: list[DataFrame], key: str, most: int) -> DataFrame:
    """key, score in [0, 1], rank: reciprocal ranks of the best CANDIDATES of each list, or ``most``, added and scaled.

    Scores compare within one answer only. Ties go by key.
    """
    parts = None
    for scored in lists:
        order = [F.col("score").desc_nulls_last(), F.col(key).asc_nulls_last()]
        best = scored.orderBy(*order).limit(max(CANDIDATES, most))
        part = best.select(key, (1.0 / (FUSION + F.row_number().over(W.orderBy(*order)))).alias("s"))  # few rows
        parts = part if parts is None else parts.unionByName(part)
    total = parts.groupBy(key).agg(F.round(F.sum("s"), 12).alias("s"))
    every = W.partitionBy()  # at most CANDIDATES rows of each list, which are not computed twice
    hi, lo = F.max("s").over(every), F.min("s").over(every)
    rows = total.withColumn("__hi", hi).withColumn("__lo", lo)
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("s") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(1.0))
    rows = rows.select(key, F.round(scaled, 6).alias("score"), "s")
    order = [F.col("s").desc(), F.col(key).asc_nulls_last()]
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long")).select("rank", key, "score")


def explore(docs: DataFrame, keywords: str, question: str = "", key: str = "uri", text: str = "text", most: int = 10) -> DataFrame:
    """rank, key, score: words and hashed vectors of the keywords, and the words of the question, fused.

    Texts are read once: the walk leaves a narrow table of counts and cosines, and statistics, scores and lists are
    made from that. The scores are those of bm25() and vector_scores().
    """
    asked = [terms(keywords), terms(question)]
    words = list(dict.fromkeys(asked[0] + asked[1]))
    if not words:
        return docs.select(F.lit(0).cast("long").alias("rank"), key, F.lit(0.0).alias("score")).limit(0)
    found = spread(docs.select(key, text)).select(key, walked(F.col(text), words, keywords).alias("x"))
    found = settle(found.select(key, F.col("x.n").alias("__n"), F.col("x.tf").alias("__tf"), F.round("x.cosine", 6).alias("__cosine")))
    stats = found.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__mean"), *(F.count_if(F.col("__tf")[i] > 0).alias(f"__d{i}") for i in range(len(words))))
    held = found.join(F.broadcast(settle(stats)))  # one row
    lists = []
    for part in filter(None, asked):
        score = _okapi([(F.col("__tf")[words.index(w)], F.col(f"__d{words.index(w)}")) for w in part])
        lists.append(held.select(key, score.alias("score")).filter("score > 0").select(key, F.round("score", DIGITS).alias("score")))
    lists.append(found.select(key, F.col("__cosine").alias("score")).filter("score > 0"))
    return fused(lists, key, most)


def localised(docs: DataFrame, keywords: str, key: str = "uri", text: str = "text") -> DataFrame:
    """key, line_number, line: the first line that holds the most words of the query."""
    words = terms(keywords)
    held = lines(docs, key, text).withColumn("__w", joins.tokens(F.col("line")))
    n = F.size(F.array_intersect("__w", F.array(*map(F.lit, words)))) if words else F.lit(0)
    scored = held.select(key, "line_number", "line", n.alias("n")).filter("n > 0")
    best = scored.groupBy(key).agg(F.max(F.struct("n", (-F.col("line_number")).alias("m"), "line")).alias("b"))
    return best.select(key, (-F.col("b.m")).alias("line_number"), F.col("b.line").alias("line"))


def find(docs: DataFrame, keywords: str, most: int = 10, key: str = "uri", text: str = "text") -> DataFrame:
    """rank, key, confidence from 0 to 100, line_number where one line holds words of the query."""
    best = settle(explore(docs, keywords, "", key, text, most or 10))
    spots = localised(docs.join(F.broadcast(best.select(key)), key, "left_semi"), keywords, key, text)  # at most ``most`` keys
    return best.join(spots, key, "left").select("rank", key, F.round(F.col("score") * 100).cast("long").alias("confidence"), "line_number")


def search_pipeline(docs: DataFrame, query: str, most: int, key: str = "uri", text: str = "text") -> DataFrame:
    """uri, symbol (null here), line_start, line_end, snippet, score: explore() as a relation to join with."""
    best = settle(explore(docs, query, "", key, text, most))
    spots = localised(docs.join(F.broadcast(best.select(key)), key, "left_semi"), query, key, text)
    rows = best.join(spots, key, "left")
    return rows.select(key, F.lit(None).cast("string").alias("symbol"), F.col("line_number").alias("line_start"), F.col("line_number").alias("line_end"), F.substring(F.trim("line"), 1, 160).alias("snippet"), "score")


def similar(vectors: DataFrame, seed: Column, most: int, key: str = "vec_id", vector: str = "embedding", share: float = 0.0) -> DataFrame:
    """rank, key, score: cosine to the stored vector of the one seed row, itself left out; then those of a share of the best."""
    one = vectors.filter(seed).select(F.col(key).alias("__k"), F.col(vector).alias("__v")).orderBy("__k").limit(1)
    rows = vectors.join(F.broadcast(one)).filter(F.col(key) != F.col("__k"))  # one vector
    scored = rows.select(key, F.round(joins.cosine(F.col(vector), F.col("__v")), 6).alias("score")).filter("score is not null")
    order = [F.col("score").desc(), F.col(key).asc()]
    best = scored.orderBy(*order).limit(most or 10).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))
    return best.filter(F.col("score") >= share * F.max("score").over(W.partitionBy())).select("rank", key, "score") if share else best.select("rank", key, "score")


#: Words that a task counts before it passes their sums on.
COUNTED = 100_000


def word_counts(docs: DataFrame, text: str, probe: list[str]) -> DataFrame:
    """term, df, with: in how many texts each word occurs, and in how many of those that hold a word of the probe.

    A task adds up its texts before anything is shuffled, in at most about COUNTED words and those of one text. What it
    holds hangs neither on the input nor on the words of all texts.
    """
    wanted = frozenset(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, beside = Counter(), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64()), pa.array([beside[w] for w in found], pa.int64())], ["term", "df", "with"])
        for batch in batches:
            for value in batch.column(0):
                words = set(re.findall(r"\w+", value.as_py()))
                found.update(words)
                if not wanted.isdisjoint(words):
                    beside.update(words)
                if len(found) > COUNTED:
                    yield rows()
                    found.clear(), beside.clear()
        if found:
            yield rows()

    held = spread(docs.select(text)).filter(F.col(text).isNotNull()).select(F.lower(text).alias("t"))
    return held.mapInArrow(run, "term string, df long, with long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("with").alias("with"))


def vocabulary(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, df: the words of the corpus and in how many texts each occurs."""
    return word_counts(docs, text, []).select("term", "df")


def fuzzy(known: DataFrame, word: str, most: int = 5, within: int = 2) -> DataFrame:
    """term, distance of the known terms nearest to a word. Lengths rule most terms out before any distance is taken."""
    n = len(word)
    near = known.filter(F.length("term").between(n - within, n + within))
    scored = near.withColumn("distance", F.levenshtein("term", F.lit(word)).cast("long")).filter(F.col("distance") <= within)
    return scored.orderBy("distance", F.col("df").desc(), "term").limit(most)


#: Letters at the beginning of a word whose deletions are its keys, so that a word of any length has few.
HEAD = 8


def remains(term: Column, within: int) -> Column:
    """What is left of the first HEAD letters of a term after up to ``within`` of them are deleted, each once.

    Two terms within so many edits share one of these: an edit is undone by a deletion on each side, of the letter
    itself or of the last one of the head. At most 37 for two edits.
    """
    head = F.substring(term, F.lit(1), F.lit(HEAD))
    less = lambda x: F.transform(F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    every = each = F.array(head)
    for _ in range(within):
        each = F.array_distinct(F.flatten(F.transform(each, less)))
        every = F.concat(every, each)
    return F.array_distinct(every)


def near_terms(asked: DataFrame, known: DataFrame, within: int = 2) -> DataFrame:
    """query, term, distance: every known term within so many edits of each query, the query itself left out.

    Both sides meet on equal remains, and those that meet and are of about one length are compared. Terms are letters by
    code point; null terms meet nothing, and repeated ones count once.
    """
    left = asked.select(F.col("term").alias("query")).filter("query is not null").distinct()
    right = known.select("term").filter("term is not null").distinct()
    keys = lambda rows, c: rows.select(c, F.explode(remains(F.col(c), within)).alias("key"))
    met = keys(left, "query").join(keys(right, "term"), "key").filter((F.col("query") != F.col("term")) & (F.abs(F.length("query") - F.length("term")) <= within))
    scored = met.select("query", "term").distinct().withColumn("distance", F.levenshtein("query", "term").cast("long"))
    return scored.filter(F.col("distance") <= within)


def discover(docs: DataFrame, keywords: str, key: str, text: str = "text", most: int = 10) -> DataFrame:
    """kind, channel, term, df, score: CONFIRMED words of the probe, TERMs that go with them, DIAGNOSTIC for unknown words.

    A term scores by the share of its texts that hold a probe word; the probe's own words are not repeated as terms.
    """
    probe = terms(keywords)
    counts = word_counts(docs, text, probe)
    known = counts.filter(F.col("term").isin(probe)).select(F.lit("CONFIRMED").alias("kind"), F.lit("lexical").alias("channel"), "term", "df", F.lit(1.0).alias("score"))
    order = [F.col("score").desc(), F.col("df").desc(), F.col("term")]
    beside = counts.filter(~F.col("term").isin(probe)).filter("with >= 2").select(F.lit("TERM").alias("kind"), F.lit("co-occurrence").alias("channel"), "term", "df", F.round(F.col("with") / F.col("df"), 6).alias("score"))
    spark = docs.sparkSession
    asked = spark.createDataFrame([(w,) for w in probe], "term string")
    missing = asked.join(known.select("term"), "term", "left_anti").select(F.lit("DIAGNOSTIC").alias("kind"), F.lit("unknown").alias("channel"), "term", F.lit(0).cast("long").alias("df"), F.lit(0.0).alias("score"))
    return known.unionByName(beside.orderBy(*order).limit(most)).unionByName(missing)


def explain(docs: DataFrame, question: str, keywords: str, budget: int, most: int = 10, key: str = "uri", text: str = "text") -> DataFrame:
    """rank, key, line_number, quote, tokens: the sources of an answer within a reading budget, as citations.

    The answer is what the sources say: the line of each that holds most of the question. Nothing is generated.
    """
    from ..functions.scalars import token_count
    from . import ranking

    best = settle(explore(docs, keywords, question, key, text, most))
    chosen = docs.join(F.broadcast(best), key)  # at most ``most`` rows
    spots = localised(chosen.select(key, text), f"{keywords} {question}", key, text)
    costed = chosen.select("rank", key, token_count(F.col(text)).alias("tokens"))
    fit = ranking.fit_budget(costed, [F.col("rank")], F.col("tokens"), budget)
    return fit.join(spots, key, "left").select("rank", key, "line_number", F.substring(F.trim("line"), 1, 200).alias("quote"), "tokens")
