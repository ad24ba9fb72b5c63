"""A stored inverted index: blocks of postings by term and range of documents, changed documents in segments of their own."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from uuid import uuid4
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import joins, search
from .lineage import settle, spread

#: Documents of a block of postings, about, so that no term is one row or task. Documents of a folder, about, and folders at most:
#: terms and dimensions are dealt into folders by what they are, and sorted in each.
RANGE, FOLDER, FOLDERS = 4096, 100_000, 1024
#: Ranges whose documents are scored first, for a bound that other ranges have to reach.
FIRST = 8
#: Texts whose words are Python objects at one time, and words whose place in the hashed vector a worker remembers.
SLICE, PLACES = 256, 50_000


class Segments:
    """Segments of documents under a path, never changed, and versions that name them.

    ``upsert`` writes a segment of the changed documents and, for each older segment, the keys that no longer hold
    there. A version is a file of segment names and sums, and becomes visible by a rename; what a failed writer left
    is named by none. A subclass says in ``_write`` what a segment holds; its ``rows`` have the keys k and the counts n.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "uri", text: str = "text"):
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self.version, self.segments = self._latest()

    def _write(self, docs: DataFrame) -> dict:
        raise NotImplementedError

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, list[dict]]:
        at, fs = self._fs(f"{self.path}/versions")
        names = [str(s.getPath().getName()) for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, []
        said = self.spark.read.text(f"{self.path}/versions/{max(numbers):08d}", wholetext=True).first()["value"]
        return max(numbers), json.loads(said)

    def _commit(self, segments: list[dict]) -> None:
        number = self.version + 1
        draft, fs = self._fs(f"{self.path}/drafts/{uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/versions/{number:08d}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {number} was written by another")
        self.version, self.segments = number, segments

    def build(self, docs: DataFrame) -> Segments:
        """All documents anew. A null text is a document without words; keys are to be unique and not null."""
        self._commit([self._write(docs)])
        return self

    def upsert(self, docs: DataFrame) -> Segments:
        """Replace the documents of these keys, and add those that are new; only these are read and written."""
        new = self._write(docs)
        keys = self.spark.read.parquet(f"{self.path}/{new['name']}/rows").select("k")
        out = []
        for segment in self.segments:
            live = self._alive(self.spark.read.parquet(f"{self.path}/{segment['name']}/rows").select("k", "n"), segment)
            gone = f"{self.path}/{segment['name']}/dead-{new['name']}"
            live.join(keys, "k", "left_semi").write.parquet(gone)
            lost = self.spark.read.parquet(gone).agg(F.count("*").alias("docs"), F.count("n").alias("sized"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
            dead = [*segment["dead"], new["name"]] if lost["docs"] else segment["dead"]
            out.append(segment | {c: segment[c] - lost[c] for c in ("docs", "sized", "words")} | {"dead": dead})
        self._commit([*(s for s in out if s["docs"]), new])
        return self

    def _read(self, segment: dict, table: str, schema: str) -> DataFrame:
        """A table of a segment that is written by folders, which leaves no file to take its columns from when it is empty."""
        key = self.spark.read.parquet(f"{self.path}/{segment['name']}/rows").schema["k"].dataType.simpleString()
        return self.spark.read.schema(f"{schema}, keys array<{key}>, bucket int").parquet(f"{self.path}/{segment['name']}/{table}")

    def _alive(self, rows: DataFrame, segment: dict) -> DataFrame:
        """Rows (k, ...) without those that a later segment replaces."""
        if not segment["dead"]:
            return rows
        gone = self.spark.read.parquet(*(f"{self.path}/{segment['name']}/dead-{n}" for n in segment["dead"])).select("k")
        return rows.join(gone, "k", "left_anti")


def postings_of(texts: pa.Array, place: Callable[[str], tuple[int, int]]) -> pa.Array:
    """The terms and dims of texts, given as lists of words. Columns are filled with plain values, so a posting is no object of its own."""
    ends, words, tf, places, dims, weights = [0], [], [], [0], [], []
    for text in texts:
        counts, vector = Counter(text.as_py() or ()), Counter()
        for word, n in counts.items():
            dim, sign = place(word)
            vector[dim] += sign * (1 + math.log(n))
        length = math.sqrt(sum(v * v for v in vector.values()))
        words += counts.keys()
        tf += counts.values()
        ends.append(len(words))
        held = [d for d, v in vector.items() if v]
        dims += held
        weights += [vector[d] / length for d in held]
        places.append(len(dims))
    lists = lambda at, **c: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(list(c.values()), list(c)))
    terms = lists(ends, term=pa.array(words, pa.string()), tf=pa.array(tf, pa.int32()))
    return pa.StructArray.from_arrays([terms, lists(places, dim=pa.array(dims, pa.int32()), weight=pa.array(weights, pa.float64()))], ["terms", "dims"])


class TextIndex(Segments):
    """Postings of documents.

    A segment has terms (bucket, term, r, keys, tf, n, most_tf, least_n), dims (bucket, dim, r, keys, weight: the
    hashed vector, of length one) and rows (k, r, n).
    """

    def _write(self, docs: DataFrame) -> dict:
        name = uuid4().hex
        at = f"{self.path}/{name}"
        n_docs = docs.count()
        ranges, folders = max(1, math.ceil(n_docs / RANGE)), min(FOLDERS, max(1, math.ceil(n_docs / FOLDER)))

        @F.arrow_udf("terms array<struct<term: string, tf: int>>, dims array<struct<dim: int, weight: double>>")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            place = lru_cache(maxsize=PLACES)(search.place_of)
            for batch in batches:
                for i in range(0, len(batch), SLICE):
                    yield postings_of(batch[i : i + SLICE], place)

        rows = spread(docs.select(F.col(self.key).alias("k"), joins.tokens(F.col(self.text)).alias("w")))
        r = F.pmod(F.xxhash64("k"), F.lit(ranges)).cast("int")
        rows.select("k", r.alias("r"), F.size("w").alias("n"), counted("w").alias("x")).select("k", "r", "n", "x.*").write.parquet(f"{at}/rows")
        held = self.spark.read.parquet(f"{at}/rows")
        lists = lambda *c: F.sort_array(F.collect_list(F.struct("k", *c)))  # noqa: E731  # RANGE documents, about
        own = held.select("k", "r", "n", F.explode("terms").alias("t")).select("k", "r", "n", "t.*")
        blocks = own.groupBy("term", "r").agg(lists("tf", "n").alias("p"), F.max("tf").alias("most_tf"), F.min("n").alias("least_n"))
        blocks = blocks.select((F.crc32("term") % folders).cast("int").alias("bucket"), "term", "r", "most_tf", "least_n", F.size("p").alias("docs"), F.col("p.k").alias("keys"), F.col("p.tf").alias("tf"), F.col("p.n").alias("n"))
        order = ("bucket", "term", "r")
        blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{at}/terms")
        dims = held.select("k", "r", F.explode("dims").alias("t")).select("k", "r", "t.*").groupBy("dim", "r").agg(lists("weight").alias("p"))
        dims = dims.select((F.col("dim") % folders).alias("bucket"), "dim", "r", F.col("p.k").alias("keys"), F.col("p.weight").alias("weight"))
        order = ("bucket", "dim", "r")
        dims.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{at}/dims")
        sums = held.agg(F.count("n").alias("sized"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        return {"name": name, "folders": folders, "docs": n_docs, "sized": sums["sized"], "words": sums["words"], "dead": []}

    def blocks(self, segment: dict, words: list[str]) -> DataFrame:
        """The blocks of these words alone: their folders by partition, their rows by statistics of the files."""
        rows = self._read(segment, "terms", "term string, r int, most_tf int, least_n int, docs int, tf array<int>, n array<int>")
        return rows.filter(F.col("bucket").isin(sorted({crc32(w.encode()) % segment["folders"] for w in words})) & F.col("term").isin(words))

    def _postings(self, blocks: DataFrame, segment: dict) -> DataFrame:
        rows = blocks.select("term", "r", F.explode(F.arrays_zip("keys", "tf", "n")).alias("p")).select("term", "r", F.col("p.keys").alias("k"), F.col("p.tf").alias("tf"), F.col("p.n").alias("n"))
        return self._alive(rows, segment)

    def _sums(self) -> tuple[int, float]:
        """Documents, and words of a document in the mean."""
        sized = sum(s["sized"] for s in self.segments)
        return sum(s["docs"] for s in self.segments), (sum(s["words"] for s in self.segments) / sized if sized else 0.0)

    def _frequencies(self, words: list[str]) -> dict[str, int]:
        """In how many live documents each word occurs."""
        parts = []
        for s in self.segments:
            if s["dead"]:
                parts.append(self._postings(self.blocks(s, words), s).groupBy("term").agg(F.count("*").alias("df")))
            else:
                parts.append(self.blocks(s, words).groupBy("term").agg(F.sum("docs").alias("df")))
        found = reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a word
        return {r["term"]: r["df"] for r in found}

    def _scored(self, postings: DataFrame, words: list[str], df: dict[str, int]) -> DataFrame:
        docs, mean = self._sums()
        counts = postings.groupBy("k").agg(F.first("n").alias("__n"), *(F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"__t{i}") for i, w in enumerate(words)))
        counts = counts.withColumns({"__docs": F.lit(docs), "__mean": F.lit(mean)})
        score = search._okapi([(F.col(f"__t{i}"), F.lit(df.get(w, 0))) for i, w in enumerate(words)])
        return counts.select(F.col("k").alias(self.key), F.round(score, search.DIGITS).alias("score"))

    def _none(self, score: Column) -> DataFrame:
        kind = self.spark.range(0).select(F.lit(None).cast("string").alias(self.key), score.alias("score"))
        return kind if not self.segments else self.spark.read.parquet(f"{self.path}/{self.segments[-1]['name']}/rows").select(F.col("k").alias(self.key), score.alias("score")).limit(0)

    def bm25(self, query: str) -> DataFrame:
        """key, score of all documents that hold a word of the query: what search.bm25() finds by reading every text."""
        words = search.terms(query)
        if not words or not self.segments:
            return self._none(F.lit(0.0))
        every = reduce(DataFrame.unionByName, (self._postings(self.blocks(s, words), s) for s in self.segments))
        return self._scored(every, words, self._frequencies(words))

    def top(self, query: str, most: int) -> DataFrame:
        """rank, key, score of the ``most`` best, ties by key, without the postings of ranges that cannot hold one of them.

        A block says the most occurrences of its word and the shortest document, so its words score no more than that;
        the ranges of the highest sums are scored first, and what their documents reach is the bound for the others.
        """
        words = search.terms(query)
        if not words or not self.segments or most < 1:
            return self._none(F.lit(0.0)).withColumn("rank", F.lit(0).cast("long")).select("rank", self.key, "score")
        df = self._frequencies(words)
        ranges = self.bounds(words, df)
        first = ranges.orderBy(F.col("bound").desc(), "s", "r").limit(FIRST)
        best = self._scored(self._of(first, words), words, df).orderBy(F.col("score").desc()).limit(most).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        bar = best["least"] if best["n"] == most else 0.0
        order = [F.col("score").desc(), F.col(self.key).asc()]
        scored = self._scored(self._of(ranges.filter(F.col("bound") >= bar - 10.0**-search.DIGITS), words), words, df)
        from .ranking import ranked

        return ranked(scored, order, most).select("rank", self.key, "score")

    def bounds(self, words: list[str], df: dict[str, int]) -> DataFrame:
        """s (the segment's place), r, bound: what a document of that range scores at most. Postings aren't read for it."""
        docs, mean = self._sums()
        parts = [self.blocks(s, words).select(F.lit(i).alias("s"), "r", "term", "most_tf", "least_n") for i, s in enumerate(self.segments)]
        idf = F.create_map(*(F.lit(x) for w in words for x in (w, math.log(1 + (docs - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)))))
        tf = F.col("most_tf")
        bound = F.try_element_at(idf, F.col("term")) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("least_n") / F.lit(mean)))
        return reduce(DataFrame.unionByName, parts).groupBy("s", "r").agg(F.sum(bound).alias("bound"))

    def _of(self, ranges: DataFrame, words: list[str]) -> DataFrame:
        """Postings of the words in these ranges."""
        parts = [self._postings(self.blocks(s, words).join(ranges.filter(F.col("s") == i).select("r"), "r", "left_semi"), s) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    def vector_scores(self, query: str) -> DataFrame:
        """key, score of the documents whose stored vector is near the query's; only the query's own dimensions are read."""
        wanted = {d: float(v) for d, v in search._wanted(query).items()}
        if not wanted or not self.segments:
            return self._none(F.lit(0.0))
        size = math.sqrt(sum(v * v for v in wanted.values()))
        weight = F.create_map(*(F.lit(x) for d, v in wanted.items() for x in (d, v / size)))
        parts = []
        for s in self.segments:
            rows = self._read(s, "dims", "dim int, r int, weight array<double>").filter(F.col("bucket").isin(sorted({x % s["folders"] for x in wanted})) & F.col("dim").isin(sorted(wanted)))
            each = rows.select("dim", F.explode(F.arrays_zip("keys", "weight")).alias("p")).select("dim", F.col("p.keys").alias("k"), F.col("p.weight").alias("v"))
            parts.append(self._alive(each, s))
        cosine = F.sum(F.col("v") * F.try_element_at(weight, F.col("dim")))
        return reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.round(cosine, 6).alias("score")).filter("score > 0").select(F.col("k").alias(self.key), "score")

    def explore(self, keywords: str, question: str = "", most: int = 10) -> DataFrame:
        """rank, key, score: search.explore() from the index alone."""
        lists = [settle(self.bm25(part)) for part in (keywords, question) if search.terms(part)]
        if not lists:
            return self._none(F.lit(0.0)).withColumn("rank", F.lit(0).cast("long")).select("rank", self.key, "score")
        return search.fused([*lists, settle(self.vector_scores(keywords))], self.key, most)
