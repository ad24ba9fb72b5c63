"""Benchmark decontamination: one Aho-Corasick automaton over word windows of the test items, one scan of each text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, few, settle, spread

WINDOW = 13
#: Windows of one automaton. A window of words that no other has takes about 1.1 KB in it (measured), so this is 550 MB
#: in each Python worker; more items are searched in blocks, each an automaton and a scan of its own, with the same
#: results. Executors with more memory take more windows by the parameter of contamination().
BLOCK_WINDOWS = 500_000
#: Lower-cases A-Z and turns every other ASCII character that is no digit or letter into a blank.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, words array<struct<start:long,end:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": _RUNS, "words": _RUNS}


def plain_words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw.translate(_PLAIN).split()


def windows(parts: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of width words; the whole of a shorter item; none of an empty one."""
    if not parts:
        return []
    return [tuple(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))]


class Searcher:
    """An automaton over word numbers: words that no item has are all number 0, which no window contains."""

    def __init__(self, items: tuple[tuple[str, str], ...], width: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for name, text in items:
            for window in dict.fromkeys(windows(plain_words(text), width)):
                found.setdefault(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window), []).append(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in found.items():
            self.automaton.add_word(key, (len(key), tuple(names)))
        self.empty = not found
        self.automaton.make_automaton()

    def scan(self, parts: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs of hit words [first, last + 1) and the names of the items found."""
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        if self.empty or not parts:
            return runs, names
        for end, (length, of) in self.automaton.iter(tuple(map(self.numbers.get, parts, repeat(0)))):
            names.update(of)
            first = end - length + 1
            while runs and runs[-1][1] >= first:  # ends come in order, starts may not
                first = min(first, runs.pop()[0])
            runs.append((first, end + 1))
        return runs, names


def original_spans(text: str | bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point offsets of the text itself, found by one walk over its normalised bytes."""
    import re

    raw = text.encode("utf-8") if isinstance(text, str) else text
    plain, spans, at, point = raw.translate(_PLAIN), [], 0, 0
    wanted = iter(runs)
    run = next(wanted, None)
    for number, word in enumerate(re.finditer(rb"[^ ]+", plain)):
        if run is None:
            break
        if number == run[0]:
            point += len(raw[at : word.start()].decode("utf-8"))
            at, start = word.start(), point
        if number == run[1] - 1:
            point += len(raw[at : word.end()].decode("utf-8"))
            at = word.end()
            spans.append((start, point))
            run = next(wanted, None)
    return spans


def _blocks(items: DataFrame, width: int, most: int) -> Iterator[tuple[tuple[str, str], ...]]:
    """The items (i, t), read one after another, in blocks of a bounded number of windows; only one block is held at a time.

    An item of more windows than a block is a block of its own.
    """
    held: list[tuple[str, str]] = []
    count = 0
    for row in items.filter("i is not null and t is not null").toLocalIterator():
        n = max(0, len(plain_words(row["t"])) - width + 1) or 1
        if held and count + n > most:
            yield tuple(sorted(held))
            held, count = [], 0
        held.append((row["i"], row["t"]))
        count += n
    if held:
        yield tuple(sorted(held))


def _scan(text: Column, shared, width: int) -> Column:
    """The struct HITS of a text; no shuffle."""

    @F.arrow_udf(HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = Searcher(shared.value, width)  # once a task
        for texts in batches:
            rows = []
            for text in chain.from_iterable(few(texts)):
                parts = plain_words(text)
                runs, names = search.scan(parts)
                spans = original_spans(text, runs) if runs else []
                dicts = [[{"start": a, "end": b} for a, b in x] for x in (spans, runs)]
                rows.append((len(parts), sum(b - a for a, b in runs), sorted(names), *dicts))
            yield pa.StructArray.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(_HITS.values())], list(_HITS))

    return run(text)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, spans (code points of the original text), contaminated.

    Contaminated: a word is hit and the hit words are a twentieth of all or more. Null and empty texts have no words
    and are clean; null item texts and null item ids are no items; an empty benchmark hits nothing. Items of one id
    count once. Whole texts are scanned, of any length. Repeated documents give repeated rows; a null id is kept.
    Benchmarks of up to ``block_windows`` windows need one pass and no shuffle. Larger ones are broadcast block by
    block; what the blocks find in a text is merged by a join on the text's digest, so memory stays bounded.
    """
    rows, hits = _found(spread(docs.select(col(id_col), col(text_col)) if id_col != text_col else docs), col(text_col), items.select(col(item_id_col).cast("string").alias("i"), col(item_text_col).alias("t")), width, block_windows)
    return rows.select(col(id_col).alias("doc_id"), *(hits[n].alias(n) for n in ("n_words", "n_hit", "items", "spans")), _flag(hits).alias("contaminated"))


def flagged(docs: DataFrame, items: DataFrame, flag: str, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a column that is true for contaminated rows; see contamination()."""
    rows, hits = _found(docs, col(text_col), items.select(col(item_id_col).cast("string").alias("i"), col(item_text_col).alias("t")), width, block_windows)
    return rows.select(*(col(c) for c in docs.columns), _flag(hits).alias(flag))


def _flag(hits: Column) -> Column:
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def _found(docs: DataFrame, text: Column, items: DataFrame, width: int, most: int) -> tuple[DataFrame, Column]:
    """docs with one more column, and that column: what was found in each text."""
    spark, name = docs.sparkSession, "__corvane_hits"
    blocks = _blocks(items, width, most)
    first, second = next(blocks, ()), next(blocks, None)
    if second is None:
        return docs.withColumn(name, _scan(text, spark.sparkContext.broadcast(first), width)), F.col(name)
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    texts = docs.select(digest.alias("k"), text.alias("t"))
    found = None
    for block in chain((first, second), blocks):
        part = settle(texts.select("k", _scan(F.col("t"), spark.sparkContext.broadcast(block), width).alias("x")).select("k", "x.*").dropDuplicates(["k"]))
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("k").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        _merged("words").alias("words"),
        _merged("spans").alias("spans"),
    )
    hit = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    merged = merged.select(F.col("k").alias("__corvane_k"), F.struct("n_words", hit.alias("n_hit"), "items", "spans").alias(name))
    return docs.withColumn("__corvane_k", digest).join(merged, "__corvane_k"), F.col(name)


def _merged(name: str):
    """The union of runs that several blocks found in one text, as disjoint runs in order."""
    kind = "array<struct<start:long,end:long>>"
    every = F.array_sort(F.flatten(F.collect_list(name)))

    def fold(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).end >= x.start), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(every, F.array().cast(kind), fold)
