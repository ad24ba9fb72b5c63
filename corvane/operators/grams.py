"""Lines by pattern from a stored index of trigrams: what every match must contain, then the match itself."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search
from .lineage import remove, spread
from .postings import FOLDER, FOLDERS, RANGE, SLICE, Segments

#: Strings that a part of a pattern is spelled out to, at most, and their length; beyond that fewer trigrams are required.
SPELLED, LENGTH = 16, 64
#: Trigrams of one conjunction that are looked up: the rarest, as each of them only narrows the candidates.
RAREST = 8
#: Postings of a range, about, at most (32 MB in its task), blocks of an Arrow batch, and bytes of a text that are arrays at a time.
POSTINGS, BLOCKS, STEP = 4_000_000, 4096, 1 << 20
#: What a match must contain: None for nothing known, a trigram, or ("and" | "or", parts).
Needs = None | str | tuple[str, tuple]


def grams(text: str) -> set[str]:
    """The trigrams of a lower-cased text in ASCII and within a line."""
    return {g for i in range(len(text) - 2) if (g := text[i : i + 3]).isascii() and "\n" not in g}


def both(kind: str, parts: list[Needs]) -> Needs:
    """The conjunction or disjunction of needs, without repeats; None is true."""
    if kind == "or" and None in parts:
        return None
    held = list(dict.fromkeys(p for p in parts if p is not None))
    flat = list(dict.fromkeys(x for p in held for x in (p[1] if isinstance(p, tuple) and p[0] == kind else (p,))))
    return None if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def spelled(strings: set[str]) -> Needs:
    """What a text needs that holds one of these strings."""
    return both("or", [both("and", sorted(grams(x))) for x in sorted(strings)])


class _Pattern:
    """The needs of a parsed pattern: of each part the strings that it can be, if few, else what they must contain."""

    def whole(self, items) -> tuple[set[str] | None, Needs]:
        run, needs, broken = {""}, [], False
        for op, value in items:
            strings, inner = self.part(op, value)
            if strings is not None:
                longer = {a + b for a, b in product(run, strings)}
                if len(longer) <= SPELLED and max(map(len, longer)) <= LENGTH:
                    run = longer
                    continue
            needs += [spelled(run), inner]
            broken, run = True, strings if strings is not None else {""}
        return (None if broken else run), both("and", [*needs, spelled(run)])

    def part(self, op, value) -> tuple[set[str] | None, Needs]:
        if op is sre.LITERAL:
            return ({chr(value).lower()}, None) if value < 128 else (None, None)
        if op is sre.IN:
            return self.one_of(value), None
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            return {""}, None
        if op is sre.SUBPATTERN:
            return self.whole(value[3])
        if op is sre.ATOMIC_GROUP:
            return self.whole(value)
        if op is sre.BRANCH:
            each = [self.whole(x) for x in value[1]]
            every = set().union(*(x for x, _ in each if x is not None))
            return (every if len(every) <= SPELLED and all(x is not None for x, _ in each) else None), both("or", [n for _, n in each])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            strings, needs = self.whole(inner)
            if strings is not None and most is not sre.MAXREPEAT and most <= 4:
                out = {"".join(x) for n in range(least, most + 1) for x in product(strings, repeat=n)} if len(strings) ** most <= SPELLED else set()
                if 0 < len(out) <= SPELLED:
                    return out, None
            return None, needs if least else None
        return None, None

    @staticmethod
    def one_of(members) -> set[str] | None:
        out: set[str] = set()
        for op, value in members:
            if op is sre.LITERAL:
                codes = range(value, value + 1)
            elif op is sre.RANGE and value[1] - value[0] < SPELLED:
                codes = range(value[0], value[1] + 1)
            else:
                return None
            if codes[-1] > 127:
                return None
            out |= {chr(c).lower() for c in codes}
        return out


def required(pattern: str, is_regex: bool = False) -> Needs:
    """What the lower-cased text of every match contains; None where nothing can be said, and all texts must be read.

    Expressions are Java's. What is written or meant otherwise than in the parser used here is left open (classes by name, ``\\v``) or gives
    None (quotations, intersections, nested classes, flags for Unicode case).
    """
    if not is_regex:
        return both("and", sorted(grams("".join(c.lower() if c.isascii() else "\n" for c in pattern))))
    if re.search(r"\\[QEN]|&&|\[[^\]]*\[|\(\?[a-zA-Z-]*[uUdxL]", pattern):
        return None
    plain = re.sub(r"\\(?:[pP]\{[^}]*\}|[pP].|.)", lambda m: r"\w" if m[0][1] in "pPvhHRX" else m[0], pattern, flags=re.DOTALL)
    try:
        return _Pattern().whole(_parser.parse(plain))[1]
    except (re.error, OverflowError, RecursionError):
        return None


def wanted(needs: Needs) -> list[str]:
    """The trigrams that needs name."""
    return [] if needs is None else [needs] if isinstance(needs, str) else list(dict.fromkeys(g for p in needs[1] for g in wanted(p)))


def narrowed(needs: Needs, df: dict[str, int]) -> Needs:
    """Needs with the RAREST trigrams of each conjunction alone."""
    if needs is None or isinstance(needs, str):
        return needs
    kind, parts = needs
    if kind == "and":
        own = sorted((p for p in parts if isinstance(p, str)), key=lambda g: (df.get(g, 0), g))[:RAREST]
        parts = (*own, *(p for p in parts if not isinstance(p, str)))
    return both(kind, [narrowed(p, df) for p in parts])


def codes(text: bytes) -> np.ndarray:
    """grams() of a text in UTF-8, as sorted numbers of 21 bits; a long text is gone through STEP bytes at a time."""
    found = [np.zeros(0, np.int32)]
    for at in range(0, len(text), STEP):
        raw = np.frombuffer(text, np.uint8, min(STEP + 2, len(text) - at), at)
        plain = (raw < 128) & (raw != 10)
        b = raw.astype(np.int32)
        found.append(np.unique((b[:-2] << 14 | b[1:-1] << 7 | b[2:])[plain[:-2] & plain[1:-1] & plain[2:]]))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


class _Run:
    """Documents of one range, in their order, and the numbers of their trigrams; blocks() turns them over."""

    def __init__(self, r: int):
        self.r, self.docs, self.postings = r, 0, 0
        self.held: list[np.ndarray] = []

    def add(self, text: bytes) -> int:
        own = codes(text)
        self.held.append(own.astype(np.int64) << 16 | self.docs)
        self.docs, self.postings = self.docs + 1, self.postings + len(own)
        return len(own)

    @property
    def full(self) -> bool:
        return self.docs >= RANGE or self.postings >= POSTINGS

    def blocks(self, key: pa.DataType) -> Iterator[pa.RecordBatch]:
        pairs = np.sort(np.concatenate([np.zeros(0, np.int64), *self.held]))
        code = pairs >> 16
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        ends, places = np.append(starts, len(pairs)), (pairs & 0xFFFF).astype(np.int16)
        for at in range(0, len(starts), BLOCKS):
            some = ends[at : at + BLOCKS + 1]
            names = [chr(c >> 14) + chr(c >> 7 & 127) + chr(c & 127) for c in code[some[:-1]].tolist()]
            lists = pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(places[some[0] : some[-1]]))
            nulls = pa.nulls(len(names), pa.int32())
            yield _batch(pa.nulls(len(names), key), self.r, pa.nulls(len(names), pa.int16()), nulls, pa.array(names, pa.string()), lists)


def _batch(k: pa.Array, r: int, i: pa.Array, n: pa.Array, gram: pa.Array, places: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([k, pa.array(np.full(len(k), r, np.int64)), i, n, gram, places], ["k", "r", "i", "n", "gram", "places"])


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t) -> a row (k, r, i, n) of each document, and rows (r, gram, places: the i that hold it) of each range.

    A range is a run of documents of one task, so nothing is shuffled to number them; its r begins with the task's number.
    """
    from pyspark import TaskContext

    run = _Run(TaskContext.get().partitionId() << 32)
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for at in range(0, len(batch), SLICE):
            keys, texts = batch.column(0).slice(at, SLICE), batch.column(1).slice(at, SLICE).cast(pa.large_binary()).to_pylist()
            first, where, sizes = 0, [], []
            for j, text in enumerate(texts, 1):
                where.append(run.docs)
                sizes.append(run.add(text or b""))
                if run.full or j == len(texts):
                    yield _batch(keys.slice(first, j - first), run.r, pa.array(where, pa.int16()), pa.array(sizes, pa.int32()), pa.nulls(len(where), pa.string()), pa.nulls(len(where), pa.list_(pa.int16())))
                    first, where, sizes = j, [], []
                if run.full:
                    yield from run.blocks(kind)
                    run = _Run(run.r + 1)
    if run.docs:
        yield from run.blocks(kind)


class GramIndex(Segments):
    """Trigrams of documents: a segment has grams (bucket, gram, r, docs, places) and rows (k, r, i, n: the trigrams of the text).

    Places are the numbers i of documents in their range r, so a posting is two bytes however long the keys are.
    """

    def _write(self, docs: DataFrame) -> dict:
        name = uuid4().hex
        at = f"{self.path}/{name}"
        rows = spread(docs.select(F.col(self.key).alias("k"), F.lower(self.text).alias("t")))
        kind = rows.schema["k"].dataType.simpleString()
        rows.mapInArrow(inverted, f"k {kind}, r bigint, i smallint, n int, gram string, places array<smallint>").write.parquet(f"{at}/runs")
        runs = self.spark.read.parquet(f"{at}/runs")
        runs.filter("gram is null").select("k", "r", "i", "n").write.parquet(f"{at}/rows")
        n_docs = self.spark.read.parquet(f"{at}/rows").count()
        folders = min(FOLDERS, max(1, -(-n_docs // FOLDER)))
        order = ("bucket", "gram", "r")
        blocks = runs.filter("gram is not null").select((F.crc32("gram") % folders).cast("int").alias("bucket"), "gram", "r", F.size("places").alias("docs"), "places")
        blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{at}/grams")
        remove(self.spark, f"{at}/runs")
        return {"name": name, "folders": folders, "docs": n_docs, "sized": n_docs, "words": 0, "dead": []}

    def _blocks(self, segment: dict, named: list[str]) -> DataFrame:
        rows = self.spark.read.schema("gram string, r bigint, docs int, places array<smallint>, bucket int").parquet(f"{self.path}/{segment['name']}/grams")
        return rows.filter(F.col("bucket").isin(sorted({crc32(g.encode()) % segment["folders"] for g in named})) & F.col("gram").isin(named))

    def _rows(self, segment: dict, *names: str) -> DataFrame:
        return self._alive(self.spark.read.parquet(f"{self.path}/{segment['name']}/rows").select("k", *names), segment)

    def candidates(self, needs: Needs) -> DataFrame:
        """The keys of all documents that contain what is needed. Only blocks of the trigrams looked up are read.

        Places are met range by range, as arrays of RANGE numbers at most; keys are looked up for what is left.
        """
        if needs is None:
            every = [self._rows(s) for s in self.segments]
            return reduce(DataFrame.unionByName, every).select(F.col("k").alias(self.key))
        counts = reduce(DataFrame.unionByName, (self._blocks(s, wanted(needs)).select("gram", "docs") for s in self.segments))
        df = {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("docs").alias("n")).collect()}  # a row a trigram of the pattern
        needs = narrowed(needs, df)
        named = wanted(needs)

        def holds(x: Needs) -> Column:
            if isinstance(x, str):
                return F.col(f"g{named.index(x)}")
            return reduce(F.array_intersect if x[0] == "and" else F.array_union, map(holds, x[1]))

        own = [F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("places")))).alias(f"g{i}") for i, g in enumerate(named)]  # one block a range
        parts = []
        for s in self.segments:
            found = self._blocks(s, named).groupBy("r").agg(*own).select("r", F.explode(holds(needs)).alias("i"))
            parts.append(self._rows(s, "r", "i").join(found, ["r", "i"], "left_semi"))
        return reduce(DataFrame.unionByName, parts).select(F.col("k").alias(self.key))

    def grep(self, docs: DataFrame, pattern: str, is_regex: bool = False, most: int = search.GREP_RESULTS, case_sensitive: bool | None = None) -> DataFrame:
        """What search.grep() returns for docs, the documents indexed, with texts compared of the candidates alone."""
        needs = required(pattern, is_regex)
        held = docs if needs is None or not self.segments else docs.join(self.candidates(needs), self.key, "left_semi")
        return search.grep(held, pattern, is_regex, most, case_sensitive, self.key, self.text)

    def share(self, pattern: str, is_regex: bool = False) -> DataFrame:
        """One row: pattern, texts, and how many of them have to be compared."""
        texts = sum(s["docs"] for s in self.segments)
        found = self.candidates(required(pattern, is_regex)).agg(F.count("*").alias("compared"))
        return found.select(F.lit(pattern).alias("pattern"), F.lit(texts).cast("long").alias("texts"), "compared")
