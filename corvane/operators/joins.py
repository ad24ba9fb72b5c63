"""Joins of the query surface. The theta joins are rewritten to equi-joins on keys that the predicate implies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import matches_glob
from .lineage import settle, spread


def prefixes(uri: Column) -> Column:
    """Every prefix of an address that ends in a slash, without repeats."""
    parts = F.split(uri, "/")
    cut = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def prefix_counts(mounts: DataFrame, files: DataFrame, keys: dict[str, Column], by: list[str], uri: str = "uri") -> DataFrame:
    """mounts with, for each name in keys, how many files start with that prefix of the mount; 0 where none does.

    The rows of the files fan out to their own prefixes, as many as a path has segments, and meet the mounts on
    equal prefixes. Each file counts once for each mount and name. ``by`` identifies a mount.
    """
    wanted = mounts.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), k.alias("prefix")) for n, k in keys.items()))).alias("w"))
    wanted = wanted.select(*by, F.col("w.name").alias("name"), F.col("w.prefix").alias("prefix")).filter("prefix is not null")
    held = files.select(F.explode(prefixes(F.col(uri))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    found = wanted.join(held, "prefix").groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in keys))
    found = found.select(*(F.col(c).alias(f"__{c}") for c in by), *(F.col(n).alias(f"__n_{n}") for n in keys))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return mounts.join(found, on, "left").select(*mounts.columns, *(F.coalesce(f"__n_{n}", F.lit(0)).cast("long").alias(n) for n in keys))


#: Items of one key that one task pairs with as many others.
BLOCK_ITEMS = 2_000
#: Pairs that one task makes, about, and adds up before it passes them on.
TASK_PAIRS = 1_000_000


def co_change(changes: DataFrame, key: str = "hash", item: str = "file") -> DataFrame:
    """Pairs of items that change under one key, each once, with the number of keys. Rows are distinct (key, item).

    The items of a key are dealt to blocks of about BLOCK_ITEMS by a hash, and pairs meet by pairs of blocks, so a key
    of any number of items is many tasks' work; the pairs themselves are what was asked for. Pairs are many more than
    items, so they are counted first and decide over how many tasks the items and the sums are dealt: a task holds
    about TASK_PAIRS, however large the input.
    """
    counted = changes.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    pairs = counted.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(pairs / TASK_PAIRS))
    sizes = counted.select("k", F.ceil(F.col("n") / BLOCK_ITEMS).alias("blocks"))
    held = changes.select(F.col(key).alias("k"), F.col(item).alias("i")).join(sizes, "k")
    held = held.withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")))
    meets = lambda name, pair: held.select("k", F.col("i").alias(name), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)).alias("at")).repartition(parts, "k", "at")
    a = meets("a", lambda o: F.struct(F.col("own").alias("x"), o.alias("y")))
    b = meets("b", lambda o: F.struct(o.alias("x"), F.col("own").alias("y")))
    return a.join(b.hint("merge"), ["k", "at"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))


def _bucket(uri: Column, depth: int) -> Column:
    """The first ``depth`` slash-separated parts, or null for fewer."""
    parts = F.split(uri, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, F.lit(1), F.lit(depth)), "/"))


#: Parts of an address that governs() compares for equality: scheme, two slashes' worth, and one segment.
_DEPTH = 4


#: Terms with a wildcard in their first segment that are sent to every task; more of them are shuffled in parts.
WIDE_TERMS, WIDE_PARTS = 10_000, 32


def governs(targets: DataFrame, capsules: DataFrame, uri: str = "uri", globs: str = "relevance") -> DataFrame:
    """targets × capsules whose globs match the target; a capsule without globs governs nothing here.

    A term whose first segment is literal meets only targets with that segment, by an equi-join. The others, wide
    ones, meet all targets of their scheme: up to WIDE_TERMS of them, counted first, go to the targets, which are not
    shuffled; beyond, the targets of a scheme are dealt to WIDE_PARTS parts and the terms are sent to each. Exclusions of
    a capsule apply to all its terms. A pair comes out once.
    """
    clash = [c for c in capsules.columns if c in targets.columns]
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    terms = capsules.withColumn("__id", F.xxhash64(F.to_json(F.struct(*capsules.columns)))).withColumn("__all", F.array_join(globs, ";"))
    each = terms.select("*", F.explode(F.split("__all", ";")).alias("__term")).withColumn("__term", F.trim("__term"))
    each = each.filter("__term <> '' and not startswith(__term, '!')")
    scheme = lambda c: F.nullif(F.regexp_extract(c, r"^([a-z][a-z0-9+.-]*:)", 1), F.lit(""))
    each = each.withColumn("__key", _bucket(F.regexp_extract("__term", r"^([^*?\[{%]*)", 1), _DEPTH))
    deep, wide = each.filter("__key is not null"), each.filter("__key is null")
    wide = wide.withColumn("__key", F.coalesce(scheme(F.col("__term")), F.lit("*")))
    held = targets.filter(F.col(uri).isNotNull())
    fits = matches_glob(F.col(uri), F.col("__term"))
    met = held.withColumn("__key", _bucket(F.col(uri), _DEPTH)).join(deep, "__key").filter(fits)
    broad = held.withColumn("__key", F.explode(F.array_compact(F.array(scheme(F.col(uri)), F.lit("*")))))
    if wide.limit(WIDE_TERMS + 1).count() <= WIDE_TERMS:
        broad = broad.join(F.broadcast(wide), "__key")
    else:
        part = F.pmod(F.xxhash64(uri), F.lit(WIDE_PARTS)).alias("__part")
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDE_PARTS - 1).cast("long"))).alias("__part")
        broad = broad.select("*", part).join(wide.select("*", parts), ["__key", "__part"]).drop("__part")
    met = met.unionByName(broad.filter(fits))
    barred = F.array_join(F.filter(F.transform(F.split("__all", ";"), lambda t: F.trim(t)), lambda t: t.startswith("!")), ";")
    met = met.withColumn("__barred", barred).filter((F.col("__barred") == "") | matches_glob(F.col(uri), F.col("__barred")))
    return met.dropDuplicates([uri, "__id"]).select(*targets.columns, *capsules.columns)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


#: Terms that are sent to every task to filter by; with more, all runs of words are dealt out.
FEW_TERMS = 10_000
#: Terms that a text is searched for one by one.
WALKED_TERMS = 200


def contains(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """texts × terms that occur in them as whole words, any case. Each pair comes out once.

    A text names the terms that it holds and meets them on equal words: up to WALKED_TERMS terms it looks for each, up
    to FEW_TERMS it keeps those of its runs of words that are terms, and with more it deals all its distinct runs out.
    Runs are taken in the lengths that terms have, so a term may have any number of words. Nothing is compared
    pairwise.
    """
    run = F.array_join(tokens(F.col(term)), " ")
    keyed = terms.withColumn("__key", run).filter("__key <> ''")
    texts = spread(texts)
    distinct = keyed.select("__key").distinct()
    n = distinct.limit(FEW_TERMS + 1).count()
    sizes = distinct.select(F.size(F.split("__key", " ")).alias("n")).agg(F.collect_set("n").alias("__n"))  # one row
    texts = texts.join(F.broadcast(sizes))
    if n <= FEW_TERMS:
        texts = texts.join(F.broadcast(distinct.agg(F.collect_list("__key").alias("__e"))))  # one row
    words = texts.withColumn("__w", tokens(F.col(text)))
    if n <= WALKED_TERMS:
        plain = F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" "))
        runs = words.withColumn("__p", plain).withColumn("__g", F.filter("__e", lambda t: F.contains(F.col("__p"), F.concat(F.lit(" "), t, F.lit(" "))))).drop("__p")
    else:
        starts = lambda n: F.sequence(F.lit(1), F.size("__w") - n + 1)
        of = lambda n: F.when(F.size("__w") >= n, F.transform(starts(n), lambda i: F.array_join(F.slice("__w", i, n), " "))).otherwise(F.array().cast("array<string>"))
        grams = F.array_distinct(F.flatten(F.transform("__n", of)))
        runs = words.withColumn("__g", F.array_intersect(grams, "__e") if n <= FEW_TERMS else grams)
    return runs.withColumn("__key", F.explode("__g")).drop("__g", "__w", "__e", "__n").join(keyed, "__key").drop("__key")


#: Characters of the aliases that one pass over the texts looks for with an automaton; a worker holds about 50 bytes for each.
ALIAS_CHARS = 4_000_000


def redundant(aliases: DataFrame, docs: DataFrame, alias: str = "alias", text: str = "text") -> DataFrame:
    """aliases with redundant: found verbatim in some text.

    Up to WALKED_TERMS aliases are looked for one by one; more of them make one automaton, which reads a text once
    however many there are, or one for each ALIAS_CHARS of them. A text names those that it holds, and only names are
    shuffled.
    """
    held = aliases.select(alias).filter(F.col(alias).isNotNull()).distinct()
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(alias)), F.lit(0)).alias("chars")).first()
    if size["n"] <= WALKED_TERMS:
        every = held.agg(F.collect_list(alias).alias("__a"))
        found = docs.select(text).join(F.broadcast(every)).select(F.explode(F.filter("__a", lambda a: F.contains(F.col(text), a))).alias(alias)).distinct()
    else:
        found, blocks = None, size["chars"] // ALIAS_CHARS + 1
        for block in range(blocks):
            names = [r[0] for r in held.filter(F.pmod(F.xxhash64(alias), F.lit(blocks)) == block).collect()]  # about ALIAS_CHARS characters
            shared = docs.sparkSession.sparkContext.broadcast(names)
            here = spread(docs.select(text)).select(F.explode(_held_in(F.col(text), shared)).alias(alias)).distinct()
            found = here if found is None else found.unionByName(here)
    return aliases.join(found.withColumn("__f", F.lit(True)), alias, "left").withColumn("redundant", F.coalesce("__f", F.lit(False))).drop("__f")


def _held_in(text: Column, shared) -> Column:
    """Those of the broadcast names that a text holds anywhere; null holds none, and any text holds the empty name."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        names, automaton = shared.value, ahocorasick.Automaton()
        empty = {""} & set(names)
        for number, name in enumerate(names):
            if name:
                automaton.add_word(name, number)
        automaton.make_automaton()
        search = automaton.iter if len(automaton) else lambda value: ()
        for texts in batches:
            yield pd.Series([[] if value is None else sorted({names[i] for _, i in search(value)} | empty) for value in texts], dtype=object)

    return run(text)


def references(edges: DataFrame, known: DataFrame, src: str = "src", dst: str = "dst", uri: str = "uri") -> DataFrame:
    """edges with band: resolved when the target exists, name when only something of its last segment does, else unresolved."""
    tail = lambda c: F.substring_index(F.regexp_replace(c, r"[?#].*$", ""), "/", -1)
    names = known.select(F.col(uri).alias("__u")).distinct()
    tails = names.select(tail(F.col("__u")).alias("__t")).filter("__t <> ''").distinct()
    held = edges.withColumn("__tail", tail(F.col(dst)))
    a = held.join(names, held[dst] == names["__u"], "left").join(tails, held["__tail"] == tails["__t"], "left")
    band = F.when(F.col("__u").isNotNull(), "resolved").when(F.col("__t").isNotNull(), "name").otherwise("unresolved")
    return a.withColumn("band", band).drop("__u", "__t", "__tail")


def reachable(edges: DataFrame, seeds: DataFrame, most: int = 50, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """(seed, node, depth): every node that a seed reaches, with the least number of steps; the seed itself at 0.

    Breadth-first: each round is one join of the frontier with the edges and one anti-join with what is known, cut
    off by a checkpoint. Cycles and self links end by themselves; more than ``most`` rounds is an error.
    """
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    front = settle(seeds.select(F.col(node).alias("seed"), F.col(node).alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    seen = front
    for depth in range(1, most + 1):
        ahead = front.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        front = settle(ahead.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"a path is longer than {most}")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null when a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
