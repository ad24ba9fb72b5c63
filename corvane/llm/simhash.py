"""Near-duplicate search on 64-bit SimHash fingerprints by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, few, settle, skew_join, spread
from .components import components

BITS = 64
#: Fingerprints link at this many differing bits or fewer.
RADIUS = 2


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks; for any two values that differ in at most radius bits, some mask covers no differing bit.

    Bit i carries a nonzero vector m(i) of radius + 1 bits; the mask of a nonzero vector v has the bits with an odd
    product of m(i) and v. At most radius vectors never span the whole space, so some v is orthogonal to those of
    all differing bits, and its mask leaves them out: the values agree under it.
    """
    return refined(0, radius, bits)


def refined(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Covering masks over the bits that a mask leaves out, with those of the mask itself.

    Two values that agree under the mask and differ in at most radius bits differ in bits that it leaves out, so they
    agree under one of these as well.
    """
    size = 2 ** (radius + 1) - 1
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for k, i in enumerate(free) if ((k % size + 1) & v).bit_count() % 2) for v in range(1, size + 1)]


#: Levels of covering. Under a mask of the third only six bits are left out, so a bucket holds 64 fingerprints at most.
LEVELS = 3


def mask_levels(levels: int = LEVELS) -> list[list[int]]:
    """The masks of each level: those that refine mask n of one level are masks 7 n to 7 n + 6 of the next."""
    out = [covering_masks()]
    while len(out) < levels:
        out.append([m for mask in out[-1] for m in refined(mask)])
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint_bytes(text: str | bytes | None, width: int = 3) -> int:
    """Fingerprint of one whole text: each bit is the majority over the XXH64 of its word shingles, repeats included."""
    import numpy as np
    import xxhash

    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    parts = raw.lower().split()  # on bytes both touch ASCII only
    if not parts:
        return 0
    if len(parts) <= width:
        return xxhash.xxh64_intdigest(b" ".join(parts), 42)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(width)), strict=False))
    count = len(parts) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=count)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, 16384):  # bounds the unpacked bits of very long texts
        block = hashes[at : at + 16384]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf(T.LongType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([signed(fingerprint_bytes(x, width)) for some in few(texts) for x in some], pa.int64())

    return of(text)


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) of all pairs within RADIUS bits.

    The covering tables bring together every such pair. A bucket of two is its only pair and is checked as such. The
    members of a fuller bucket are dealt out anew by the masks that refine its own, which again bring together every
    such pair of them; after LEVELS levels a bucket has 64 members at most, and they are compared. So no bucket is ever
    compared that could grow with the data.
    """
    tables = mask_levels()
    size = len(tables[0])
    here, found = prints.select("fp", F.lit(0).alias("node")), None
    for level, masks in enumerate(tables):
        every = F.array(*(F.lit(signed(m)) for m in masks))
        tables_of = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.col("node") * size + c)
        dealt = here.select("fp", F.explode(tables_of).alias("t")).select("fp", "t", F.col("fp").bitwiseAND(F.element_at(every, F.col("t") + 1)).alias("key"))
        if level == len(tables) - 1:
            groups = dealt.groupBy("t", "key").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
            near = F.filter("all", lambda b: (b < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= RADIUS))
            return found.unionByName(groups.select(F.explode("all").alias("a"), "all").select("a", F.explode(near).alias("b"))).distinct()
        buckets = settle(dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
        pairs = buckets.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        here = settle(dealt.join(buckets.filter("n > 2").select("t", "key"), ["t", "key"], "left_semi").select("fp", F.col("t").alias("node")))
        if here.isEmpty():
            break
    return found.distinct()


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, fp (long), root, component_id, and the ``carry`` columns computed from docs.

    root is the least fingerprint of the component and component_id the least id.

    Null and blank texts have fingerprint zero and link like any other. Equal texts meet in one fingerprint before
    any bucket is built, so copies cost nothing. Repeated rows stay as they are; a null id takes part in linking but
    never names a component unless a component has no other (then component_id is null). Extra columns are ignored.
    """
    carry = carry or {}
    rows = settle(spread(docs).select(col(id_col).alias("doc_id"), fingerprint(col(text_col)).alias("fp"), *(c.alias(n) for n, c in carry.items())))
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(prints.select("fp")))
    named = settle(prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = skew_join(named.select("fp", "component"), least, "component").select("fp", F.col("component").alias("root"), "component_id")
    return skew_join(rows, ends, "fp").select("doc_id", "fp", "root", "component_id", *carry)  # many copies are one hot fingerprint
