"""Near copies among vectors: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, settle, skew_join
from .components import components

LEAST_COSINE = 0.93
#: Vectors that the cells are fitted on, at most; every vector is placed. Results don't depend on the fit.
SAMPLE = 20_000
#: Cells, at most: what is broadcast is that many vectors. Rounds of the fit.
CELLS, ROUNDS = 1024, 8
#: The largest label of n vectors gets sqrt(n) / PER_ROOT cells.
PER_ROOT = 8
#: Vectors of a block, about: a product is of two blocks at most, 32 MB of cosines a stripe of ROWS.
CHUNK, ROWS = 4096, 1024
#: Cosines this near to the bound are taken again with exactly rounded sums.
DOUBT = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double; scaled first, so that no square over- or underflows."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centres (cells or fewer, d) of length one by spherical k-means; a cell that empties keeps its centre."""
    v = unit(vectors)
    rng = np.random.default_rng(seed)
    centres = np.unique(v[rng.permutation(len(v))[:cells]], axis=0)
    for _ in range(rounds):
        home = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, v)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return np.unique(centres, axis=0)


def places(vectors: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits): the nearest cell of each vector, and whether it has to be compared in each other cell.

    Two linked vectors are at most c = sqrt(2 - 2 * least) apart. If their homes a and b differ, the plane between the
    two centres parts them, and so one of them is within c / 2 of it. Each vector visits the cells to whose planes it is that near,
    so every linked pair meets in the home of one of them.
    """
    score = unit(vectors) @ centres.T
    home = score.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))[home]
    near = score.max(axis=1)[:, None] - score <= apart * (math.sqrt(max(0.0, 2 - 2 * least)) / 2) + 1e-9
    near[np.arange(len(home)), home] = False
    return home, near


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b, of length one, have a cosine of ``least`` or more."""
    cosine = a @ b.T
    out = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < DOUBT), strict=True):
        x, y = a[i], b[j]
        out[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= least
    return out


def _roots(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least key that each row and each column reaches through linked pairs; every row and column is spread from once."""
    top, left = rows.copy(), cols.copy()
    new_row, new_col = linked.any(axis=1), linked.any(axis=0)
    while new_row.any():
        r = np.zeros(len(rows), bool)
        r[new_row.argmax()] = True
        all_r, all_c, fresh = r.copy(), np.zeros(len(cols), bool), r
        while fresh.any():
            c = linked[fresh].any(axis=0) & ~all_c
            all_c |= c
            fresh = linked[:, c].any(axis=1) & ~all_r
            all_r |= fresh
        least = min(rows[all_r].min(), cols[all_c].min())
        top[all_r], left[all_c] = least, least
        new_row &= ~all_r
        new_col &= ~all_c
    return top, left


def _block(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """node, links, root of the linked vectors of one block: those at home (side 0) against each other or against a
    second part of the home (side 1), and against visitors (side 2)."""
    nothing = pd.DataFrame({"node": pd.Series(dtype=str), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype=str)})
    side = rows["side"].to_numpy()
    order = np.argsort(side, kind="stable")
    side, node, n = side[order], rows["node"].to_numpy()[order], rows["n"].to_numpy()[order]
    home, visits = rows["home"].to_numpy()[order], rows["visits"].to_numpy()[order]
    v = unit(np.stack(rows["v"].to_numpy()[order]).astype(np.float64))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    if rows["self"].iloc[0]:
        b = np.arange(len(side))
    if not len(a) or not len(b):
        return nothing
    cell = home[a[0]]
    also = np.array([[h in held for h in np.unique(home[b])] for held in map(set, (visits[i] for i in a))]).reshape(len(a), -1)  # whether the pair meets in the other's home too
    which = np.searchsorted(np.unique(home[b]), home[b])
    linked = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), ROWS):
        part = _linked(v[a[at : at + ROWS]], v[b], least)
        part &= ~(also[at : at + ROWS][:, which] & (home[b] < cell))
        linked[at : at + ROWS] = part
    same = rows["self"].iloc[0]
    if same:
        linked[np.arange(len(a)), np.arange(len(a))] = False  # a comes first in b
    if not linked.any():
        return nothing
    keys, place = np.unique(node, return_inverse=True)
    top, left = _roots(place[a], place[b], linked)
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, place[a], linked @ n[b])
    others = b >= len(a) if same else np.ones(len(b), bool)  # home against itself is counted from both ends already
    np.add.at(links, place[b[others]], linked[:, others].T @ n[a])
    root = np.arange(len(keys))
    np.minimum.at(root, place[a], top)
    np.minimum.at(root, place[b], left)
    found = np.flatnonzero(links)
    return pd.DataFrame({"node": keys[found], "links": links[found], "root": keys[root[found]]})


def placed(distinct: DataFrame, least: float) -> DataFrame:
    """node, g (label and length), n, v, home, visits of distinct vectors."""
    spark = distinct.sparkSession
    sizes = distinct.groupBy("g").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    length = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    cells = min(CELLS, math.ceil(math.sqrt(total["most"] or 0) / PER_ROOT))
    centres = np.zeros((1, 1))
    if length is not None and cells > 1:
        share = min(1.0, SAMPLE / length["n"])
        some = distinct.filter(F.size("v") == length["d"]).filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(share * (1 << 20)))
        held = [r["v"] for r in some.select("node", "v").orderBy("node").limit(SAMPLE).collect()]  # SAMPLE vectors at most
        centres = fit(np.array(held, np.float64), cells)
    shared = spark.sparkContext.broadcast(centres)  # CELLS vectors at most

    @F.arrow_udf("home int, visits array<int>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centres = shared.value
        for held in batches:
            sizes = np.diff(held.offsets.to_numpy()) if len(held) else np.zeros(0, int)
            home, visits = np.zeros(len(held), np.int32), [[] for _ in range(len(held))]
            fits = np.flatnonzero(sizes == centres.shape[1]) if len(centres) > 1 else np.zeros(0, int)
            if len(fits):
                some = held.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                at, near = places(some, centres, least)
                home[fits] = at
                for i, row in zip(fits, near, strict=True):
                    visits[i] = np.flatnonzero(row).tolist()
            yield pa.StructArray.from_arrays([pa.array(home), pa.array(visits, pa.list_(pa.int32()))], ["home", "visits"])

    return settle(distinct.select("node", "g", "n", "v", place("v").alias("x")).select("node", "g", "n", "v", "x.*"))


def blocks(held: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of placed() dealt into blocks (g, cell, i, j) with their side; every two parts of a cell's home share a block.

    Homes and visitors of a cell are split by a hash into parts of about ``chunk`` vectors. The first part of the
    visitors goes along with each part of the home, the others have blocks of their own.
    """
    home = F.struct("g", F.col("home").alias("cell"))
    every = F.concat(F.array(F.struct(home.alias("c"), F.lit(False).alias("visitor"))), F.transform("visits", lambda x: F.struct(F.struct("g", x.alias("cell")).alias("c"), F.lit(True).alias("visitor"))))
    rows = held.select("node", "n", "v", "home", "visits", F.explode(every).alias("x")).select("node", "n", "v", "home", "visits", "x.c", "x.visitor")
    narrow = held.select("node", F.explode(every).alias("x")).select("x.c", "x.visitor")
    parts = lambda x: F.ceil(F.count_if(x) / F.lit(chunk)).cast("int")
    sizes = narrow.groupBy("c").agg(parts(~F.col("visitor")).alias("s"), parts(F.col("visitor")).alias("t")).filter("s > 0")
    both = skew_join(rows, sizes, "c").filter("s is not null")
    at = both.withColumn("p", F.pmod(F.xxhash64("node"), F.when(F.col("visitor"), F.col("t")).otherwise(F.col("s"))).cast("int"))
    p, s, t = F.col("p"), F.col("s"), F.col("t")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    item = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    pairs = F.transform(upto(s), lambda j: item(F.least(p, j), F.greatest(p, j), F.when(p <= j, 0).otherwise(1)))
    apart = F.transform(upto(t - 1), lambda k: item(p, s + k, F.lit(0)))
    visiting = F.transform(upto(s), lambda i: item(i, F.when(p == 0, i).otherwise(s + p - 1), F.lit(2)))
    items = F.when(F.col("visitor"), visiting).otherwise(F.concat(pairs, apart))
    return at.select("node", "n", "v", "home", "visits", "c", F.explode(items).alias("x")).select("node", "n", "v", "home", "visits", "c", "x.*").withColumn("self", F.col("i") == F.col("j"))


def near_copies(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, chunk: int = CHUNK) -> DataFrame:
    """id_col, n_links, component_id, kept: one row per row, linked where labels are equal and the cosine is ``least`` or more.

    Equal vectors of one label are compared once and counted as often as they occur. All links are found (places()),
    and no pair leaves its block: a block returns counts and the links of a spanning star. A row links with nothing when its
    label, vector or id is null, when the vector is empty, zero, or has a null or non-finite component, or beside
    vectors of another length; it is its own component and stays. Rows that repeat an id are vectors of their own; those
    of the least id of a component all stay. An empty table gives an empty one; other columns play no part.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    base = rows.select(col(id_col).alias("i"), col(label_col).alias("l"), col(vector_col).alias("v"))
    able = F.col("i").isNotNull() & F.col("l").isNotNull() & F.coalesce(F.forall("v", good) & F.exists("v", lambda x: x != 0), F.lit(False))
    node = F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), "l", "v")), 16, "0") for seed in (1, 2)))  # 128 bits: one node a label and vector
    keyed = base.withColumn("node", F.when(able, node))
    known = keyed.filter("node is not null")
    distinct = settle(known.groupBy("node").agg(F.first(F.struct("l", F.size("v").alias("d"))).alias("g"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("i").alias("least")))
    held = placed(distinct.select("node", "g", "n", "v"), least)
    compared = blocks(held, chunk).groupBy("c", "i", "j").applyInPandas(lambda pdf: _block(pdf, least), "node string, links long, root string")
    found = settle(compared)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = settle(distinct.select("node", "n", "least").join(links, "node", "left").join(groups, "node", "left"))
    first = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    stats = settle(skew_join(named.filter("links > 0 or n > 1"), first, "component").select("node", F.coalesce("first", "least").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    out = skew_join(settle(keyed.select("i", "node")), stats, "node")
    component = F.coalesce("first", "i")
    return out.select(F.col("i").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("i").eqNullSafe(component).alias("kept"))
