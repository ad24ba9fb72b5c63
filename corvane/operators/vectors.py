"""Similar vectors: blocked products of a set of queries with all rows, and a stored index of cells and residual codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins
from .lineage import settle, spread

#: Vectors that the cells of an index are fitted on, at most, and cells, at most; every row is indexed.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 6
#: Rows of a block on either side, about.
CHUNK, QUERIES = 8192, 1024
#: Scores are rounded to these decimals before they are ranked; bounds leave room for half a unit and for rounding errors.
DIGITS = 6
ROOM = 10.0**-DIGITS
#: Cells that a query looks into first.
PROBES = 4


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, no null or non-finite component, not all zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce(F.forall(vector, good) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(held: pa.Array) -> np.ndarray:
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(held), -1)


def _best(low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Which candidates of each row (queries x rows) can be among its ``most`` best, by their bounds."""
    if low.shape[1] <= most:
        return np.isfinite(high)
    bar = np.partition(low, low.shape[1] - most, axis=1)[:, low.shape[1] - most]
    return (high >= bar[:, None] - ROOM) & np.isfinite(high)


CANDIDATES = "q {q}, k {k}, low double, high double"


def _schema(queries: DataFrame, rows: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return CANDIDATES.format(q=kind(queries, "q"), k=kind(rows, "k"))


def _dealt(rows: DataFrame, queries: DataFrame, by: list[str], sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their parts (i, j): each part of the rows of a group meets each part of its queries.

    ``sizes`` has the number of parts s and t of each group, a row a group.
    """
    held = rows.join(F.broadcast(sizes), by) if by else rows.crossJoin(F.broadcast(sizes))  # at most CELLS rows; one without groups
    asked = queries.join(F.broadcast(sizes), by) if by else queries.crossJoin(F.broadcast(sizes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    return (
        held.select("*", part("k", "s").alias("i"), every("t").alias("j")).drop("s", "t"),
        asked.select("*", part("q", "t").alias("j"), every("s").alias("i")).drop("s", "t"),
    )


def _parts(n: Column, of: int) -> Column:
    return F.greatest(F.ceil(n / F.lit(of)), F.lit(1)).cast("int")


def reranked(found: DataFrame, queries: DataFrame, rows: DataFrame, keep) -> DataFrame:
    """q, k, score of candidates, by the exact cosine of the vectors themselves, in double, rounded."""
    both = found.select("q", "k").join(queries.select("q", F.col("v").alias("a")), "q").join(rows.select("k", F.col("v").alias("b")), "k")
    scored = both.select("q", "k", F.round(joins.cosine(F.col("b"), F.col("a")), DIGITS).alias("score"))
    return keep(scored)


def _top(most: int):
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("k").asc())
    return lambda scored: scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def _reach(found: DataFrame, most: int) -> DataFrame:
    """q, bar: what the best ``most`` candidates of a query reach for sure; below it where there are fewer."""
    lows = F.slice(F.sort_array(F.collect_list("low"), False), F.lit(most), F.lit(1))
    return found.groupBy("q").agg(lows.alias("b")).select("q", F.coalesce(F.try_element_at("b", F.lit(1)), F.lit(-2.0)).alias("bar"))


def _named(df: DataFrame, key: str, vector: str, as_: str) -> DataFrame:
    return df.select(F.col(key).alias(as_), F.col(vector).cast("array<double>").alias("v")).filter(F.col(as_).isNotNull() & sound(F.col("v")))


def top_k(queries: DataFrame, rows: DataFrame, most: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, rank, key, score: for each query the ``most`` rows of the highest cosine, itself left out, exactly.

    Both sides are dealt into parts of bounded size, and a task multiplies one part with one part and returns the best
    of that block only; what is shuffled is each row once a part of the queries. Rows and queries without a direction or an
    id, and rows of another length than a query, are in no answer. Ties go by key.
    """
    asked, held = _named(queries, key, vector, "q"), _named(rows, key, vector, "k")
    sizes = held.agg(_parts(F.count("*"), CHUNK).alias("s")).crossJoin(F.broadcast(asked.agg(_parts(F.count("*"), QUERIES).alias("t"))))  # one row
    left, right = _dealt(held, asked, [], sizes)

    def block(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d in sorted({len(v) for v in theirs["v"]} & {len(v) for v in ours["v"]}):
            a, b = theirs[theirs["v"].map(len) == d], ours[ours["v"].map(len) == d]
            score = _unit(np.stack(a["v"])) @ _unit(np.stack(b["v"])).T
            score[a["q"].to_numpy()[:, None] == b["k"].to_numpy()[None, :]] = -np.inf
            x, y = np.nonzero(_best(score, score, most))
            out.append(pd.DataFrame({"q": a["q"].to_numpy()[x], "k": b["k"].to_numpy()[y], "low": score[x, y], "high": score[x, y]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "k": [], "low": [], "high": []}).astype({"q": theirs["q"].dtype, "k": ours["k"].dtype})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(block, _schema(asked, held))
    best = reranked(found, asked, held, _top(most))
    return best.select(F.col("q").alias("query"), "rank", F.col("k").alias(key), "score")


class VectorIndex:
    """Cells of vectors under a path: each row's cell, its residual from the cell's centre in eight bits a component, and
    how far the code is from the vector.

    The bounds that follow from that distance are exact, so a search misses nothing within the cells that it looks
    into; ``exact`` goes on to every cell that by its radius may still hold a better row.
    """

    def __init__(self, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding"):
        self.key, self.vector, self.path, self.spark = key, vector, path, vectors.sparkSession
        self.rows = _named(vectors, key, vector, "k")
        self.centres = self.radii = np.zeros((0, 0))

    def build(self, cells: int | None = None) -> VectorIndex:
        """Fit the cells on SAMPLE rows at most, the least by a hash of their keys, and write every row's code."""
        size = self.rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).collect()  # a row a length
        if not size:
            return self
        if len(size) > 1:
            raise ValueError(f"vectors of several lengths: {sorted(r['d'] for r in size)}")
        n = size[0]["n"]
        cells = max(1, min(cells or math.ceil(math.sqrt(n) / 4), CELLS, n))
        some = self.rows if n <= SAMPLE else self.rows.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
        held = _unit(np.array([r["v"] for r in some.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()]))  # SAMPLE rows
        centres = held[:cells].copy()
        for _ in range(ROUNDS):
            home = (held @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, held)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
        step = float(np.abs(held - centres[(held @ centres.T).argmax(axis=1)]).max()) / 127 or 1.0
        shared = self.spark.sparkContext.broadcast((centres, step))  # CELLS vectors at most

        @F.arrow_udf("cell int, code array<tinyint>, err double, angle double")
        def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            centres, step = shared.value
            for batch in batches:
                u = _unit(_matrix(batch)) if len(batch) else np.zeros((0, centres.shape[1]))
                score = u @ centres.T
                home = score.argmax(axis=1)
                rest = u - centres[home]
                code = np.clip(np.rint(rest / step), -127, 127).astype(np.int8)
                err = np.sqrt(((rest - step * code) ** 2).sum(axis=1)) + 1e-9
                angle = np.arccos(np.clip(score.max(axis=1), -1, 1)) if len(u) else np.zeros(0)
                yield pa.StructArray.from_arrays([pa.array(home, pa.int32()), pa.array(list(code), pa.list_(pa.int8())), pa.array(err), pa.array(angle)], ["cell", "code", "err", "angle"])

        files = max(1, math.ceil(n / cells / 100_000))
        done = spread(self.rows).select("k", coded("v").alias("x")).select("k", "x.*")
        done.repartition("cell", F.pmod(F.xxhash64("k"), F.lit(files))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/codes")
        about = self.codes().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row a cell
        self.radii = np.full(cells, -1.0)
        for r in about:
            self.radii[r["cell"]] = r["radius"]
        self.sizes = self.spark.createDataFrame([(r["cell"], r["n"]) for r in about], "cell int, n long")
        self.centres, self.step = centres, step
        return self

    def codes(self) -> DataFrame:
        return self.spark.read.schema("k {}, code array<tinyint>, err double, angle double, cell int".format(self.rows.schema["k"].dataType.simpleString())).parquet(f"{self.path}/codes")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """q, v, cells: every cell with the highest cosine that a row of it can have, the nearest first."""
        shared = self.spark.sparkContext.broadcast((self.centres, self.radii))

        @F.arrow_udf("array<struct<cell: int, bound: double>>")
        def ordered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            centres, radii = shared.value
            live = np.flatnonzero(radii >= 0)
            for batch in batches:
                u = _unit(_matrix(batch)) if len(batch) else np.zeros((0, centres.shape[1]))
                angle = np.arccos(np.clip(u @ centres[live].T, -1, 1))
                bound = np.cos(np.maximum(angle - radii[live], 0))
                order = np.argsort(angle, axis=1, kind="stable")
                yield pa.array([[{"cell": int(live[c]), "bound": float(b[c])} for c in o] for o, b in zip(order, bound, strict=True)], pa.list_(pa.struct([("cell", pa.int32()), ("bound", pa.float64())])))

        asked = _named(queries, self.key, self.vector, "q").filter(F.size("v") == self.centres.shape[1])
        return settle(asked.select("q", "v", ordered("v").alias("cells")))

    def _compared(self, asked: DataFrame, most: int | None, least: float) -> DataFrame:
        """q, k, low, high of the candidates in the cells that asked (q, v, cell, bar) names; ``most`` of a block, or all of at least ``least``."""
        sizes = asked.groupBy("cell").agg(_parts(F.count("*"), QUERIES).alias("t")).join(F.broadcast(self.sizes), "cell").select("cell", "t", _parts(F.col("n"), CHUNK).alias("s"))
        left, right = _dealt(self.codes().drop("angle"), asked, ["cell"], sizes)
        shared = self.spark.sparkContext.broadcast((self.centres, self.step))

        def block(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(ours) or not len(theirs):
                return pd.DataFrame({"q": theirs["q"][:0], "k": ours["k"][:0], "low": np.zeros(0), "high": np.zeros(0)})
            centres, step = shared.value
            u = _unit(np.stack(theirs["v"]))
            about = (u @ centres[int(ours["cell"].iloc[0])])[:, None] + (u * step) @ np.stack(ours["code"]).astype(np.float64).T
            about[theirs["q"].to_numpy()[:, None] == ours["k"].to_numpy()[None, :]] = -np.inf
            err = ours["err"].to_numpy()
            low, high = about - err, about + err
            good = _best(low, high, most) if most else np.isfinite(high)
            good &= high >= np.maximum(theirs["bar"].to_numpy()[:, None], least) - ROOM
            x, y = np.nonzero(good)
            return pd.DataFrame({"q": theirs["q"].to_numpy()[x], "k": ours["k"].to_numpy()[y], "low": low[x, y], "high": high[x, y]})

        return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(block, _schema(asked, self.rows))

    def search(self, queries: DataFrame, most: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """query, rank, key, score, as top_k() returns them: from the ``probes`` nearest cells, or exactly.

        Codes alone are shuffled to find candidates; the vectors of those are then compared themselves.
        """
        if not len(self.centres):
            return top_k(queries, self.rows.select(F.col("k").alias(self.key), F.col("v").alias(self.vector)), most, self.key, self.vector)
        asked = self._asked(queries)
        near = asked.select("q", "v", F.lit(-2.0).alias("bar"), F.explode(F.slice("cells", F.lit(1), F.lit(probes))).alias("c")).select("q", "v", "bar", "c.cell")
        found = settle(self._compared(near, most, -2.0))
        if exact:
            far = asked.join(_reach(found, most), "q", "left").select("q", "v", F.coalesce("bar", F.lit(-2.0)).alias("bar"), F.explode(F.slice("cells", F.lit(probes + 1), F.greatest(F.size("cells"), F.lit(1)))).alias("c"))
            far = far.filter(F.col("c.bound") >= F.col("bar") - ROOM).select("q", "v", "bar", "c.cell")
            found = found.unionByName(settle(self._compared(far, most, -2.0)))
        kept = found.join(_reach(found, most), "q").filter(F.col("high") >= F.col("bar") - ROOM)
        best = reranked(kept, asked, self.rows, _top(most))
        return best.select(F.col("q").alias("query"), "rank", F.col("k").alias(self.key), "score")

    def probes_for(self, most: int, share: float = 0.95, asked: int = 200) -> int:
        """How many cells to look into, so that ``share`` of the neighbours of ``asked`` rows, drawn by a hash of their keys, lie there."""
        drawn = self.rows.orderBy(F.xxhash64(F.lit(1), "k"), "k").limit(asked).select(F.col("k").alias(self.key), F.col("v").alias(self.vector))
        every = self.rows.select(F.col("k").alias(self.key), F.col("v").alias(self.vector))
        truth = top_k(drawn, every, most, self.key, self.vector).select(F.col("query").alias("q"), F.col(self.key).alias("k"))
        order = self._asked(drawn).select("q", F.transform("cells", lambda c: c.cell).alias("order"))
        at = truth.join(order, "q").join(self.codes().select("k", "cell"), "k").select(F.array_position("order", F.col("cell")).alias("at"))
        counts = at.groupBy("at").count().orderBy("at").collect()  # a row a cell
        total, held = sum(r["count"] for r in counts), 0
        for r in counts:
            held += r["count"]
            if held >= share * total:
                return int(r["at"])
        return len(self.centres)

    def within(self, queries: DataFrame, least: float) -> DataFrame:
        """query, key, score of all rows whose rounded cosine with a query is ``least`` or more, the query itself left out."""
        asked = self._asked(queries)
        near = asked.select("q", "v", F.lit(-2.0).alias("bar"), F.explode("cells").alias("c")).filter(F.col("c.bound") >= least - ROOM).select("q", "v", "bar", "c.cell")
        best = reranked(self._compared(near, None, least), asked, self.rows, lambda scored: scored.filter(F.col("score") >= least))
        return best.select(F.col("q").alias("query"), F.col("k").alias(self.key), "score")


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the true neighbours that were found."""
    both = truth.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    return both.agg(F.count_distinct("query").alias("queries"), F.round(F.count("hit") / F.count("*"), DIGITS).alias("recall"))
