"""Line diffs by anchors: lines that stand once on either side hold a pair of texts together, and the gaps between go on."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .lineage import settle


def _gap() -> WindowSpec:
    return W.partitionBy("k", "g")


def _lines(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """k, side (0 before, 1 after), p (from 0), v: a number for each different line of a pair; all in one gap."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.split(F.col(c), "\n").alias("lines")) for i, c in enumerate((before, after))))
    rows = pairs.select(F.col(key).alias("k"), F.explode(sides).alias("x")).select("k", "x.side", F.posexplode("x.lines").alias("p", "line"))
    return rows.select("k", "side", F.col("p").cast("long").alias("p"), F.dense_rank().over(W.partitionBy("k").orderBy("line")).alias("v"), F.lit(-1).cast("long").alias("g"))


def _both_sided(rows: DataFrame) -> DataFrame:
    """The rows of gaps with lines on both sides."""
    return rows.withColumn("sides", F.max("side").over(_gap()) - F.min("side").over(_gap())).filter("sides = 1").drop("sides")


def _equal_run(rows: DataFrame, place: str, name: str) -> DataFrame:
    """rows with the number of places from the first on, at which both sides of the gap have the same line."""
    here = W.partitionBy("k", "g", place)
    same = (F.count("*").over(here) == 2) & (F.min("v").over(here) == F.max("v").over(here))
    rows = rows.withColumn("same", same)
    end = F.min(F.when(~F.col("same"), F.col(place))).over(_gap()) - 1
    return rows.withColumn(name, F.coalesce(end, F.max(place).over(_gap()))).drop("same")


def _heaviest(runs: Column) -> Column:
    """Of runs (run, b, n) in the order of a side, those of the heaviest chain that rises in b; ties to the smaller b."""

    @F.pandas_udf("array<int>")
    def chain(lists: pd.Series) -> pd.Series:
        def one(rows):
            places, back = sorted(r["b"] for r in rows), []
            best = [(0, 0, -1)] * (len(places) + 1)  # a tree of prefix maxima of (weight, -b, index)

            def top(j):
                found = best[0]
                while j > 0:
                    found, j = max(found, best[j]), j & (j - 1)
                return found

            for at, r in enumerate(rows):
                j = bisect_left(places, r["b"])
                weight, _, before = top(j)
                back.append(before)
                j += 1
                while j < len(best):
                    best[j] = max(best[j], (weight + r["n"], -r["b"], at))
                    j += j & -j
            out, at = [], top(len(places))[2]
            while at >= 0:
                out.append(rows[at]["run"])
                at = back[at]
            return out

        return lists.map(one)

    return chain(runs)


def _chains(single: DataFrame) -> DataFrame:
    """Of (k, g, a, b), those that a longest chain rising in both takes.

    What is adjacent in both orders is taken whole or not at all, as any other anchor stands to all of it alike. So
    windows make runs, most gaps have one, and only the runs of the others are looked at in Python.
    """
    order = _gap().orderBy("a")
    rows = single.withColumn("rb", F.row_number().over(_gap().orderBy("b")))
    starts = F.coalesce(F.col("rb") - F.lag("rb").over(order) != 1, F.lit(True)).cast("int")
    rows = rows.withColumn("start", starts).withColumn("run", F.sum("start").over(order).cast("int"))
    runs = rows.groupBy("k", "g", "run").agg(F.min("rb").alias("b"), F.count("*").alias("n"))
    listed = runs.groupBy("k", "g").agg(F.sort_array(F.collect_list(F.struct("run", "b", "n"))).alias("runs"))
    one, more = listed.filter(F.size("runs") == 1), listed.filter(F.size("runs") > 1)
    taken = one.select("k", "g", F.lit(1).alias("run")).unionByName(more.select("k", "g", F.explode(_heaviest(F.col("runs"))).alias("run")))
    return rows.join(taken, ["k", "g", "run"]).select("k", "a", F.col("b").alias("taken"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows of both-sided gaps with m, the place of the same line on the other side, and anchor, where that is a new anchor."""
    side = W.partitionBy("k", "g", "side")
    rows = rows.withColumn("i", F.row_number().over(side.orderBy("p"))).withColumn("n", F.count("*").over(side))
    rows = _equal_run(rows.withColumn("j", F.col("n") - F.col("i") + 1), "i", "head")
    rows = _equal_run(rows, "j", "tail").withColumn("tail", F.least(F.col("tail"), F.min("n").over(_gap()) - F.col("head")))
    other = lambda c, f: F.when(F.col("side") == 0, f(F.when(F.col("side") == 1, c)).over(_gap())).otherwise(f(F.when(F.col("side") == 0, c)).over(_gap()))
    m = F.when(F.col("i") <= F.col("head"), other(F.col("p"), F.min) + F.col("i") - 1).when(F.col("j") <= F.col("tail"), other(F.col("p"), F.max) - F.col("j") + 1)
    rows = rows.withColumn("m", m).withColumn("rest", F.col("m").isNull())
    line = W.partitionBy("k", "g", "v", "rest")
    once = F.col("rest") & (F.count("*").over(line) == 2) & (F.min("side").over(line) == 0) & (F.max("side").over(line) == 1)
    rows = rows.withColumn("once", once)
    rows = rows.withColumn("a", F.when(F.col("once"), F.min(F.when(F.col("side") == 0, F.col("p"))).over(line)))
    rows = rows.withColumn("b", F.when(F.col("once"), F.min(F.when(F.col("side") == 1, F.col("p"))).over(line)))
    rows = rows.select("k", "side", "p", "v", "g", "m", "a", "b")
    chosen = _chains(rows.filter("side = 0 and a is not null").select("k", "g", "a", "b"))
    rows = rows.join(chosen, ["k", "a"], "left").withColumn("anchor", F.col("taken").isNotNull())
    met = F.when(F.col("anchor"), F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))).otherwise(F.col("m"))
    return rows.select("k", "side", "p", "v", "g", met.alias("m"), "anchor")


def _narrowed(marked: DataFrame) -> DataFrame:
    """The lines that are left, in the gaps between what has been matched; gaps that gave no anchor are done with.

    A gap is named by the place, before, of the match that it follows: the same name on both sides.
    """
    rows = marked.withColumn("on", F.max("anchor").over(_gap())).filter("on")
    x = F.when(F.col("m").isNotNull(), F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("m")))
    last = F.last(x, ignorenulls=True).over(W.partitionBy("k", "g", "side").orderBy("p").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("g", F.coalesce(last, F.col("g"))).filter("m is null")
    return _both_sided(rows.select("k", "side", "p", "v", "g"))


def matched(pairs: DataFrame, key: str, before: str, after: str, rounds: int = 10_000) -> DataFrame:
    """key, a, b: the lines, from 0, that a patience diff of before and after keeps.

    Lines are what stands between line ends; a null text has none. Of a gap, at first the whole texts, the lines that
    both sides start and end with are kept, then a longest chain of the lines that stand once on either side, and so
    on between these; a gap without such lines is a change. Costs grow with lines times their logarithm and the depth of the
    gaps. All rows of a pair meet in one task, as its texts met in one row. Keys are unique. Not ending in ``rounds`` is an error.
    """
    rows, out = settle(_both_sided(_lines(pairs, key, before, after))), None
    for _ in range(rounds):
        marked = settle(_marked(rows))
        new = marked.filter("side = 0 and m is not null").select(F.col("k").alias(key), F.col("p").alias("a"), F.col("m").alias("b"))
        out = new if out is None else out.unionByName(new)
        rows = _narrowed(marked)
        if marked.filter("anchor").isEmpty():
            return out
    raise RuntimeError(f"gaps are deeper than {rounds}")


def _length(text: str) -> Column:
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text), "\n"))).cast("long")


def hunks(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, a_from, a_lines, b_from, b_lines: what lies between kept lines that do not follow each other; lines from 0."""
    ends = pairs.select(key, _length(before).alias("a"), _length(after).alias("b"))
    rows = matched(pairs.select(key, before, after), key, before, after).unionByName(ends)
    w = W.partitionBy(key).orderBy("a", "b")
    since = lambda c: F.coalesce(F.lag(c).over(w) + 1, F.lit(0).cast("long"))
    rows = rows.select(key, since("a").alias("a_from"), since("b").alias("b_from"), "a", "b")
    found = rows.select(key, "a_from", (F.col("a") - F.col("a_from")).alias("a_lines"), "b_from", (F.col("b") - F.col("b_from")).alias("b_lines"))
    return found.filter("a_lines > 0 or b_lines > 0")


def totals(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, hunks, insertions, deletions of every pair, zeros where nothing changed."""
    found = hunks(pairs, key, before, after).groupBy(key).agg(F.count("*").alias("hunks"), F.sum("b_lines").alias("insertions"), F.sum("a_lines").alias("deletions"))
    return pairs.select(key).join(found, key, "left").na.fill(0, ["hunks", "insertions", "deletions"])
