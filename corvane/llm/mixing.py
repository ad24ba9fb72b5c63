"""Mixing sources to target weights: a min-cost flow over membership patterns, then a seeded choice of documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, n_words, settle

#: No document is taken more often than this.
REPEATS = 3
#: Membership patterns whose flow the driver holds (about 1 KB each); more are refused rather than simplified.
MOST_PATTERNS = 1_000_000
#: Patterns whose plan, a row of a few hundred bytes each, is sent to every task; more are joined by a shuffle.
SENT_PATTERNS = 5_000
SEED = "mix-1"
#: Leading hex digits of the seeded order by which the cut of a pattern is found before any rows are sorted.
CUT_DIGITS = 3


def targets(sizes: dict[str | None, int], weights: dict[str | None, float] | None = None, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words asked of each source: a share of all sizes by weight, at most ``repeats`` times its own size.

    Sources by code point, null last, weigh 1, 2, 3, repeating, unless given. What the limit cuts off is shared anew
    by weight among the others until none is above its limit.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = weights or {s: i % 3 + 1 for i, s in enumerate(order)}
    out, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > repeats * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / total for s in free}
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def flow(groups: Sequence[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words to take from each pattern: the largest flow into the quotas, at the least cost.

    A pattern of n words offers n at each repetition 1, 2, ..., at costs 0, 1, 3, 6, ... a word, so the flow evens
    repetition out before it repeats anything more often. A path that adds to the flow starts with one offer and goes
    on at no cost, moving words of patterns from one of their sources to another. Its cost is that of its offer, so
    the cheapest paths are found repetition by repetition: within one, words go where a quota is open, and what is
    left follows shortest paths between sources until none leads to an open quota. Paths join sources, of which there
    are few, so a step costs the patterns it touches and not a search of all of them.
    """
    known: dict[tuple, int] = {}
    for pattern, size in groups:
        if size and any(s in quotas for s in pattern):
            known[pattern] = known.get(pattern, 0) + size
    members = {p: [s for s in dict.fromkeys(p) if s in quotas] for p in known}
    open_ = {s: int(round(q)) for s, q in quotas.items()}
    given: dict[tuple, dict] = {p: {} for p in known}  # pattern -> source -> words
    # movable[a][b]: patterns that give words to a and are members of b too; entries may be stale and go when met
    movable: dict = {s: {} for s in quotas}

    def put(p: tuple, s, n: int) -> None:
        given[p][s] = given[p].get(s, 0) + n
        if given[p][s] == n:
            for t in members[p]:
                if t != s:
                    movable[s].setdefault(t, {})[p] = None

    def first(a, b) -> tuple | None:
        held = movable[a].get(b, {})
        while held:
            p = next(iter(held))
            if given[p].get(a, 0) > 0:
                return p
            del held[p]
        return None

    def routes() -> dict:
        """From each source that leads to an open quota, the next source on a shortest way there; itself at its end."""
        into = {s: [] for s in quotas}
        for a in quotas:
            for b in list(movable[a]):
                if first(a, b) is not None:
                    into[b].append(a)
        way = {s: s for s in quotas if open_[s] > 0}
        queue = deque(way)
        while queue:
            b = queue.popleft()
            for a in into[b]:
                if a not in way:
                    way[a] = b
                    queue.append(a)
        return way

    for _ in range(repeats):
        left = dict(known)
        for p in known:  # straight into open quotas
            for s in members[p]:
                n = min(left[p], open_[s])
                if n:
                    put(p, s, n)
                    left[p] -= n
                    open_[s] -= n
        way = routes()
        for p in known:
            while left[p]:
                starts = [s for s in members[p] if s in way]  # a source may be null, so none is told by null
                if not starts:
                    break
                path, a = [], starts[0]
                while way[a] != a:
                    path.append((a, way[a], first(a, way[a])))
                    a = way[a]
                if open_[a] == 0 or any(x[2] is None for x in path):
                    way = routes()
                    continue
                n = min([left[p], open_[a], *(given[q][x] for x, _, q in path)])
                for x, y, q in path:
                    given[q][x] -= n
                    put(q, y, n)
                put(p, starts[0], n)
                left[p] -= n
                open_[a] -= n
    return {p: sum(x.values()) for p, x in given.items()}


def _measured(docs: DataFrame, members: Column, id_col: str, text_col: str, seed: str, carry: dict[str, Column]) -> DataFrame:
    """docs as doc_id, size, members (distinct, by code point, null last), __o (the seeded order) and the carried columns."""
    both_null, a_null = lambda a, b: a.isNull() & b.isNull(), lambda a: a.isNull()
    by = lambda a, b: F.when(both_null(a, b), 0).when(a_null(a), 1).when(a_null(b), -1).when(a < b, -1).when(a > b, 1).otherwise(0)
    unique = F.coalesce(F.array_sort(F.array_distinct(members), by), F.array().cast("array<string>"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(col(id_col).cast("string"), F.lit(""))))
    return docs.select(col(id_col).alias("doc_id"), n_words(col(text_col)).alias("size"), unique.alias("members"), order.alias("__o"), *(c.alias(n) for n, c in carry.items()))


class Mix:
    """The plan of a mix: which documents are taken how often, as a small table by membership pattern.

    ``members`` is the array of sources of a document; a null source is a source of its own and comes last. A
    document of several sources adds its size to each of them. Every pattern gives what the flow asks: whole rounds
    of all its documents, then documents in a seeded order, each that still fits, then the one document that comes
    nearest to what is still open. A document that does not fit is set aside, and with it all that are larger than
    what is open.
    A cut is found from sums by leading digits of that order, so only the documents of one 4096th of a pattern are
    ever sorted, and a hot source costs no single task. A row of the plan holds the stretches of the order that are
    in, so it applies to the texts themselves without a shuffle.

    Null and blank texts have size 0 and are never taken, nor are documents without members. Rows with one id and
    size are in or out together. Empty tables give empty results. Reruns agree, whatever the partitioning: the order
    hangs on the seed and the id alone.
    """

    def __init__(self, docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: dict[str | None, float] | None = None, repeats: int = REPEATS, seed: str = SEED, most_patterns: int = MOST_PATTERNS):
        spark = docs.sparkSession
        self._how = (members, id_col, text_col, seed)
        self.rows = settle(_measured(docs, *self._how, {}))
        groups = settle(self.rows.groupBy("members").agg(F.sum("size").alias("n")))
        if groups.limit(most_patterns + 1).count() > most_patterns:
            raise ValueError(f"more than {most_patterns} membership patterns: merge sources that always go together")
        known = [(tuple(r["members"]), int(r["n"])) for r in groups.toLocalIterator()]
        self._few = F.broadcast if len(known) <= SENT_PATTERNS else lambda x: x
        self.sizes: dict[str | None, int] = {}
        for pattern, n in known:
            for s in pattern:
                self.sizes[s] = self.sizes.get(s, 0) + n
        self.targets = targets(self.sizes, weights, repeats)
        taken = flow(sorted(known, key=lambda g: [(s is None, s or "") for s in g[0]]), self.targets, repeats)
        asked = spark.createDataFrame(
            [(list(p), n and taken.get(p, 0) // n, n and taken.get(p, 0) % n) for p, n in known], "members array<string>, full long, rest long"
        )
        self.plan = settle(self._filled(asked))

    def _filled(self, asked: DataFrame) -> DataFrame:
        """asked with stretches, which _stretched() reads, and (last_o, last_size), the document taken besides.

        Each round starts at the next document that fits the gap. From there all that are no larger than the gap are
        in, up to the first that it no longer holds. The gap only shrinks, so what was set aside stays so. Rows with
        one id and size count as one document; the rounds go on until none fits.
        """
        docs = self.rows.filter("size > 0").groupBy("members", "__o", "size").agg((F.count("*") * F.col("size")).alias("words"))
        docs = settle(docs.withColumn("__b", F.substring("__o", 1, CUT_DIGITS)))
        none = F.array().cast("array<struct<from_o:string,from_size:long,upto_o:string,upto_size:long,most:long>>")
        state = settle(asked.filter("rest > 0").select("members", F.col("rest").alias("gap"), F.lit("").alias("o"), F.lit(0).cast("long").alias("n"), none.alias("stretches")))
        left, here = docs, F.struct("__o", "size")
        while True:
            on = self._few(state.filter("gap > 0 and o is not null").select("members", "gap", "o", "n"))
            left = settle(left.select(*docs.columns).join(on, "members").filter("size <= gap and (__o > o or (__o = o and size > n))"))
            start = settle(left.filter("words <= gap").groupBy("members").agg(F.min(here).alias("at")))
            if start.isEmpty():
                break
            ahead = left.join(self._few(start), "members").filter(here >= F.col("at"))
            upto = W.partitionBy("members").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
            sums = ahead.groupBy("members", "gap", "at", "__b").agg(F.sum("words").alias("s")).withColumn("c", F.sum("s").over(upto))
            cut = F.min(F.when(F.col("c") > F.col("gap"), F.struct("__b", (F.col("c") - F.col("s")).alias("before"))))
            ends = sums.groupBy("members", "at").agg(F.max("c").alias("all"), cut.alias("cut"))
            ends = settle(ends.select("members", "at", "all", F.col("cut.__b").alias("__b"), F.col("cut.before").alias("before")))
            run = W.partitionBy("members").orderBy("__o", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
            near = ahead.drop("at").join(self._few(ends.filter("__b is not null").select("members", "__b", "before")), ["members", "__b"])
            near = near.withColumn("c", F.col("before") + F.sum("words").over(run)).filter("c > gap")
            block = near.groupBy("members").agg(F.min(F.struct("__o", "size", (F.col("c") - F.col("words")).alias("c"))).alias("x"))
            moved = state.join(self._few(ends.select("members", "at", "all")), "members", "left").join(self._few(block), "members", "left")
            step = F.struct(F.col("at.__o").alias("from_o"), F.col("at.size").alias("from_size"), F.col("x.__o").alias("upto_o"), F.col("x.size").alias("upto_size"), F.col("gap").alias("most"))
            state = settle(
                moved.select(
                    "members",
                    (F.col("gap") - F.coalesce("x.c", "all", F.lit(0))).alias("gap"),
                    F.col("x.__o").alias("o"),  # null: nothing is left
                    F.col("x.size").alias("n"),
                    F.when(F.col("at").isNull(), F.col("stretches")).otherwise(F.concat("stretches", F.array(step))).alias("stretches"),
                )
            )
        out = docs.join(self._few(state.select("members", "gap", "stretches")), "members").filter("abs(words - gap) < gap").filter(~_stretched())
        best = out.groupBy("members").agg(F.min(F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), "__o", "size")).alias("b"))
        best = best.select("members", F.col("b.__o").alias("last_o"), F.col("b.size").alias("last_size"))
        return asked.drop("rest").join(state.select("members", "stretches"), "members", "left").join(best, "members", "left")

    def _taken(self, rows: DataFrame) -> DataFrame:
        rows = rows.join(self._few(self.plan), "members")
        more = _stretched() | F.coalesce((F.col("__o") == F.col("last_o")) & (F.col("size") == F.col("last_size")), F.lit(False))
        copies = F.when(F.col("size") > 0, F.col("full") + more.cast("long")).otherwise(F.lit(0))
        return rows.withColumn("copies", copies).drop(*(c for c in self.plan.columns if c != "members"))

    def chosen(self) -> DataFrame:
        """One row per document: doc_id, size, members, copies, taken (words, repeats counted)."""
        return self._taken(self.rows).select("doc_id", "size", "members", "copies", (F.col("copies") * F.col("size")).alias("taken"))

    def copies(self, docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
        """The carried columns of docs, each row as often as the mix takes it."""
        rows = self._taken(_measured(docs, *self._how, carry)).filter("copies > 0")
        return rows.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*carry)

    def sources(self, spark: SparkSession) -> DataFrame:
        """source, source_size, target."""
        return spark.createDataFrame([(s, self.sizes[s], self.targets[s]) for s in self.sizes], "source string, source_size long, target double")


def _stretched() -> Column:
    here = F.struct("__o", "size")
    inside = lambda x: (F.col("size") <= x.most) & (here >= F.struct(x.from_o, x.from_size)) & (x.upto_o.isNull() | (here < F.struct(x.upto_o, x.upto_size)))
    return F.coalesce(F.exists("stretches", inside), F.lit(False))
