"""Joins by time: the latest row of a key at or before a moment, and moments within spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settle

#: Seconds of the smallest cells of time that spans are cut into; the next ones are four times as long, and so on.
UNIT = 60


def as_of(left: DataFrame, right: DataFrame, by: list[tuple[str, str]], at: str, since: str, values: list[str], tolerance_s: float | None = None, tie: str | None = None) -> DataFrame:
    """left with ``values`` and ``since`` of the latest right row of its key at or before ``at``; null where there is none.

    ``by`` pairs columns of both sides; null keys and times meet nothing. Of right rows of one key and time the
    greatest by ``tie`` counts. A right row more than ``tolerance_s`` seconds earlier is none. Left rows stay as
    often as they are there.

    Both sides are dealt out together by ranges of key and time, so a key, day or moment with any share of the rows is
    many partitions. Within one a running last value answers; what a partition is missing is the last right row of
    the ones before, and those are one row a partition.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    order = [*keys, "__t", "__side", "__tie"]
    seen = F.struct(F.col(since), *(F.col(c) for c in values if c != since))
    tied = F.col(tie) if tie else F.lit(0)
    r_rows = right.select(*(F.col(r).alias(k) for k, (_, r) in zip(keys, by, strict=True)), F.col(since).cast("timestamp").alias("__t"), F.lit(0).alias("__side"), tied.alias("__tie"), seen.alias("__r"))
    r_rows = r_rows.dropna(subset=[*keys, "__t"])
    kinds = {c: r_rows.schema[c].dataType for c in (*keys, "__tie", "__r")}
    l_rows = left.select(*(F.col(c).cast(kinds[k]).alias(k) for k, (c, _) in zip(keys, by, strict=True)), F.col(at).cast("timestamp").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kinds["__tie"]).alias("__tie"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__l"))
    both = r_rows.withColumn("__l", F.lit(None).cast(l_rows.schema["__l"].dataType)).unionByName(l_rows.withColumn("__r", F.lit(None).cast(kinds["__r"])))
    dealt = settle(both.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    run = W.partitionBy("__p", *keys).orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = dealt.withColumn("__own", F.last("__r", ignorenulls=True).over(run)).filter("__side = 1")
    rank = F.when(F.col("__side") == 0, F.struct(*order))  # left rows have none, and max_by() passes over them
    tails = dealt.groupBy("__p").agg(F.max_by(F.struct(F.struct(*keys).alias("k"), F.col("__r").alias("r")), rank).alias("__tail"))
    before = F.last("__tail", ignorenulls=True).over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))  # a row a partition
    carried = tails.select("__p", before.alias("__before"))
    same = F.col("__before.k") == F.struct(*keys)
    found = F.coalesce("__own", F.when(same, F.col("__before.r")))
    out = own.join(F.broadcast(carried), "__p").withColumn("__found", found)
    if tolerance_s is not None:
        early = F.unix_micros(F.col("__t")) - F.unix_micros(F.col(f"__found.`{since}`").cast("timestamp")) > int(tolerance_s * 1_000_000)
        out = out.withColumn("__found", F.when(~early, F.col("__found")))
    return out.select("__l.*", *(F.col(f"__found.`{c}`").alias(c) for c in dict.fromkeys((since, *values))))


def in_spans(points: DataFrame, spans: DataFrame, by: tuple[str, str], at: str, began: str, ended: str) -> DataFrame:
    """points with the columns of each span of their key that holds their time, both ends included.

    Spans are cut into cells of the least length of which few cover them, so a span is two or three rows whatever its
    length; a point has a row for each length that occurs, at most one for each power of four of UNIT.
    """
    unit = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(UNIT * 1_000_000)).cast("long")
    cut = spans.filter(F.col(began) <= F.col(ended)).withColumns({"__b": unit(began), "__e": unit(ended)})
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("__e") - F.col("__b") + 1).cast("double")) / 2)).cast("int")
    cut = cut.withColumn("__level", level)
    size = F.expr("shiftleft(1L, 2 * __level)")
    cells = F.sequence(F.floor(F.col("__b") / size), F.floor(F.col("__e") / size))
    cut = cut.withColumn("__cell", F.explode(cells)).drop("__b", "__e")
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most thirty or so
    own = F.array(*(F.struct(F.lit(n).alias("__level"), F.floor(unit(at) / F.lit(4**n)).alias("__cell")) for n in levels)) if levels else F.array().cast("array<struct<__level: int, __cell: bigint>>")
    placed = points.withColumn("__x", F.explode(own)).select(*(F.col(f"`{c}`") for c in points.columns), "__x.*")
    met = placed.join(cut.withColumnRenamed(by[1], "__key"), (placed[by[0]] == F.col("__key")) & (placed["__level"] == cut["__level"]) & (placed["__cell"] == cut["__cell"]) & (F.col(at) >= F.col(began)) & (F.col(at) <= F.col(ended)))
    return met.select(*(placed[c] for c in points.columns), *(F.col(c) for c in spans.columns if c != by[1]))
