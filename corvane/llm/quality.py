"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, col, settle, spread, words

#: Words of a repeated window, fewest words of a document, most repeated words in a hundred.
SPAN, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: A (language, source) of fewer documents takes the merged sketch of its language, and that of all if it is as small.
ENOUGH = 50
#: The fence of a measure lies this many interquartile ranges above the upper quartile, and its slack beyond that.
REACH = 4
#: Measures, in thousandths (word length in hundredths), with their slack. Only word length has a fence below. The slack
#: of repeated words is well below the 300 that the base rule leaves, so the fence of a source can reject.
SLACK = {"symbol_rate": 50, "dup_line_rate": 200, "repeat_rate": 200, "word_length": 400}
#: With fewer lines, one repeated line says nothing of a rate.
FEWEST_LINES = 8
#: Bits of a value that the sketch keeps: an error under 1 in 128.
KEPT_BITS = 8


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document with doc_id, lang, source, n_words, the counts and the measures; map only, built-in functions only.

    Repeated windows are found on 64-bit hashes. Only a text in which some hash returns has them sorted.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    base = docs.select(col(id_col).alias("doc_id"), col(lang_col).alias("lang"), col(source_col).alias("source"), col(text_col).alias("t"))
    base = spread(base)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    a = base.select("doc_id", "lang", "source", words(F.col("t")).alias("w"), lines.alias("l"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    hashed = F.when(F.size("w") >= SPAN, F.transform(F.sequence(F.lit(1), F.size("w") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("w", i, SPAN))))
    b = a.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        hashed.alias("h"),
    )
    again = F.size(F.array_distinct("h")) < F.size("h")
    c = b.withColumn("s", F.when(again, F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def returns(x: Column, i: Column) -> Column:
        def same(k: Column) -> Column:
            return F.coalesce(F.try_element_at("s", k).h == x.h, F.lit(False))

        return ((i > 0) & same(F.greatest(i, F.lit(1)))) | same(i + 2)

    d = c.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", returns), lambda x: x.i))))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-SPAN).alias("last")),
        lambda s, p: F.struct((s.n + F.least(F.lit(SPAN), p - s.last)).alias("n"), p.alias("last")),
        lambda s: s.n,
    )
    e = d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))

    def rate(part: str, whole: str, times: int = 1000) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{times} * {part} div {whole}")).otherwise(F.lit(0)).cast("long")

    return e.select(
        "*",
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        F.when(F.col("n_lines") >= FEWEST_LINES, rate("n_dup_lines", "n_lines")).otherwise(F.lit(0)).cast("long").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("word_chars", "n_words", 100).alias("word_length"),
    )


def bin_of(value: Column) -> Column:
    """The value with all but its leading KEPT_BITS bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - KEPT_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), low).cast("long")
    return value - value % unit


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches as counted bins (lang, source, measure, bin, n). Two merge by adding their counts."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in SLACK))
    dealt = measured.filter("not base_failed").select("lang", "source", F.explode(pairs).alias("x"))
    return dealt.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q1 and q3 of each key and measure, wide; docs: documents behind them."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    at = {q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))) for q in (1, 3)}
    long = ranked.groupBy(*keys, "measure").agg(at[1].alias("q1"), at[3].alias("q3"), F.max("all").alias("docs"))
    wide = [F.max(F.when(F.col("measure") == m, F.struct("q1", "q3"))).alias(m) for m in SLACK]
    return long.groupBy(*keys).agg(F.max("docs").alias("docs"), *wide)


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source) -> low_<measure> and high_<measure>, from the finest sketch of ENOUGH documents."""
    fine = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("docs").alias("lang_docs"), *(F.col(m).alias(f"lang_{m}") for m in SLACK))
    every = _quartiles(sketch.withColumn("one", F.lit(1)), ["one"]).select(*(F.col(m).alias(f"all_{m}") for m in SLACK))
    joined = fine.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(every))  # one row
    out = []
    for m, slack in SLACK.items():
        q = F.when(F.col("docs") >= ENOUGH, F.col(m)).when(F.col("lang_docs") >= ENOUGH, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
        reach = REACH * (q.q3 - q.q1) + slack
        out += [(q.q3 + reach).alias(f"high_{m}"), (q.q1 - reach if m == "word_length" else F.lit(0)).cast("long").alias(f"low_{m}")]
    return joined.select("lang", "source", *out)


def judged(docs: DataFrame, **cols: str) -> DataFrame:
    """One row per document: doc_id, lang, source, the counts, the measures, base_failed and kept.

    Documents that fail the base rules neither shape a threshold nor pass. The others are kept while every measure
    lies within the fences of their language and source. Null languages and sources are groups like any other. Null
    and blank texts have no words and fail. Repeated rows are judged one by one; a null id is kept as null. With an
    empty table, or when nothing passes the base rules, there are no thresholds and nothing more is kept.
    """
    m = measures(docs, **cols)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    m = settle(m.withColumn("base_failed", failed))
    limits = thresholds(sketches(m)).withColumnRenamed("lang", "tl").withColumnRenamed("source", "ts")
    inside = F.lit(True)
    for name in SLACK:
        inside = inside & F.col(name).between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    on = F.col("lang").eqNullSafe(F.col("tl")) & F.col("source").eqNullSafe(F.col("ts"))
    joined = m.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return joined.select(*m.columns, "kept")
