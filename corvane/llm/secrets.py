"""Secret scans: whole credentials by pattern, and weak parts that count only when their complements stand near."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, settle, skew_join, spread

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
IDENT = r"""(?i:client_?id|key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
#: kind -> (pattern, group whose length counts, least length, quick test of a text). Assignments are matched before
#: short values go, as a short match may cover what would match by itself. The order breaks ties of equal starts.
#: A scheme has 16 characters at most (of a longer run its end), so no pattern looks far ahead from every character of
#: a long run without spaces.
KINDS = {
    "assign": (ASSIGN, 2, 6, ASSIGN[:-2] + "{6,})"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    "ident": (IDENT, 0, 5, IDENT),
    "blob": (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20, r"[A-Za-z0-9+/_-]{20}"),
    "endpoint": (r"[a-z][a-z0-9+.-]{0,15}://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/_.-]*", 0, 10, "://"),
}
#: Words of which a text must hold one, in lower case, before the patterns of a kind are tried on it.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "ident": ("client", "key", "user", "login", "account"), "endpoint": ("://",)}
BASE = ["assign", "access", "hex"]
WEAK = ["ident", "blob", "endpoint"]
#: What a kind is to a credential: its identifier, its secret or the place where it is used.
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "blob": "secret", "endpoint": "endpoint"}
#: The scope: code points between the parts of one credential, within one document.
REACH = 256
_SPAN = "array<struct<start:long,kind:int,end:long>>"
_CHUNK = 256


def _pieces(docs: DataFrame, kind: str) -> DataFrame:
    """docs (t, low, ...) with z_<kind>: per match the length of the gap before it, its length, and the length that counts."""
    pattern, group, _, quick = KINDS[kind]
    hinted = reduce(Column.__or__, (F.contains("low", F.lit(h)) for h in HINTS.get(kind, ())), F.lit(kind not in HINTS))
    hit = hinted & F.col("t").rlike(quick)
    m, g, p = f"m_{kind}", f"g_{kind}", f"p_{kind}"
    cut = docs.withColumns(
        {
            m: F.when(hit, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))),
            g: F.when(hit, F.split("t", pattern)),
            p: F.when(hit, F.regexp_extract_all("t", F.lit(pattern), F.lit(group))),
        }
    )
    mixed = lambda x: F.length(x) if kind != "blob" else F.when(x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]"), F.length(x)).otherwise(F.lit(-1))
    zipped = F.transform(
        F.arrays_zip(m, g, p),
        lambda x: F.struct(
            F.length(x[g]).cast("long").alias("gap"),
            F.coalesce(F.length(x[m]), F.lit(0)).cast("long").alias("size"),
            F.coalesce(mixed(x[p]), F.lit(-1)).alias("part"),
        ),
    )
    return cut.withColumn(f"z_{kind}", zipped).drop(m, g, p)


def _placed(docs: DataFrame, kind: str) -> DataFrame:
    """z_<kind> -> s_<kind>: the spans, by running sums in two steps, so that a text of many matches stays cheap."""
    least, rank = KINDS[kind][2], list(KINDS).index(kind)
    z = f"z_{kind}"
    chunks = F.when(
        F.size(z) > 0,
        F.transform(F.sequence(F.lit(0), F.expr(f"(size({z}) - 1) div {_CHUNK}").cast("int")), lambda k: F.slice(z, k * _CHUNK + 1, _CHUNK)),
    )
    split = docs.withColumn("c", chunks)
    long0 = F.lit(0).cast("long")
    total = lambda ch: F.aggregate(ch, long0, lambda s, x: s + x.gap + x.size)
    offsets = F.aggregate(
        F.transform("c", total),
        F.struct(long0.alias("at"), F.array().cast("array<long>").alias("o")),
        lambda a, n: F.struct((a.at + n).alias("at"), F.concat(a.o, F.array(a.at)).alias("o")),
        lambda a: a.o,
    )
    split = split.withColumn("o", offsets)

    def place(pair: Column) -> Column:
        return F.aggregate(
            pair.c,
            F.struct(pair.o.alias("at"), F.array().cast(_SPAN).alias("s")),
            lambda a, x: F.struct(
                (a.at + x.gap + x.size).alias("at"),
                F.when(
                    x.part >= least,
                    F.concat(a.s, F.array(F.struct((a.at + x.gap).alias("start"), F.lit(rank).alias("kind"), (a.at + x.gap + x.size).alias("end")))),
                )
                .otherwise(a.s)
                .alias("s"),
            ),
            lambda a: a.s,
        )

    spans = F.flatten(F.transform(F.arrays_zip("c", "o"), place))
    return split.withColumn(f"s_{kind}", F.coalesce(spans, F.array().cast(_SPAN))).drop(z, "c", "o")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start, x.end)), ",")


def linked(rows: DataFrame) -> DataFrame:
    """rows (uid, base, weak) -> (uid, extra): the weak spans whose complements stand within REACH in the same text.

    An interval join on equal (text, bucket of REACH code points). Spans have least lengths and spans of a kind do
    not overlap, so a bucket holds a bounded number of them however many the text has; copies of a text are one text.
    An identifier wants a secret, a secret an identifier, an endpoint both; parts that overlap are not complements,
    and a weak span over a base span is the base span's business.
    """
    texts = rows.groupBy("uid").agg(F.first("base").alias("base"), F.first("weak").alias("weak"))
    parts = texts.select("uid", F.explode(F.concat("base", "weak")).alias("x"))
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("x.kind") + 1)

    def over(a: Column, b: Column) -> Column:
        bucket = lambda v: F.floor(v / F.lit(REACH)).cast("long")
        return F.explode(F.sequence(bucket(a), bucket(b)))

    right = parts.select("uid", over(F.col("x.start") - REACH, F.col("x.end") + REACH).alias("b"), F.col("x.start").alias("ps"), F.col("x.end").alias("pe"), F.col("x.kind").alias("pk"), role.alias("role"))
    left = texts.select("uid", F.explode("weak").alias("x")).select("uid", "x", over(F.col("x.start"), F.col("x.end")).alias("b"))
    near = left.join(right, ["uid", "b"]).filter((F.col("ps") - REACH <= F.col("x.end")) & (F.col("x.start") <= F.col("pe") + REACH))
    apart = (F.col("pe") <= F.col("x.start")) | (F.col("x.end") <= F.col("ps"))
    has = {r: F.max(apart & (F.col("role") == r)).alias(r) for r in ("ident", "secret")}
    hidden = F.max(~apart & (F.col("pk") < len(BASE))).alias("hidden")
    kind = F.col("x.kind")
    rank = {k: i for i, k in enumerate(KINDS)}
    right_parts = (
        F.when(kind == rank["ident"], F.col("secret")).when(kind == rank["blob"], F.col("ident")).otherwise(F.col("secret") & F.col("ident"))
    )
    seen = near.groupBy("uid", "x").agg(*has.values(), hidden).filter(right_parts & ~F.col("hidden"))
    return seen.groupBy("uid").agg(F.collect_list("x").alias("extra"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and extra (arrays of start, kind, end in code points), base_list and all_list.

    A null text is an empty one and has no spans. Whole texts are searched. Equal texts get equal spans, found once
    for the weak kinds; repeated rows and null ids stay. An empty table gives an empty table; other columns are
    ignored. Kinds are numbered in the order of KINDS.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    rows = spread(rows).withColumn("low", F.lower("t"))
    for kind in KINDS:
        rows = _pieces(rows, kind)
    uid = F.md5("t").alias("uid")
    rows = rows.select("doc_id", uid, *(f"z_{k}" for k in KINDS))
    for kind in KINDS:
        rows = _placed(rows, kind)
    base, weak = F.concat(*(f"s_{k}" for k in BASE)), F.concat(*(f"s_{k}" for k in WEAK))
    rows = rows.select("doc_id", "uid", F.sort_array(base).alias("base"), F.sort_array(weak).alias("weak"))
    alone = (F.size("weak") == 0) | (F.size("weak") + F.size("base") < 2)
    rows = settle(rows.withColumn("alone", alone))
    none = F.array().cast(_SPAN)
    bare = rows.filter("alone").select("doc_id", "base", none.alias("extra"))  # no part to link: neither shuffled nor joined
    held = rows.filter("not alone").select("uid", "doc_id", "base", "weak")
    some = skew_join(held.select("uid", "doc_id", "base"), linked(held), "uid")  # many copies of one text are a hot key
    out = bare.unionByName(some.select("doc_id", "base", F.coalesce("extra", none).alias("extra")))
    return out.select("doc_id", "base", "extra", listed(F.col("base")).alias("base_list"), listed(F.concat("base", "extra")).alias("all_list"))
