"""Projection, joins, aggregation, windows, order and sets on the star schema, documents, pages and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import graphs, joins, memory, ranking, rollups, sketches, summaries, timejoins
from ..operators.lineage import fresh_dir, settle
from ..sources import bindings as B
from . import query

T = B.table
#: The Files relation for the SQL side.
FILES = """files AS (SELECT 'doc:///' || lang || '/' || source || '/' || doc_id AS uri, doc_id, lang, source, text FROM documents)"""
#: kind, scheme, authority, path_prefix, uri: known and unknown kinds and schemes, nulls, slashes at either end.
MOUNTS = [
    ("primary", "file", None, None, "file:///"),
    (None, "vocabulary", None, "", "vocabulary:///"),
    ("worktree", "git", "fix-7", "", "git://fix-7"),
    ("import", "git", "team", "api", "git://team/api"),
    ("workspace", "git", "team", "web", "git://team/web"),
    ("import", "disk", "", "/data/shop/", "disk:///data/shop"),
    ("import", "disk", None, "/data/shopping", "disk:///data/shopping"),
    ("mirror", "bucket", "logs", "2024/", "bucket://logs/2024/"),
    (None, "ftp", "old", None, "ftp://old"),
    ("import", "help", None, "", "help:///more"),
]
#: uri, extension, name of memory files; a path that only starts alike is not below.
MEMORY = [
    ("concept:///disk/data/shop/prices/Round.md", ".md", "Round.md"),
    ("concept:///disk/data/shop/Tax.md", ".md", "Tax.md"),
    ("concept:///disk/data/shop/ReadMe.md", ".md", "ReadMe.md"),
    ("concept:///disk/data/shop/notes.txt", ".txt", "notes.txt"),
    ("concept:///disk/data/shopping/Cart.md", ".md", "Cart.md"),
    ("vocabulary:///disk/data/shop/sku", "", "sku"),
    ("vocabulary:///git/team/api/token", "", "token"),
    ("vocabulary:///git/team/api/scope", "", "scope"),
    ("concept:///Own.md", ".md", "Own.md"),
]


def literal(value) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """``name(columns) AS (VALUES ...)`` for the SQL side."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


MOUNT_SQL = values("mounts", "kind, scheme, authority, path_prefix, uri", MOUNTS)
MEMORY_SQL = values("memory_files", "uri, extension, name", MEMORY)
MOUNT_SCHEMA = "kind string, scheme string, authority string, path_prefix string, uri string"


def mounts(spark):
    return spark.createDataFrame(MOUNTS, MOUNT_SCHEMA)


# -- projection and filters -------------------------------------------------------------------------------------------


@query("p01_projection_case", "SELECT p_partkey, p_name AS name, CASE WHEN p_size >= 30 THEN 'large' WHEN p_size >= 10 THEN 'middle' ELSE 'small' END AS size_class, 'part' AS kind FROM part")
def _(spark, d):
    size = F.when(F.col("p_size") >= 30, "large").when(F.col("p_size") >= 10, "middle").otherwise("small")
    return T(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), size.alias("size_class"), F.lit("part").alias("kind"))


@query("p03_predicates", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_totalprice > 1000 AND o_orderpriority LIKE '%-%' AND o_orderkey <> 1")
def _(spark, d):
    o = T(spark, d, "orders")
    want = o.o_orderstatus.isin("F", "O") & ~o.o_orderpriority.isin("5-LOW") & (o.o_totalprice > 1000) & o.o_orderpriority.like("%-%") & (o.o_orderkey != 1)
    return o.filter(want).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("p04_null_handling", f"WITH {MOUNT_SQL} SELECT uri, coalesce(kind, '') AS kind, nullif(authority, '') AS authority, concat_ws('/', scheme, nullif(authority, ''), nullif(trim(path_prefix, '/'), '')) AS memory FROM mounts")
def _(spark, d):
    m = mounts(spark)
    return m.select("uri", F.coalesce("kind", F.lit("")).alias("kind"), F.nullif("authority", F.lit("")).alias("authority"), scalars.memory_path(m.scheme, m.authority, m.path_prefix).alias("memory"))


@query("p12_severity_floor", f"WITH {FILES} SELECT f.uri AS target_uri, CASE WHEN toxic = 1 AND quality = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity FROM labels l JOIN files f USING (doc_id) WHERE toxic = 1")
def _(spark, d):
    return severity_floor(B.annotations(spark, d), "WARNING").select("target_uri", "severity")


def severity_floor(rows, least: str):
    """Rows of the least severity or above, by rank."""
    rank = {s: i for i, s in enumerate(B.SEVERITIES)}
    if least not in rank:
        raise ValueError(f"unknown severity {least!r}; known: {', '.join(B.SEVERITIES)}")
    return rows.filter(F.col("severity").isin([s for s in B.SEVERITIES if rank[s] >= rank[least]]))


@query("p17_valid_targets", f"WITH {FILES} SELECT uri FROM files WHERE text IS NOT NULL AND trim(text, ' \n\t\r') <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    bad = T(spark, d, "labels").filter("toxic = 1").select("doc_id")
    docs = B.documents(spark, d).filter("text is not null and btrim(text, ' \n\t\r') <> ''")
    return docs.join(bad, "doc_id", "left_anti").select("uri")


# -- joins ------------------------------------------------------------------------------------------------------------


@query("j01_equi_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    n, r = T(spark, d, "nation"), T(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


LISTED = f"""WITH {MOUNT_SQL}, {MEMORY_SQL}, m AS (SELECT *, array_to_string(list_filter([scheme, authority, trim(path_prefix, '/')], lambda x: x <> ''), '/') AS path FROM mounts),
l AS (SELECT uri, if(kind = 'workspace', 'workspace', 'import') AS section, if(kind IN ('workspace', 'import'), NULL, kind) AS label,
  (SELECT count(*) FROM memory_files f WHERE starts_with(f.uri, 'concept:///' || path || '/') AND extension = '.md' AND name NOT ILIKE 'readme.md') AS concepts,
  (SELECT count(*) FROM memory_files f WHERE starts_with(f.uri, 'vocabulary:///' || path || '/')) AS words
  FROM m WHERE scheme NOT IN ('file', 'help', 'concept', 'vocabulary', 'worktree') AND kind IS DISTINCT FROM 'primary' AND kind IS DISTINCT FROM 'worktree')"""


def memory_files(spark):
    return spark.createDataFrame(MEMORY, "uri string, extension string, name string")


@query("j02_prefix_or_join", LISTED + " SELECT * FROM l")
def _(spark, d):
    return memory.mount_memory(mounts(spark), memory_files(spark))


LINES_SQL = "array_to_string(list_filter([label, if(concepts > 0, concepts || if(concepts = 1, ' concept', ' concepts'), NULL), if(words > 0, words || if(words = 1, ' vocab word', ' vocab words'), NULL)], lambda x: x IS NOT NULL), ', ')"


@query("m06_memory_counts", LISTED + f", t AS (SELECT section, uri, {LINES_SQL} AS held FROM l) SELECT section, uri || if(held = '', '', ' (' || held || ')') AS line FROM t")
def _(spark, d):
    return memory.memory_lines(memory.mount_memory(mounts(spark), memory_files(spark)))


@query("j03_co_change", "WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS f FROM lineitem) SELECT a.f AS a, b.f AS b, count(*) AS together FROM c a JOIN c b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, d):
    return joins.co_change(B.commit_files(spark, d)).filter("together >= 2")


@query("j04_inline_lookup", "WITH team(seg, team) AS (VALUES ('BUILDING', 'Construction'), ('MACHINERY', 'Industry'), ('AUTOMOBILE', 'Transport')) SELECT team, count(*) AS customers FROM customer JOIN team ON c_mktsegment = seg GROUP BY team")
def _(spark, d):
    team = spark.createDataFrame([("BUILDING", "Construction"), ("MACHINERY", "Industry"), ("AUTOMOBILE", "Transport")], "seg string, team string")
    c = T(spark, d, "customer")
    return c.join(F.broadcast(team), c.c_mktsegment == team.seg).groupBy("team").agg(F.count("*").alias("customers"))  # three rows of text


@query("j05_lateral_function", f"WITH {FILES}, l AS (SELECT uri, unnest(string_split(text, chr(10))) AS line FROM files) SELECT uri, count(*) AS lines, max(length(line))::BIGINT AS longest FROM l GROUP BY uri")
def _(spark, d):
    B.documents(spark, d).createOrReplaceTempView("corvane_j05")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION corvane_lines(t STRING) RETURNS TABLE(line STRING) RETURN SELECT explode(split(t, '\\n'))")
    return spark.sql("SELECT uri, count(*) AS lines, cast(max(length(line)) AS BIGINT) AS longest FROM corvane_j05, LATERAL corvane_lines(text) GROUP BY uri")


@query("j06_redundant_alias", "WITH alias(alias) AS (VALUES ('the'), ('nowhere-to-be-found'), ('que'), ('zzqq')) SELECT alias, EXISTS (SELECT 1 FROM documents WHERE contains(text, alias)) AS redundant FROM alias")
def _(spark, d):
    return joins.redundant(spark.createDataFrame([("the",), ("nowhere-to-be-found",), ("que",), ("zzqq",)], "alias string"), T(spark, d, "documents"))


@query("j07_suppress_seen", "SELECT DISTINCT a.user_id AS session, a.event_type AS item FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.ts < TIMESTAMP '2024-01-03') AND a.ts >= TIMESTAMP '2024-01-03'")
def _(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("item"), "ts")
    cut = F.lit("2024-01-03").cast("timestamp_ntz")
    return e.filter(e.ts >= cut).select("session", "item").distinct().join(e.filter(e.ts < cut), ["session", "item"], "left_anti")


@query(
    "j10_references",
    """WITH e AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages), u AS (SELECT DISTINCT url FROM pages),
t AS (SELECT DISTINCT list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS tail FROM pages)
SELECT src, CASE WHEN dst IN (SELECT url FROM u) THEN 'resolved' WHEN list_extract(string_split(regexp_replace(dst, '[?#].*$', ''), '/'), -1) IN (SELECT tail FROM t WHERE tail <> '') THEN 'name' ELSE 'unresolved' END AS band, count(*) AS links FROM e GROUP BY 1, 2""",
)
def _(spark, d):
    known = T(spark, d, "pages").select(F.col("url").alias("uri"))
    return joins.references(B.page_edges(spark, d), known).groupBy("src", "band").agg(F.count("*").alias("links"))


@query(
    "j11_traversal",
    """WITH RECURSIVE e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0), r AS (SELECT doc_id AS seed, doc_id AS node, 0 AS depth FROM documents WHERE doc_id IN (150, 151, 199)
UNION ALL SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src) SELECT seed, node, min(depth)::BIGINT AS depth FROM r GROUP BY 1, 2""",
)
def _(spark, d):
    docs = T(spark, d, "documents")
    edges = docs.filter("doc_id > 0").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst"))
    return joins.reachable(edges, docs.filter(F.col("doc_id").isin(150, 151, 199)).select(F.col("doc_id").alias("node")))


#: Links that follow each other on a page, as edges between what they lead to.
FOLLOWS = "l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS n FROM pages), f AS (SELECT DISTINCT a.dst AS src, b.dst AS dst FROM l a JOIN l b ON a.page_id = b.page_id AND b.n = a.n + 1)"


def _follows(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    ends = F.arrays_zip(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))).alias("src"), F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))).alias("dst"))
    return T(spark, d, "pages").select(F.explode(ends).alias("x")).select("x.*").distinct()


@query(
    "j11_components_and_levels",
    f"""WITH RECURSIVE {FOLLOWS}, e AS MATERIALIZED (SELECT * FROM f), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t AS MATERIALIZED (SELECT * FROM r),
c AS MATERIALIZED (SELECT node, least(node, min(a.dst)) AS component FROM v LEFT JOIN (SELECT a.src, a.dst FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src) a ON a.src = node GROUP BY node),
k AS MATERIALIZED (SELECT DISTINCT x.component AS src, y.component AS dst FROM e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst WHERE x.component <> y.component),
p AS (SELECT component, 0 AS level FROM c UNION SELECT k.dst, p.level + 1 FROM p JOIN k ON k.src = p.component)
SELECT node, component, max(level)::BIGINT AS level FROM c JOIN p USING (component) GROUP BY ALL""",
)
def _(spark, d):
    """Every target of a link, with its strongly connected component and the longest way there between components."""
    edges = settle(_follows(spark, d))
    parts = settle(graphs.strongly_connected(edges))
    order = graphs.levels(graphs.condensed(edges, parts), parts)
    return parts.join(order, "component").select("node", "component", "level")


@query("j12_blame_commit", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) SELECT doc_id, line_number::BIGINT AS line_number, o_custkey AS author, o_orderpriority AS message FROM l JOIN orders ON o_orderkey = doc_id + line_number")
def _(spark, d):
    lines = B.lines(T(spark, d, "documents"), "doc_id").withColumn("hash", F.col("doc_id") + F.col("line_number"))
    return lines.join(B.commits(spark, d), "hash").select("doc_id", "line_number", "author", "message")


@query("j13_coverage_join", f"WITH {FILES} SELECT uri, CASE WHEN quality = 1 THEN 'covered' WHEN quality = 0 THEN 'uncovered' ELSE 'unmeasured' END AS mark FROM files LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    return B.coverage(spark, d).select("uri", "mark")


@query("j14_cross_source_comparison", "SELECT lang, count(*) FILTER (WHERE source = 'src0') AS ours, count(*) FILTER (WHERE source <> 'src0') AS theirs FROM documents GROUP BY lang")
def _(spark, d):
    ours = F.col("source") == "src0"
    return T(spark, d, "documents").groupBy("lang").agg(F.count_if(ours).alias("ours"), F.count_if(~ours).alias("theirs"))


@query("x_asof_join", "SELECT o.o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN (SELECT min(event_id) AS event_id, ts FROM events GROUP BY ts) e ON o.o_orderdate >= e.ts")
def _(spark, d):
    return as_of(T(spark, d, "orders").select("o_orderkey", "o_orderdate"), T(spark, d, "events").groupBy("ts").agg(F.min("event_id").alias("event_id")), "o_orderdate", "ts", "event_id").select("o_orderkey", "event_id")


def as_of(left, right, at: str, since: str, value: str):
    """left with the value of the latest right row at or before it; null before the first.

    Both sides are cut into equal spans of time. Within a span, a running last value over the union answers; a left
    row before the first right row of its span takes the last value of an earlier span, found over one row a span.
    No window sees more than a span, so no key or partition holds everything.
    """
    span = 86_400
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / F.lit(span))
    l_rows = left.select(bucket(at).alias("__b"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.struct(*left.columns).alias("__row"))
    r_rows = right.select(bucket(since).alias("__b"), F.col(since).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"))
    run = W.partitionBy("__b").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = l_rows.unionByName(r_rows).withColumn("__own", F.last("__v", ignorenulls=True).over(run)).filter("__side = 1")
    ends = r_rows.groupBy("__b").agg(F.max_by("__v", "__t").alias("__end"))
    spans = own.select("__b").distinct().join(ends, "__b", "full_outer")
    carried = spans.withColumn("__before", F.last("__end", ignorenulls=True).over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)))  # a row a day
    out = own.join(carried.select("__b", "__before"), "__b").withColumn(value, F.coalesce("__own", "__before"))
    return out.select("__row.*", value)


#: Orders in the days of the events, as moments of their customers' users.
ORDERED = "SELECT o_orderkey, o_custkey % 150 AS buyer, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 43200) AS moment FROM orders"


def _ordered(spark, d):
    moment = F.timestamp_seconds(F.lit(1704067200) + 60 * (F.col("o_orderkey") % 43200))
    return T(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("buyer"), moment.alias("moment"))


@query("x_asof_by_user", f"WITH o AS ({ORDERED}), e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) SELECT o_orderkey, CASE WHEN moment - ts <= INTERVAL 8 HOUR THEN event_id END AS event_id FROM o ASOF LEFT JOIN e ON buyer = user_id AND moment >= ts")
def _(spark, d):
    """Each order with the latest event of its user within eight hours."""
    events = T(spark, d, "events").select("user_id", "ts", "event_id")
    found = timejoins.as_of(_ordered(spark, d), events, [("buyer", "user_id")], "moment", "ts", ["event_id"], 8 * 3600, "event_id")
    return found.select("o_orderkey", "event_id")


@query("x_orders_in_spans", f"WITH o AS ({ORDERED}), s AS (SELECT user_id, min(ts) AS began, max(ts) AS ended, event_type FROM events GROUP BY user_id, event_type, ts::DATE) SELECT o_orderkey, event_type, epoch_us(began) AS began FROM o JOIN s ON buyer = user_id AND moment BETWEEN began AND ended")
def _(spark, d):
    """Orders within the time that their user was active on a day, by kind of event."""
    spans = T(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("ts").alias("began"), F.max("ts").alias("ended"))
    found = timejoins.in_spans(_ordered(spark, d), spans, ("buyer", "user_id"), "moment", "began", "ended")
    return found.select("o_orderkey", "event_type", F.unix_micros(F.col("began").cast("timestamp")).alias("began"))


# -- aggregation ------------------------------------------------------------------------------------------------------


@query(
    "x_sketch_rollup",
    "SELECT 2 - (grouping(lang) + grouping(source)) AS level, lang, source, count(text) AS n, true AS distinct_near, true AS rank_near FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())",
)
def _(spark, d):
    """Distinct texts and the median of their lengths by language and source, from stored sketches, at three levels; held against the rows."""
    rows = T(spark, d, "documents").select("lang", "source", F.xxhash64("text").alias("h"), "text", F.length("text").alias("size"))
    rows = rows.withColumn("h", F.when(F.col("text").isNotNull(), F.col("h"))).drop("text")
    at = fresh_dir(spark, "sketches")
    sketches.sketched(rows, ["lang", "source"], F.col("h"), F.col("size")).write.parquet(at)
    stored, out = spark.read.parquet(at), None
    for by in (["lang", "source"], ["lang"], []):
        told = sketches.estimated(sketches.rolled(stored, by), by, {"median": 0.5})
        near = sketches.verified(rows, told, by, F.col("h"), F.col("size"), "median", 0.5)
        missing = [F.lit(None).cast("string").alias(c) for c in ("lang", "source") if c not in by]
        part = near.select(F.lit(len(by)).cast("long").alias("level"), "*", *missing)
        out = part if out is None else out.unionByName(part)
    return out


@query("a01_count_by_group", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return T(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc_nulls_last(), F.col("source").asc_nulls_last())


@query("a02_filtered_aggregate", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus <> 'F') AS pending FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return T(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") != "F").alias("pending"))


@query("a03_multi_key_group", "SELECT l_returnflag, l_linestatus, count(*) AS items, max(l_quantity) AS most, sum(l_quantity) AS quantity, round(avg(l_discount), 8) AS discount FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("items"), F.max("l_quantity").alias("most"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 8).alias("discount"))


@query("a04_pivot_sum", "SELECT lang, " + ", ".join(f"coalesce(sum(n_chars) FILTER (WHERE source = 'src{i}'), 0)::BIGINT AS src{i}" for i in range(4)) + " FROM documents GROUP BY lang")
def _(spark, d):
    wide = T(spark, d, "documents").groupBy("lang").pivot("source", [f"src{i}" for i in range(4)]).agg(F.sum("n_chars"))
    return wide.select("lang", *(F.coalesce(f"src{i}", F.lit(0)).alias(f"src{i}") for i in range(4)))


@query("a05_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, d):
    return T(spark, d, "part").select("p_brand", "p_type").distinct()


@query(
    "a06_mount_rollup",
    "SELECT source, count(*) AS file_count, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS indexed_count, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS embedded_count, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, (count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) * 100 // count(*))::BIGINT AS embed_pct FROM documents GROUP BY source",
)
def _(spark, d):
    c = B.coverage(spark, d)
    return rollups.mounts(c, ["source"], F.col("mark") != "unmeasured", F.col("mark") == "covered", F.col("lang"))


REGISTRY = "r AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'complete' WHEN 'view' THEN 'complete' WHEN 'signup' THEN 'discovered' ELSE 'failed' END AS stage, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failures, value > 90 AS active, value < 5 AS dirty, event_type <> 'signup' AS embedded, ts FROM events)"


def registry(spark, d):
    """The indexing registry: an event is a file's latest transition."""
    e = T(spark, d, "events")
    stage = F.when(e.event_type.isin("purchase", "click", "view"), "complete").when(e.event_type == "signup", "discovered").otherwise("failed")
    return e.select("event_id", "user_id", stage.alias("stage"), F.when(e.event_type == "error", 1).otherwise(0).alias("failures"), (e.value > 90).alias("active"), (e.value < 5).alias("dirty"), (e.event_type != "signup").alias("embedded"), "ts")


@query(
    "a07_engine_status",
    f"WITH {REGISTRY} SELECT *, CASE WHEN complete + failed < total_files THEN 'indexing' WHEN NOT semantic_ready THEN 'embedding' ELSE 'ready' END AS state FROM (SELECT count(*) AS total_files, count(*) FILTER (WHERE stage = 'complete') AS complete, count(*) FILTER (WHERE failures > 0) AS failed, count(*) FILTER (WHERE stage = 'discovered') AS discovered, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE dirty) AS dirty, count(*) FILTER (WHERE embedded) AS embedded, bool_and(embedded) AS semantic_ready, (count(*) FILTER (WHERE embedded) * 100 // count(*))::BIGINT AS semantic_percent FROM r)",
)
def _(spark, d):
    return rollups.engine_status(registry(spark, d))


@query("a08_lock_stats", "SELECT event_type AS role, count(*) AS operations, round(avg(value), 6) AS avg_wait_ms, max(value) AS max_wait_ms FROM events GROUP BY event_type")
def _(spark, d):
    return T(spark, d, "events").groupBy(F.col("event_type").alias("role")).agg(F.count("*").alias("operations"), F.round(F.avg("value"), 6).alias("avg_wait_ms"), F.max("value").alias("max_wait_ms"))


@query("a09_churn", "SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits, count(DISTINCT o_custkey) AS authors FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def _(spark, d):
    return B.commit_files(spark, d).join(B.commits(spark, d), "hash").groupBy("file").agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"))


COVER = f"WITH {FILES}, c AS (SELECT uri, lang, source, CASE WHEN quality = 1 THEN 'covered' WHEN quality = 0 THEN 'uncovered' ELSE 'unmeasured' END AS mark FROM files LEFT JOIN labels USING (doc_id))"


@query("a10_coverage_counts", COVER + " SELECT lang, count(*) FILTER (WHERE mark = 'covered') AS covered, count(*) FILTER (WHERE mark = 'uncovered') AS uncovered, count(*) FILTER (WHERE mark = 'unmeasured') AS unmeasured FROM c GROUP BY lang")
def _(spark, d):
    return B.coverage(spark, d).groupBy("lang").agg(*(F.count_if(F.col("mark") == m).alias(m) for m in ("covered", "uncovered", "unmeasured")))


ANNOTATIONS = f"WITH {FILES}, a AS (SELECT uri AS target_uri, lang, source, CASE WHEN toxic = 1 AND quality = 0 THEN 'ERROR' WHEN toxic = 1 THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'low-quality' END AS rule_id FROM labels JOIN files USING (doc_id) WHERE toxic = 1 OR quality = 0)"


@query("a11_diagnostic_counts", ANNOTATIONS + " SELECT count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) AS total FROM a")
def _(spark, d):
    s = F.col("severity")
    return B.annotations(spark, d).agg(F.count_if(s == "ERROR").alias("errors"), F.count_if(s == "WARNING").alias("warnings"), F.count("*").alias("total"))


@query("a12_true_totals", "SELECT count(*) AS total_rows, least(count(*), 200) AS returned_rows, count(*) > 200 AS truncated FROM documents")
def _(spark, d):
    return rollups.totals(T(spark, d, "documents"), 200).withColumn("returned_rows", F.col("returned_rows").cast("long"))


@query("a13_insertions_deletions", "SELECT l_orderkey AS hash, count(*) FILTER (WHERE l_returnflag <> 'R') AS insertions, count(*) FILTER (WHERE l_returnflag = 'R') AS deletions FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    gone = F.col("l_returnflag") == "R"
    return T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(F.count_if(~gone).alias("insertions"), F.count_if(gone).alias("deletions"))


@query("a14_guarded_percent", "SELECT event_id, CASE WHEN value - 50 > 0 THEN least(100, floor(user_id * 100 / (value - 50)))::BIGINT END AS pct FROM events")
def _(spark, d):
    return T(spark, d, "events").select("event_id", scalars.percent(F.col("user_id"), F.col("value") - 50).alias("pct"))


SOURCES = [*((f"git://team/r{i}", i) for i in range(12)), ("workspace", 7), ("disk:///a", 2), ("disk:///b", 3), ("disk:///c", 5), ("bucket://logs/2024", 11)]


@query(
    "a15_source_rows",
    "WITH "
    + values("s", "uri, files", SOURCES)
    + ", k AS (SELECT *, CASE WHEN instr(uri, '://') > 0 THEN substr(uri, 1, instr(uri, '://') + 2) ELSE uri END AS sch FROM s) SELECT row_number() OVER (ORDER BY sch = 'workspace' DESC, count(*) DESC, sch) AS position, CASE WHEN count(*) = 1 THEN min(uri) ELSE sch || ' × ' || count(*) END AS label, sum(files)::BIGINT AS files FROM k GROUP BY sch",
)
def _(spark, d):
    return rollups.source_rows(spark.createDataFrame(SOURCES, "uri string, files long"))


@query("a16_state_summary", "SELECT concat_ws(' · ', CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN count(*) FILTER (WHERE event_type = 'view') || ' online' END, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN count(*) FILTER (WHERE event_type = 'error') || ' not answering' END, CASE WHEN count(*) FILTER (WHERE event_type = 'none') > 0 THEN 'x' END) AS summary FROM events")
def _(spark, d):
    return rollups.state_summary(T(spark, d, "events"), "event_type", {"view": "online", "error": "not answering", "none": "checking"})


@query("a17_queue_shape", "SELECT event_type AS queue, CASE WHEN value > 50 THEN 'waiting' ELSE 'running' END AS status, count(*) AS items, max((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 1000000)::BIGINT AS oldest_s FROM events GROUP BY 1, 2")
def _(spark, d):
    e = T(spark, d, "events")
    age = F.timestamp_diff("SECOND", F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    return e.groupBy(e.event_type.alias("queue"), F.when(e.value > 50, "waiting").otherwise("running").alias("status")).agg(F.count("*").alias("items"), F.max(age).alias("oldest_s"))


@query("x_grouping_sets", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(spark, d):
    c, n, r = T(spark, d, "customer"), T(spark, d, "nation"), T(spark, d, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("x_list_aggregation", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def _(spark, d):
    T(spark, d, "nation").createOrReplaceTempView("corvane_nation")
    return spark.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM corvane_nation GROUP BY n_regionkey")


# -- windows, order, limits -------------------------------------------------------------------------------------------


@query("w01_top_per_group", "SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 3")
def _(spark, d):
    docs = T(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return ranking.top_per_group(docs, ["lang"], [F.col("n_chars").desc_nulls_last(), F.col("doc_id").asc_nulls_last()], 3)


@query("w02_response_rank", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey FROM orders QUALIFY rank <= 20")
def _(spark, d):
    return ranking.ranked(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()], 20).select("rank", "o_orderkey")


@query("w03_audit_ordinal", "SELECT user_id, event_id, row_number() OVER w AS ordinal, event_type AS stage, lag(event_type) OVER w AS was, event_type IS DISTINCT FROM lag(event_type) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    was = F.lag("event_type").over(w)
    return T(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("ordinal"), F.col("event_type").alias("stage"), was.alias("was"), (~F.col("event_type").eqNullSafe(was)).alias("changed"))


@query("w04_token_budget", "WITH t AS (SELECT doc_id, greatest(ceil(length(text) / 4.0), 1)::BIGINT AS cost FROM documents), u AS (SELECT doc_id, cost, sum(cost) OVER (ORDER BY cost, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM t) SELECT * FROM u WHERE used <= 3000")
def _(spark, d):
    docs = T(spark, d, "documents").select("doc_id", scalars.token_count(F.col("text")).alias("t"))
    return ranking.fit_budget(docs, [F.col("t").asc_nulls_last(), F.col("doc_id").asc_nulls_last()], F.col("t"), 3000).select("doc_id", "cost", "used")


@query("w05_count_beside", "SELECT doc_id, source, count(*) OVER () AS candidates FROM documents WHERE lang = 'fr'")
def _(spark, d):
    docs = T(spark, d, "documents").filter("lang = 'fr'").select("doc_id", "source")
    return docs.join(F.broadcast(docs.agg(F.count("*").alias("candidates"))))  # one row; a window over all rows would be one task


@query("t01_order_nulls", f"WITH {MOUNT_SQL} SELECT row_number() OVER (ORDER BY kind DESC NULLS LAST, uri) AS position, kind, uri FROM mounts")
def _(spark, d):
    return mounts(spark).select(F.row_number().over(W.orderBy(F.col("kind").desc_nulls_last(), "uri")).cast("long").alias("position"), "kind", "uri")


@query("t02_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return T(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(10)


@query("t05_breadth_auto", "WITH b AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 10), g AS (SELECT *, (p_retailprice - lead(p_retailprice) OVER (ORDER BY rank)) / p_retailprice AS gap FROM b), c AS (SELECT min(rank) AS cut FROM g WHERE gap = (SELECT max(gap) FROM g)) SELECT p_partkey, p_retailprice, rank FROM g, c WHERE rank <= cut")
def _(spark, d):
    return ranking.breadth(T(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")


ANSWERS = [("a", 1, 2), ("b", 2, 0), ("a", 3, 9), ("c", 4, 1), ("d", 5, 4), ("e", 6, 3)]


@query("t07_shared_limit", "WITH " + values("x", "target, position, n", ANSWERS) + ", f AS (SELECT target, min(position) AS position, arg_min(n, position) AS n FROM x GROUP BY target ORDER BY position LIMIT 8), l AS (SELECT *, 5 - coalesce(sum(n) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f) SELECT target, position::BIGINT AS position, n::BIGINT AS n, least(n, room)::BIGINT AS shown FROM l WHERE room > 0")
def _(spark, d):
    return ranking.shared_limit(spark.createDataFrame(ANSWERS, "target string, position long, n long"), "target", "position", "n")


@query("t08_stuck_candidates", "SELECT event_id, user_id AS in_progress_ms, value AS waiting_ms FROM events ORDER BY user_id DESC, value DESC, event_id LIMIT 15")
def _(spark, d):
    e = T(spark, d, "events").select("event_id", F.col("user_id").alias("in_progress_ms"), F.col("value").alias("waiting_ms"))
    return e.orderBy(F.col("in_progress_ms").desc_nulls_last(), F.col("waiting_ms").desc_nulls_last(), "event_id").limit(15)


@query("t09_representation", "SELECT source, count(*) AS files, CASE WHEN 60000 // count(*) >= 2000 THEN 'content' WHEN 60000 // count(*) >= 500 THEN 'structure' ELSE 'headline' END AS shown_as FROM documents GROUP BY source")
def _(spark, d):
    n = T(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"))
    return n.withColumn("shown_as", ranking.representation(F.floor(F.lit(60000) / F.col("files"))))


@query("t10_adaptive_threshold", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= (SELECT max(p_retailprice) FROM part) * 0.9")
def _(spark, d):
    return ranking.near_best(T(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 0.9)


@query("t11_scope_ceiling", f"WITH {FILES} SELECT uri, count(*) OVER () <= 96 AS fits FROM files WHERE starts_with(uri, 'doc:///es/src1/')")
def _(spark, d):
    return ranking.within(B.documents(spark, d, "doc:///es/src1/**").select("uri"), 96)


# -- sets -------------------------------------------------------------------------------------------------------------


@query("u03_labelled_union", "SELECT 'customers' AS remote, c_name AS name FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 'suppliers', s_name FROM supplier WHERE s_nationkey = 1")
def _(spark, d):
    a = T(spark, d, "customer").filter("c_nationkey = 1").select(F.lit("customers").alias("remote"), F.col("c_name").alias("name"))
    return a.unionByName(T(spark, d, "supplier").filter("s_nationkey = 1").select(F.lit("suppliers").alias("remote"), F.col("s_name").alias("name")))


@query("u04_first_occurrence", "SELECT l_partkey AS target, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return T(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))


# -- scalar functions -------------------------------------------------------------------------------------------------


@query("f01_media_type_kind", "SELECT doc_id, 'text/markdown; kind=markdown.' || lang AS mime, 'markdown.' || lang AS kind, NULL::VARCHAR AS none FROM documents")
def _(spark, d):
    mime = F.concat(F.lit("text/markdown; kind=markdown."), F.col("lang"))
    return T(spark, d, "documents").select("doc_id", mime.alias("mime"), scalars.media_type_kind(mime).alias("kind"), scalars.media_type_kind(F.lit("text/plain")).alias("none"))


@query("f02_starts_with", f"WITH {MOUNT_SQL} SELECT uri, coalesce(starts_with(path_prefix, '/data'), false) AS app FROM mounts")
def _(spark, d):
    return mounts(spark).select("uri", scalars.starts_with(F.col("path_prefix"), F.lit("/data")).alias("app"))


@query("f03_trim_chars", f"WITH {MOUNT_SQL} SELECT uri, trim(path_prefix, '/') AS trimmed FROM mounts")
def _(spark, d):
    return mounts(spark).select("uri", scalars.trim_chars(F.col("path_prefix"), "/").alias("trimmed"))


@query("f04_lower_concat", "SELECT c_custkey, lower(c_name) || '/' || c_custkey AS key FROM customer")
def _(spark, d):
    return T(spark, d, "customer").select("c_custkey", F.concat(F.lower("c_name"), F.lit("/"), F.col("c_custkey").cast("string")).alias("key"))


@query("f05_concat_ws_nullif", f"WITH {MOUNT_SQL} SELECT uri, concat_ws('|', kind, nullif(authority, ''), coalesce(path_prefix, '-')) AS joined FROM mounts")
def _(spark, d):
    return mounts(spark).select("uri", F.concat_ws("|", "kind", F.nullif("authority", F.lit("")), F.coalesce("path_prefix", F.lit("-"))).alias("joined"))


@query("f06_plural", "SELECT n_regionkey, CASE WHEN count(*) > 0 THEN count(*) || ' nation' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END END AS told FROM nation GROUP BY n_regionkey")
def _(spark, d):
    n = T(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return n.select("n_regionkey", scalars.counted(n.n, "nation", "nations").alias("told"))


@query("f07_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' OR p_name LIKE 'p_rt%'")
def _(spark, d):
    p = T(spark, d, "part")
    return p.filter(p.p_type.like("%A%") | p.p_name.like("p_rt%")).select("p_partkey")


@query("f08_json_extract", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def _(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


OPERATIONS = [("startup", None), ("sweep", None), ("analyze", ""), ("import:github.com/team/api", None), ("import:github.com/team/api", "github://team/api/"), ("import:/worktree://wt/", None), ("import:wt", "worktree://wt/"), ("import:", None), ("import:gitlab.com/g/p", ""), (None, None)]
OPERATIONS_TOLD = ["indexing this repository", None, None, "importing github://team/api", "importing github://team/api", None, None, None, "importing gitlab.com/g/p", None]


@query("f11_operation_words", "WITH " + values("o", "n, operation, told", [(i, o[0], t) for i, (o, t) in enumerate(zip(OPERATIONS, OPERATIONS_TOLD, strict=True))]) + " SELECT n::BIGINT AS n, operation, told FROM o")
def _(spark, d):
    o = spark.createDataFrame([(i, *x) for i, x in enumerate(OPERATIONS)], "n long, operation string, filesystem string")
    return o.select("n", "operation", scalars.described(o.operation, o.filesystem).alias("told"))


@query("f12_grouped_thousands", "SELECT c_custkey, format('{:,}', c_custkey * 98765) AS told FROM customer")
def _(spark, d):
    return T(spark, d, "customer").select("c_custkey", scalars.grouped(F.col("c_custkey") * 98765).alias("told"))


@query("f13_scheme", "SELECT page_id, substr(url, 1, instr(url, '://') + 2) AS scheme FROM pages")
def _(spark, d):
    return T(spark, d, "pages").select("page_id", rollups.scalars_scheme(F.col("url")).alias("scheme"))


@query("f14_json_round_trip", "SELECT doc_id, text FROM documents")
def _(spark, d):
    docs = T(spark, d, "documents")
    coded = docs.select("doc_id", scalars.json_text(F.struct(docs.text.alias("t"))).alias("j"))
    return coded.select("doc_id", F.from_json("j", "t string").getField("t").alias("text"))


COMMANDS = [("host  status", "host|status"), ("import add 'a b' \"c d\"", "import|add|a b|c d"), ("x", "x"), ("", "")]


@query("f15_command_words", "WITH " + values("c", "line, words", COMMANDS) + " SELECT * FROM c")
def _(spark, d):
    c = spark.createDataFrame([(a,) for a, _ in COMMANDS], "line string")
    return c.select("line", F.array_join(scalars.command_words(c.line), "|").alias("words"))


SHELLS = [("cat a.txt", "a.txt"), ("sed -n '1,5p' src/x.ts | head -20", "src/x.ts"), ("cat a b", None), ("cat a; rm b", None), ("head -n 5 'my file.md' | nl", "my file.md"), ("cat a | grep x", None), ("ls a", None), ("sed -e s/a/b/ f.txt", "f.txt"), ("cat \"$HOME/x\"", None), ("tail -3 log | sed -n '2,$p'", "log"), ("cat 'a", None)]


@query("f16_shell_target", "WITH " + values("c", "line, target", SHELLS) + " SELECT * FROM c")
def _(spark, d):
    c = spark.createDataFrame([(a,) for a, _ in SHELLS], "line string")
    return c.select("line", scalars.shell_target(c.line).alias("target"))


PATCHES = [("*** Begin Patch\n*** Add File: a/b.py\n+x\n*** Update File: c.md \n*** Delete File: d\n*** Move to: e.md\n*** Update File: c.md", "a/b.py,c.md,e.md"), ("nothing", "")]
REPORTS = [("Success. Updated the following files:\nA a.txt\nM b c.txt\nD gone\n\nM d\nDone\nM not", "a.txt,b c.txt,d"), ("failed", "")]


@query("f17_patch_targets", "WITH " + values("c", "n, targets", [(i, t) for i, (_, t) in enumerate(PATCHES + REPORTS)]) + " SELECT n::BIGINT AS n, targets FROM c")
def _(spark, d):
    p = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(PATCHES + REPORTS)], "n long, t string")
    return p.select("n", F.array_join(F.when(p.n < len(PATCHES), scalars.patch_targets(p.t)).otherwise(scalars.applied_targets(p.t)), ",").alias("targets"))


@query("f18_digest", "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def _(spark, d):
    return T(spark, d, "documents").select("doc_id", scalars.digest16(F.col("text")).alias("digest"))


@query("f19_token_count", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def _(spark, d):
    return T(spark, d, "documents").select("doc_id", scalars.token_count(F.col("text")).alias("tokens"))


@query("f20_headline", r"SELECT doc_id, substr(trim(regexp_replace(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '^[#>*\-\s]+', '')), 1, 120) AS headline FROM documents")
def _(spark, d):
    return T(spark, d, "documents").select("doc_id", scalars.headline(F.col("text")).alias("headline"))


def _walk_sql() -> str:
    """The walk of operators.summaries in SQL, a step a table."""
    words = lambda t: rf"list_distinct(regexp_extract_all(translate({t}, '{summaries.UPPER}', '{summaries.LOWER}'), '{summaries.WORD}'))"
    parts = [
        "n AS (SELECT count(*) AS n FROM documents)",
        f"df AS (SELECT word, count(*) AS df FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word)",
        "g AS (SELECT word, floor(1000 * ln(1 + n::DOUBLE / df))::BIGINT AS g FROM df, n)",
        r"p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS list FROM documents)",
        "s AS (SELECT doc_id, unnest(list) AS piece, generate_subscripts(list, 1)::BIGINT - 1 AS s FROM p)",
        f"w AS (SELECT doc_id, s, unnest({words('piece')}) AS word FROM s)",
        f"r0 AS (SELECT doc_id, s, word, g, count(*) OVER (PARTITION BY doc_id, word) AS shared, sum(g) OVER (PARTITION BY doc_id, s)::BIGINT AS total, {summaries.START}::BIGINT AS r FROM w JOIN g USING (word))",
    ]
    for i in range(summaries.STEPS):
        got = f"SELECT * REPLACE (sum(r * g // total) OVER (PARTITION BY doc_id, word)::BIGINT // shared AS r) FROM r{i}"
        parts.append(f"r{i + 1} AS (SELECT * REPLACE ({summaries.START * (1000 - summaries.FOLLOWED) // 1000} + sum(r) OVER (PARTITION BY doc_id, s)::BIGINT * {summaries.FOLLOWED} // 1000 AS r) FROM ({got}))")
    return "WITH " + ", ".join(parts) + f", f AS (SELECT DISTINCT doc_id, s AS ordinal, r AS score FROM r{summaries.STEPS})"


@query("f20_sentence_ranks", _walk_sql() + " SELECT doc_id, ordinal, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) <= 3 AS picked FROM f")
def _(spark, d):
    return summaries.picked(summaries.ranked(T(spark, d, "documents"), "doc_id"), "doc_id")


@query("f20_summaries", _walk_sql() + ", k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS place FROM f) SELECT doc_id, summary FROM documents LEFT JOIN (SELECT k.doc_id, string_agg(trim(piece), ' ' ORDER BY ordinal) AS summary FROM k JOIN s ON s.doc_id = k.doc_id AND s.s = k.ordinal WHERE place <= 3 GROUP BY k.doc_id) USING (doc_id)")
def _(spark, d):
    return summaries.summaries(T(spark, d, "documents"), "doc_id")


@query("f21_ages", "SELECT event_id, ((epoch_us(TIMESTAMP '2024-02-01') // 1000) - (epoch_us(ts) // 1000))::BIGINT AS waiting_ms, (ts::DATE + 30)::VARCHAR AS expires FROM events")
def _(spark, d):
    t = F.col("ts").cast("timestamp")
    return T(spark, d, "events").select("event_id", (F.unix_millis(F.lit("2024-02-01").cast("timestamp")) - F.unix_millis(t)).alias("waiting_ms"), F.date_add(t.cast("date"), 30).cast("string").alias("expires"))


LABELS = [("READINESS_SEARCHABLE", "searchable"), ("Complete", "complete"), (None, None)]


@query("f22_readiness_label", "WITH " + values("l", "label, told", LABELS) + " SELECT * FROM l")
def _(spark, d):
    rows = spark.createDataFrame([(a,) for a, _ in LABELS], "label string")
    return rows.select("label", scalars.readiness(rows.label).alias("told"))
