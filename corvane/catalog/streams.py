"""Streams over feeds, checked against the same thing said over tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import retrieve
from ..operators.lineage import fresh_dir
from ..sources import bindings as B
from ..streaming import feeds, leases, monitor, timers, waits
from . import query
from .relational import values
from .sources import put

T = B.table
HOST = {"host_pid": 812, "host_started_at_unix_ms": 1700000000001}
IMPORT = {"type": "host.signal", "signal": "progress", **HOST, "operation": "import:github.com/team/api", "operation_total": 40, "operation_done": 9, "registry_total": 5000, "registry_complete": 4100, "settled": False}
FEED = [
    {"type": "monitor.connection", "state": "waiting"},
    {"type": "monitor.connection", "state": "connected", **HOST},
    {"type": "session.snapshot", **HOST},
    IMPORT,
    IMPORT,
    IMPORT | {"operation_done": 22},
    IMPORT | {"operation": "sweep"},
    {"type": "host.signal", "signal": "hello", **HOST, "version": "2.0"},
    IMPORT | {"operation": "startup", "operation_total": 0},
    IMPORT | {"operation": "", "settled": True},
    {"type": "monitor.connection", "state": "lost"},
    {"type": "monitor.connection", "state": "connected", "host_pid": 950, "host_started_at_unix_ms": 1700000555000},
]
#: seq, connection, files, work, percent, notice, line: every change, and nothing for records that change nothing.
FOLDED = [
    (0, "waiting", None, None, None, None, None),
    (1, "connected", None, None, None, None, None),
    (3, "connected", 4100, "importing github://team/api", 22, None, None),
    (5, "connected", 4100, "importing github://team/api", 55, None, "importing github://team/api 55%"),
    (6, "connected", 4100, None, None, None, None),
    (7, "connected", 4100, None, None, None, None),
    (8, "connected", 4100, "indexing this repository", None, None, "indexing this repository"),
    (9, "connected", 4100, None, None, None, None),
    (10, "lost", 4100, None, None, None, None),
    (11, "connected", None, None, None, "host restarted", None),
]


def _feed(spark, records):
    """Lines of a feed, a file each half, six seconds between records, as a stream of records."""
    lines = [json.dumps({**r, "seq": i, "at_ms": i * 6000, "feed": "f"}) for i, r in enumerate(records)]
    half = len(lines) // 2
    root = put(spark, {"a.jsonl": "\n".join([*lines[:half], "not json", "[1,2]"]), "b.jsonl": "\n".join(lines[half:])})
    return feeds.stream_of(spark, root, feeds.RECORD + ", at_ms long, feed string")


@query("d01_stateful_fold", "WITH " + values("f", "seq, connection, files, work, percent, notice, line", FOLDED) + " SELECT seq::BIGINT AS seq, connection, files::BIGINT AS files, work, percent::BIGINT AS percent, notice, line FROM f")
def _(spark, d):
    rows = feeds.available(monitor.fold(_feed(spark, FEED).drop("at")))
    return rows.select("seq", "connection", "files", "work", "percent", "notice", "line")


LINES = ['{"type": "a", "seq": 1}', "not json", "[1,2]", "", '{"seq": 2, "other": 3}', '{"seq": "x', '{"type": null}']


@query("d02_malformed_lines", "SELECT * FROM (VALUES ('a', 1::BIGINT), (NULL, 2), (NULL, NULL)) v(type, seq)")
def _(spark, d):
    return feeds.parsed(spark.createDataFrame([(x,) for x in LINES], "value string"), "type string, seq long")


@query("d03_emit_on_change", f"SELECT {len(FOLDED)}::BIGINT AS changes, {len(FEED)}::BIGINT AS records")
def _(spark, d):
    changes = feeds.available(monitor.fold(_feed(spark, FEED).drop("at"))).select(F.count("*").alias("changes"))
    return changes.select("changes", F.lit(len(FEED)).cast("long").alias("records"))


@query("d04_dwell", "SELECT * FROM (VALUES (9000::BIGINT, NULL), (10000, 'importing github://team/api 22%')) v(after_ms, line)")
def _(spark, d):
    said = monitor.facts(feeds.parsed(spark.createDataFrame([(json.dumps(IMPORT),)], "value string"))).first()
    view = monitor.after(monitor.View(), monitor.Facts(*said), 0)
    return spark.createDataFrame([(t, view.line(t)) for t in (9_000, 10_000)], "after_ms long, line string")


SETTLES = "CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND value > 90) THEN 'failed' WHEN event_type = 'purchase' THEN 'met' END"


def _settles():
    t, v = F.col("state"), F.col("value")
    return t == "purchase", (t == "error") | ((t == "purchase") & (v > 90))


@query("d05_edge_wait", f"SELECT user_id AS run, arg_min({SETTLES}, event_id) AS outcome, min(event_id) AS seq FROM events WHERE event_id > 100 AND {SETTLES} IS NOT NULL GROUP BY user_id")
def _(spark, d):
    replay = feeds.since(B.signals(spark, d), "seq", F.lit(100))
    return waits.outcomes(replay, "run", ["seq"], *_settles()).select("run", "outcome", "seq")


@query("d05_edge_wait_stream", f"SELECT event_id AS seq, user_id AS run, {SETTLES} AS outcome FROM events WHERE event_id > 100 AND {SETTLES} IS NOT NULL")
def _(spark, d):
    at = feeds.as_lines(B.signals(spark, d).select("run", "seq", "state", "value"))
    records = feeds.since(feeds.stream_of(spark, at, "run long, seq long, state string, value double"), "seq", F.lit(100))
    return feeds.available(waits.matching(records, *_settles())).select("seq", "run", "outcome")


@query("d06_level_wait", "SELECT user_id AS run, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def _(spark, d):
    return waits.current(B.signals(spark, d), "run", ["ts", "seq"], "state")


@query("d07_timeout_outcome", "SELECT * FROM (VALUES ('condition', 'failed'), ('bare', 'elapsed'), ('true', 'met')) v(kind, outcome)")
def _(spark, d):
    return spark.createDataFrame([("condition", waits.wait(lambda: False, 0.1)), ("bare", waits.wait(None, 0.1)), ("true", waits.wait(lambda: True, 1))], "kind string, outcome string")


@query("d08_alerts_before_matching", f"SELECT user_id AS run, arg_min({SETTLES}, event_id) AS outcome FROM events WHERE value > 30 AND {SETTLES} IS NOT NULL GROUP BY user_id")
def _(spark, d):
    return waits.outcomes(B.signals(spark, d), "run", ["seq"], *_settles(), alerts=F.col("value") > 30).select("run", "outcome")


@query("d09_readiness", "WITH l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS l, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events) SELECT event_id AS seq, (max(l) OVER (PARTITION BY user_id, n ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS level FROM l")
def _(spark, d):
    s = F.col("state")
    level = F.when(s == "view", 1).when(s == "click", 2).when(s == "signup", 3).when(s == "purchase", 4).otherwise(0)
    return waits.readiness(B.signals(spark, d), "run", ["ts", "seq"], level, s == "error").select("seq", F.col("level").cast("long").alias("level"))


LEASES = "g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), held AS (SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS beats FROM s GROUP BY user_id, k)"


def _leases(spark, d):
    return leases.leases(B.signals(spark, d), "run", "ts", 6 * 3600)


@query("d10_leases", f"WITH {LEASES} SELECT user_id AS run, epoch_us(began) AS began, epoch_us(ended) AS ended, beats FROM held")
def _(spark, d):
    return _leases(spark, d).select("run", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "beats")


@query("d10_leases_stream", f"WITH {LEASES} SELECT user_id AS run, epoch_us(began) AS began, beats FROM held WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 31 DAY + INTERVAL 31 DAY - INTERVAL 1 MINUTE")
def _(spark, d):
    """The stream closes a lease when the watermark passes its end; only closed ones are compared."""
    beats = B.signals(spark, d).select("run", "ts").repartition(1).sortWithinPartitions("ts")
    at = feeds.as_lines(beats)
    records = feeds.stream_of(spark, at, "run long, ts timestamp").withWatermark("ts", "0 seconds")
    rows = feeds.available(leases.leases(records, "run", "ts", 6 * 3600))
    last = T(spark, d, "events").agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 1 MINUTE")).alias("m"))
    return rows.join(F.broadcast(last), F.col("ended") <= F.col("m")).select("run", F.unix_micros("began").alias("began"), "beats")  # one row


@query("d10_active_leases", f"WITH {LEASES} SELECT count(*) FILTER (WHERE began <= TIMESTAMP '2024-01-15 12:00:00' AND ended > TIMESTAMP '2024-01-15 12:00:00') AS active FROM held")
def _(spark, d):
    return leases.active_at(_leases(spark, d), "2024-01-15 12:00:00")


@query("d11_idle_shutdown", "WITH b AS (SELECT ts AS began, ts + INTERVAL 10 MINUTE AS ended FROM events), m AS (SELECT *, max(ended) OVER (ORDER BY began ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT epoch_us(before) AS began, epoch_us(began) AS ended FROM m WHERE began - before >= INTERVAL 20 MINUTE")
def _(spark, d):
    held = B.signals(spark, d).select(F.col("ts").alias("began"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ended"))
    rows = leases.idle(held, 20 * 60)
    return rows.select(F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"))


@query("d12_milestones", "SELECT user_id AS run, event_type AS state, epoch_us(min(ts)) AS at FROM events GROUP BY 1, 2")
def _(spark, d):
    return waits.milestones(B.signals(spark, d), "run", "state", "ts").select("run", "state", F.unix_micros("ts").alias("at"))


@query("d13_incremental_upsert", "SELECT user_id AS run, max(event_id) AS seq, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def _(spark, d):
    at = feeds.as_lines(B.signals(spark, d).select("run", "seq", "state").repartition(2, "seq"))
    table = feeds.Upserts(spark, fresh_dir(spark, "upserts"), ["run"], "seq")
    feeds.each_batch(feeds.stream_of(spark, at, "run long, seq long, state string"), table.write)
    return table.read().select("run", "seq", "state")


ATTEMPTS = [("a", 1, "failed", "x"), ("a", 2, "failed", "x"), ("a", 3, "done", "y"), ("b", 1, "deferred", "x"), ("b", 2, "done", "x"), ("b", 3, "done", "x")]


@query("d14_deferred_is_not_failed", "WITH " + values("a", "uri, n, due", [(u, n, due) for (u, n, _, _), due in zip(ATTEMPTS, (True, False, True, True, True, False), strict=True)]) + " SELECT uri, n::BIGINT AS n, due FROM a")
def _(spark, d):
    rows = spark.createDataFrame(ATTEMPTS, "uri string, n long, state string, digest string")
    return waits.retried(rows, "uri", ["n"], "state", "digest").select("uri", "n", "due")


@query("d15_one_result", "SELECT '3' AS result, 2::BIGINT AS progress, 'the call ended without a result' AS error")
def _(spark, d):
    seen = []
    result = waits.only_result([("progress", 1), ("progress", 2), ("result", 3)], seen.append)
    try:
        waits.only_result([("progress", 1)])
        error = None
    except ValueError as e:
        error = str(e)
    return spark.createDataFrame([(str(result), len(seen), error)], "result string, progress long, error string")


@query("d16_missed_signals", "WITH g AS (SELECT user_id AS run, event_id AS seq, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS missed FROM events) SELECT run, seq, missed FROM g WHERE missed > 0")
def _(spark, d):
    return retrieve.gaps(B.signals(spark, d), "run", "seq")


@query("d18_stale_while_refresh", "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, false), (301, 1, true), (302, 2, false)) v(at_s, value, due)")
def _(spark, d):
    now, loads = [0], []
    cache = waits.Stale(lambda: (loads.append(1), len(loads))[1], clock=lambda: now[0])
    rows = [(0, *cache.get())]
    now[0] = 301
    rows.append((301, *cache.get()))
    cache.refresh()
    now[0] = 302
    rows.append((302, *cache.get()))
    return spark.createDataFrame(rows, "at_s long, value long, due boolean")


@query("d19_restart_from_checkpoint", "SELECT event_id AS seq FROM events")
def _(spark, d):
    """Two runs of one stream over a growing folder: the second goes on where the first ended."""
    rows = B.signals(spark, d).select("run", "seq")
    at, progress, path = fresh_dir(spark, "feed"), fresh_dir(spark, "progress"), fresh_dir(spark, "stream")
    for part in (0, 1):
        rows.filter(F.col("seq") % 2 == part).select(F.to_json(F.struct("run", "seq")).alias("value")).write.mode("append").text(at)
        out = feeds.available(feeds.stream_of(spark, at, "run long, seq long", 100), checkpoint=progress, path=path)
    return out.select("seq")


@query("d20_remote_discovery", "SELECT * FROM (VALUES ('a', 'online', NULL), ('b', 'offline', 'timeout'), ('c', 'checking', NULL)) v(name, state, reason)")
def _(spark, d):
    kind = "name string, state string, reason string"
    remotes = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    return waits.latest_answers(remotes, spark.createDataFrame([("a", "online", None)], kind), spark.createDataFrame([("a", "offline", "old"), ("b", "offline", "timeout")], kind))


#: Of the feed of events as actions: takes, and the time that a section is held.
TAKES, HOLD_S = ("purchase", "error"), 6 * 3600


@query(
    "m07_held_entries",
    f"""WITH e AS (SELECT user_id // 200 AS host, event_id AS seq, user_id AS session, ts, (ts::DATE)::VARCHAR AS run, event_type || ' ' || event_id AS section, event_type IN {TAKES} AS take FROM events),
o AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN take THEN 1 ELSE 0 END * rn) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, seq) AS rn FROM e) WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
x AS (SELECT t.host, t.seq, t.session::VARCHAR AS session, string_agg(a.section, chr(10) || chr(10) ORDER BY a.n) AS sections FROM o t LEFT JOIN o a ON a.session = t.session AND NOT a.take AND a.n < t.n AND a.n > coalesce(t.prior, 0) AND a.run = t.run AND epoch_us(t.ts) - epoch_us(a.ts) < {HOLD_S * 1_000_000} WHERE t.take AND t.ts <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY ALL)
SELECT * FROM x""",
)
def _(spark, d):
    """Every event is an addition or a take of its user's session; 200 users share a host."""
    s = B.signals(spark, d)
    at = feeds.as_lines(s.select(F.floor(F.col("run") / 200).cast("long").alias("host"), "run", "seq", "ts", "state"))
    actions = feeds.stream_of(spark, at, "host long, run long, seq long, ts timestamp, state string", 1000).withWatermark("ts", "0 seconds")
    section = F.concat_ws(" ", "state", F.col("seq").cast("string"))
    rows = feeds.available(timers.held_sections(actions, "host", "ts", "seq", F.col("run"), F.to_date("ts"), section, F.col("state").isin(*TAKES), HOLD_S * 1000))
    return rows.join(_settled(s), "seq", "left_semi")


def _settled(signals):
    """seq of what the last watermark has passed for sure."""
    last = signals.agg((F.max("ts") - F.expr("INTERVAL 1 MINUTE")).alias("m"))
    return signals.join(F.broadcast(last), F.col("ts") <= F.col("m")).select("seq")  # one row


@query("d10_leases_by_timer", f"WITH {LEASES} SELECT user_id AS run, epoch_us(began) AS began, epoch_us(ended) AS ended, beats FROM held WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def _(spark, d):
    s = B.signals(spark, d)
    records = feeds.stream_of(spark, feeds.as_lines(s.select("run", "ts")), "run long, ts timestamp", 1000).withWatermark("ts", "0 seconds")
    rows = feeds.available(timers.leases(records, "run", "ts", 6 * 3600))
    last = s.agg((F.max("ts") - F.expr("INTERVAL 1 MINUTE")).alias("m"))
    return rows.join(F.broadcast(last), F.col("ended") <= F.col("m")).select("run", F.unix_micros("began").alias("began"), F.unix_micros("ended").alias("ended"), "beats")  # one row


@query("x_pairs_within_an_hour", "SELECT a.user_id AS run, a.event_id AS first, b.event_id AS second FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def _(spark, d):
    """Streams of views and of purchases, each delivered twice."""
    s = B.signals(spark, d).select("run", "seq", "ts", "state")
    side = lambda state: feeds.stream_of(spark, feeds.as_lines(s.filter(F.col("state") == state).unionByName(s.filter(F.col("state") == state))), "run long, seq long, ts timestamp, state string", 1000)
    return feeds.available(timers.pairs_within(side("view"), side("purchase"), "run", "ts", "seq", 3600)).select("run", "first", "second")


@query("s37_telemetry_capture", "SELECT event_type AS state, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def _(spark, d):
    at = feeds.as_lines(B.signals(spark, d).select("run", "seq", "state", "props"))
    rows = feeds.available(feeds.stream_of(spark, at, "run long, seq long, state string, props string", 10))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("s38_monitor_feed", "SELECT event_id AS seq, event_type AS state FROM events WHERE event_id > 500")
def _(spark, d):
    at = feeds.as_lines(B.signals(spark, d).select("seq", "state"))
    return feeds.since(feeds.parsed(spark.read.text(at), "seq long, state string"), "seq", F.lit(500))


@query("x_event_time_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    rows = B.signals(spark, d).groupBy(F.window("ts", "1 day").alias("w"), F.col("state").alias("event_type")).agg(F.count("*").alias("n"))
    return rows.select(F.unix_micros("w.start").alias("day"), "event_type", "n")
