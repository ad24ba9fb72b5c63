"""Keyed state with timers, restarts, and joins of streams, against the same thing over tables or by hand."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from corvane.streaming import feeds, leases, timers
from pyspark.sql import functions as F

BEGAN = datetime(2024, 3, 1, tzinfo=UTC)
BEAT = "run long, ts timestamp"


def put(at, number, rows):
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/{number:03}.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    os.utime(f"{at}/{number:03}.json", (1_700_000_000 + number, 1_700_000_000 + number))


def when(seconds):
    return (BEGAN + timedelta(seconds=seconds)).isoformat()


def beats():
    rng = random.Random(1)
    out = [{"run": rng.randint(1, 4), "ts": when(rng.uniform(0, 40_000))} for _ in range(400)]
    return sorted(out, key=lambda r: r["ts"])


def test_leases_end_by_timers_across_a_restart(spark, tmp_path):
    """Two runs from one checkpoint tell every lease once; late rows within the delay count, and a beat at the very end of a lease keeps it."""
    rows = beats() + [{"run": 9, "ts": when(0)}, {"run": 9, "ts": when(600)}, {"run": 9, "ts": when(1199)}]
    rng = random.Random(2)
    rows.sort(key=lambda r: datetime.fromisoformat(r["ts"]).timestamp() + rng.uniform(0, 250))  # out of order by less than the delay
    feed, sink, progress = (str(tmp_path / x) for x in ("feed", "sink", "progress"))
    stream = lambda: timers.leases(feeds.stream_of(spark, feed, BEAT).withWatermark("ts", "300 seconds"), "run", "ts", 600)
    for n in range(3):
        put(feed, n, rows[n * 100 : (n + 1) * 100])
    feeds.available(stream(), checkpoint=progress, path=sink)
    put(feed, 3, rows[300:])
    put(feed, 4, [{"run": 77, "ts": when(90_000)}])
    got = feeds.available(stream(), checkpoint=progress, path=sink)
    table = spark.createDataFrame([(r["run"], datetime.fromisoformat(r["ts"])) for r in rows], BEAT)
    told = lambda df: sorted(map(tuple, df.select("run", F.unix_micros("began"), F.unix_micros("ended"), "beats").collect()))
    assert told(got) == told(leases.leases(table, "run", "ts", 600))
    nine = [x for x in told(got) if x[0] == 9]
    assert [x[3] for x in nine] == [3]
    feeds.available(stream(), checkpoint=progress, path=sink)
    assert told(spark.read.schema(got.schema).parquet(sink)) == told(got)  # a run without news changes nothing


def test_held_sections_are_taken_once_by_their_run_and_forgotten_in_time(spark, tmp_path):
    add = lambda t, n, session, run="r", text=None: {"host": "h", "seq": n, "ts": when(t), "session": session, "run": run, "section": text or f"text {n}", "take": False}
    take = lambda t, n, session, run="r": {"host": "h", "seq": n, "ts": when(t), "session": session, "run": run, "section": None, "take": True}
    rows = [add(i, i, f"s{i}") for i in range(5)]  # the first goes: four sessions at most
    rows += [take(10, 10, "s0"), take(11, 11, "s1"), take(12, 12, "s1"), take(13, 13, "s2", "other"), take(14, 14, "s2")]
    rows += [add(20, 20, "s3", text="more"), take(21, 21, "s3"), add(30, 30, "s4", run="new"), take(31, 31, "s4", "new"), take(4000, 40, "s4"), add(5000, 50, "late"), take(8599, 51, "late"), add(8600, 52, "late"), take(12_200, 53, "late")]
    put(str(tmp_path / "feed"), 0, rows[::-1])
    put(str(tmp_path / "feed"), 1, [{"host": "end", "seq": 99, "ts": when(90_000), "session": "x", "run": "r", "section": "x", "take": False}])
    schema = "host string, seq long, ts timestamp, session string, run string, section string, take boolean"
    stream = feeds.stream_of(spark, str(tmp_path / "feed"), schema).withWatermark("ts", "0 seconds")
    out = feeds.available(timers.held_sections(stream, "host", "ts", "seq", F.col("session"), F.col("run"), F.col("section"), F.col("take"), sessions=4))
    assert {r["seq"]: r["sections"] for r in out.collect()} == {
        10: None, 11: "text 1", 12: None, 13: None, 14: None, 21: "text 3\n\nmore", 31: "text 30", 40: None, 51: "text 50", 53: None,
    }


def test_pairs_of_streams_once_and_with_bounded_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"run": rng.randint(0, 3), "seq": n, "ts": when(n * 60 + rng.uniform(0, 50)), "side": rng.choice("ab")} for n in range(400)]
    for n in range(8):
        part = rows[n * 50 : (n + 1) * 50]
        put(str(tmp_path / "a"), n, [r for r in part if r["side"] == "a"] * 2)  # delivered twice
        put(str(tmp_path / "b"), n, [r for r in part if r["side"] == "b"])
    schema = "run long, seq long, ts timestamp, side string"
    side = lambda x: feeds.stream_of(spark, str(tmp_path / x), schema)
    pairs = timers.pairs_within(side("a"), side("b"), "run", "ts", "seq", 900, "120 seconds")
    query = pairs.writeStream.format("memory").queryName("pairs_of_streams").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    at = lambda r: datetime.fromisoformat(r["ts"])
    want = {(a["seq"], b["seq"]) for a in rows for b in rows if a["side"] == "a" and b["side"] == "b" and a["run"] == b["run"] and timedelta(0) <= at(b) - at(a) <= timedelta(seconds=900)}
    got = [(r["first"], r["second"]) for r in spark.table("pairs_of_streams").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert held and max(held[4:]) < 250  # of 600 rows delivered


def test_processors_say_what_is_missing():
    with pytest.raises(NotImplementedError):
        timers.InOrder().take((), [], 0)
