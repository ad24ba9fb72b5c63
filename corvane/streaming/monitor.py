"""The fold of a feed of host records into what a display shows: one state for each feed.

What a record says is worked out by column expressions, once and without state, as a row of FACTS. What is left to the
fold is one equation for each field of the view.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars

#: Milliseconds that work must last before it is shown.
DWELL_MS = 10_000
RESTARTED = "host restarted"


class Facts(NamedTuple):
    """What one record says; None where it says nothing.

    link: the feed itself waits or is lost. pid and started: the run of the host that speaks. idle: its work is over.
    news: the record tells of progress, so what it does not name is not going on.
    """

    link: str | None
    pid: int | None
    started: int | None
    version: str | None
    files: int | None
    idle: bool
    news: bool
    work: str | None
    percent: int | None


def facts(records: DataFrame, *keep: str) -> DataFrame:
    """Records, as feeds.parsed() gives them -> the columns to keep and those of Facts."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    link = F.when((F.col("type") == "monitor.connection") & F.col("state").isin("waiting", "lost"), F.col("state"))
    named = F.col("host_pid").isNotNull() & F.col("host_started_at_unix_ms").isNotNull()
    news = yes(F.col("signal") == "progress")
    idle = news & yes(F.col("settled"))
    work = scalars.described(F.col("operation"), F.col("operation_filesystem"))
    said = {
        "pid": F.when(named, F.col("host_pid")),
        "started": F.when(named, F.col("host_started_at_unix_ms")),
        "version": F.nullif(F.col("version"), F.lit("")),
        "files": F.when(news, F.col("registry_complete")),
        "idle": idle,
        "news": news,
        "work": F.when(news & ~idle, work),
        "percent": F.when(news & ~idle & work.isNotNull(), scalars.percent(F.col("operation_done"), F.col("operation_total"))),
    }
    flags = ("idle", "news")
    alone = {n: (c & link.isNull()) if n in flags else F.when(link.isNull(), c) for n, c in said.items()}  # a lost feed says nothing else
    return records.select(*keep, link.alias("link"), *(c.alias(n) for n, c in alone.items()))


@dataclass(frozen=True)
class View:
    """What is known of a feed. pid and started name one run of the host; work is what it does, in words."""

    connection: str = "unknown"
    pid: int | None = None
    started: int | None = None
    version: str | None = None
    files: int | None = None
    work: str | None = None
    percent: int | None = None
    busy_since: int | None = None

    def line(self, now: int) -> str | None:
        """The work, once it has lasted long enough."""
        if self.work is None or self.busy_since is None or now - self.busy_since < DWELL_MS:
            return None
        return self.work if self.percent is None else f"{self.work} {self.percent}%"


def changes_run(view: View, said: Facts) -> bool:
    return said.pid is not None and (said.pid, said.started) != (view.pid, view.started)


def after(view: View, said: Facts, at: int) -> View:
    """The view once a record is known. A new run of the host takes over nothing of the old one; a lost feed ends the
    work but not what is known of the host; work that has no words hides the line, and its time goes on counting."""
    old = View() if changes_run(view, said) else view
    still = not said.idle and said.link is None
    since = old.busy_since if old.busy_since is not None or said.work is None else at
    known = lambda new, before: before if new is None else new
    return View(
        connection=known(said.link, view.connection if said.pid is None else "connected"),
        pid=known(said.pid, view.pid),
        started=known(said.started, view.started),
        version=known(said.version, old.version),
        files=known(said.files, old.files),
        work=said.work if said.news or not still else old.work,
        percent=said.percent if said.news or not still else old.percent,
        busy_since=since if still else None,
    )


def folded(records: Iterable[tuple[int, int, Facts]], view: View = View(), last: int = -1) -> Iterator[tuple[int, int, View, str | None]]:
    """(seq, at, facts) -> (seq, at, view, notice) where the view changed. Records not after the last are dropped."""
    for seq, at, said in sorted(records, key=lambda r: r[0]):
        if seq > last:
            last, before, view = seq, view, after(view, said, at)
            if view != before:
                yield seq, at, view, RESTARTED if before.pid is not None and changes_run(before, said) else None


OUTPUT = "feed string, seq long, connection string, pid long, started long, version string, files long, work string, percent long, busy_since long, notice string, line string"
_STATE = "connection string, pid long, started long, version string, files long, work string, percent long, busy_since long, last long"
_NAMES = [x.split()[0] for x in OUTPUT.split(", ")]
_COUNTS = ["seq", "pid", "started", "files", "percent", "busy_since"]


def fold(records: DataFrame, feed: str = "feed") -> DataFrame:
    """records (feed, seq, at_ms, and those of a record) as a stream -> a row for each change of a feed's view.

    Records of a batch are put in the order of seq, within their feed; an older one than the last seen is dropped.
    """

    def plain(value):
        return None if pd.isna(value) else int(value) if isinstance(value, float) else value

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, last = state.get if state.exists else (*astuple(View()), -1)
        view = View(*held)
        rows = [(row.seq, row.at_ms, Facts(*(plain(getattr(row, n)) for n in Facts._fields))) for batch in batches for row in batch.itertuples()]
        out = []
        for seq, at, view, notice in folded(rows, view, last):
            out.append((key[0], seq, *astuple(view), notice, view.line(at)))
        state.update((*astuple(view), max([last, *(r[0] for r in rows)])))
        yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int64" for c in _COUNTS})

    return facts(records, feed, "seq", "at_ms").groupBy(feed).applyInPandasWithState(run, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
