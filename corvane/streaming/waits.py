"""Waiting on a feed: by the edge, as lines arrive, or by the level, from the state there is."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

X = TypeVar("X")


def outcomes(records: DataFrame, by: str, order: list[str], success: Column, failure: Column, alerts: Column | None = None) -> DataFrame:
    """by, outcome and the order columns of the first record of each run that settles a wait.

    Alerts are filtered before anything is matched. A record that matches both is a failure. Runs that never match
    are absent. Only the least record of a run is kept while aggregating, so nothing is sorted.
    """
    held = records if alerts is None else records.filter(alerts)
    outcome = F.when(failure, "failed").when(success, "met")
    first = held.withColumn("outcome", outcome).filter("outcome is not null").groupBy(by).agg(F.min(F.struct(*order, "outcome")).alias("x"))
    return first.select(by, *(F.col(f"x.{c}").alias(c) for c in order), F.col("x.outcome").alias("outcome"))


def matching(records: DataFrame, success: Column, failure: Column, alerts: Column | None = None) -> DataFrame:
    """The streaming form: the records that settle a wait, as they arrive."""
    held = records if alerts is None else records.filter(alerts)
    return held.withColumn("outcome", F.when(failure, "failed").when(success, "met")).filter("outcome is not null")


def current(records: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """by, value of the latest record of each run: what a level-triggered wait looks at."""
    return records.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(value))


def timed_out(condition_met: bool | None) -> str:
    """A wait that ran out of time: with a condition it failed, and a bare timeout is what was asked for."""
    return {None: "elapsed", True: "met", False: "failed"}[condition_met]


def wait(look: Callable[[], bool] | None, timeout_s: float, every_s: float = 0.05) -> str:
    """Look until it is true or the time is over."""
    until = time.monotonic() + timeout_s
    while True:
        if look is not None and look():
            return "met"
        if time.monotonic() >= until:
            return timed_out(None if look is None else False)
        time.sleep(min(every_s, max(0.0, until - time.monotonic())))


#: Levels of readiness from the least on.
READINESS = ("unknown", "discovered", "indexed", "searchable", "complete")


def readiness(records: DataFrame, by: str, order: list[str], level: Column, reset: Column) -> DataFrame:
    """records with level so far: within a run it never falls, except that a reset begins anew."""
    w = W.partitionBy(by).orderBy(*order)
    begun = F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = records.withColumn("__n", begun).withColumn("__l", level)
    return rows.withColumn("level", F.max("__l").over(W.partitionBy(by, "__n").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))).drop("__n", "__l")


def milestones(records: DataFrame, by: str, milestone: str, at: str) -> DataFrame:
    """by, milestone and when it was first reached."""
    return records.groupBy(by, milestone).agg(F.min(at).alias(at))


def retried(attempts: DataFrame, by: str, order: list[str], state: str, digest: str) -> DataFrame:
    """attempts with due: a failed one is due again only when the content has changed since; a deferred one always is."""
    before = F.lag(F.struct(state, digest)).over(W.partitionBy(by).orderBy(*order))
    due = F.when(before.isNull() | (before[state] == "deferred"), True).when(before[state] == "failed", ~before[digest].eqNullSafe(F.col(digest))).otherwise(~before[digest].eqNullSafe(F.col(digest)))
    return attempts.withColumn("due", due)


def only_result(events: Iterable[tuple[str, Any]], progress: Callable[[Any], None] = lambda _: None) -> Any:
    """The one result of a call that reports progress first; none, or a second, is an error."""
    results = []
    for kind, value in events:
        if results:
            raise ValueError(f"{kind} after the result")
        if kind == "progress":
            progress(value)
        elif kind == "result":
            results.append(value)
        else:
            raise ValueError(f"unknown event {kind}")
    if not results:
        raise ValueError("the call ended without a result")
    return results[0]


@dataclass
class Stale:
    """A value that is served at once while it is fresh or being refreshed, and refreshed when it is old."""

    load: Callable[[], Any]
    fresh_s: float = 300.0
    clock: Callable[[], float] = time.monotonic
    value: Any = None
    at: float | None = None

    def get(self) -> tuple[Any, bool]:
        """(value, whether a refresh is due). The first call has to load."""
        if self.at is None:
            self.refresh()
        return self.value, self.clock() - self.at > self.fresh_s

    def refresh(self) -> None:
        """An attempt that fails leaves the last value in place."""
        try:
            self.value, self.at = self.load(), self.clock()
        except Exception:
            if self.at is None:
                raise


def latest_answers(remotes: DataFrame, answers: DataFrame, before: DataFrame, name: str = "name") -> DataFrame:
    """name, state, reason of every remote: its new answer, else the last one, else checking."""
    new = answers.select(name, F.col("state").alias("__s"), F.col("reason").alias("__r"))
    old = before.select(name, F.col("state").alias("__os"), F.col("reason").alias("__or"))
    rows = remotes.select(name).distinct().join(new, name, "left").join(old, name, "left")
    answered = F.col("__s").isNotNull()
    return rows.select(name, F.coalesce("__s", "__os", F.lit("checking")).alias("state"), F.when(answered, F.col("__r")).otherwise(F.col("__or")).alias("reason"))
