"""Keyed state with timers: rows are taken in the order of their event time, and what is over ends by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How long a section is held for its session, and for how many sessions of a host.
HELD_MS, SESSIONS = 3_600_000, 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Rows wait in a list until the watermark has passed their time; then no earlier one can come, and ``take`` gets
    them in order. ``wake`` says when the key wants to be looked at next without a row. Times are microseconds."""

    #: Of a waiting row: its time, and what decides between rows of one time and is needed of it.
    row = "at long, seq long"
    out = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.names = [x.split()[0] for x in self.out.split(", ")]
        self.columns = [x.split()[0] for x in self.row.split(", ")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            new = list(zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in self.columns), strict=True))
            self.waiting.appendList(new)
            least = min([x[0] for x in new] + ([least] if least is not None else []))
        if least is not None:
            self._at(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, later = sorted(x for x in rows if x[0] <= now), [x for x in rows if x[0] > now]
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        told = self.take(key, due, now)
        nexts = [x for x in (min((x[0] for x in later), default=None), self.wake()) if x is not None]
        if nexts:
            self._at(min(nexts))
        if told:
            yield pd.DataFrame([(*key, *x) for x in told], columns=self.names)

    def _at(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass

    def take(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        raise NotImplementedError

    def wake(self) -> int | None:
        return None


def run(rows: DataFrame, by: list[str], processor: InOrder) -> DataFrame:
    """A stream with a watermark -> what the processor returns; state lies in RocksDB, which timers need."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER, ""):
        conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(*by).transformWithStateInPandas(processor, processor.out, "append", "EventTime")


class _Leases(InOrder):
    """One value a client: its lease, which ends by a timer when no beat has come within the timeout."""

    def __init__(self, client: str, timeout: int):
        self.timeout, self.out, self.row = timeout, f"{client}, began long, ended long, beats long", "at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lease = handle.getValueState("lease", "began long, last long, beats long")

    def take(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        held, over = tuple(self.lease.get()) if self.lease.exists() else None, []
        for (at,) in rows:
            if held and at <= held[1] + self.timeout:
                held = (held[0], at, held[2] + 1)
            else:
                over += [held] if held else []
                held = (at, at, 1)
        if held and held[1] + self.timeout <= now:
            over.append(held)
            held = None
        if held:
            self.lease.update(held)
        elif self.lease.exists():
            self.lease.clear()
        return [(began, last + self.timeout, beats) for began, last, beats in over]

    def wake(self) -> int | None:
        return self.lease.get()[1] + self.timeout if self.lease.exists() else None


def leases(beats: DataFrame, client: str, at: str, timeout_s: int) -> DataFrame:
    """client, began, ended, beats of each lease that is over, as leases.leases() finds them in a table.

    ``beats`` has a watermark on ``at``. A lease is told as soon as the watermark passes its end, without waiting for
    another beat of its client; a beat at that very end still keeps it, as in session windows. A client's state is its lease and the beats that the watermark has not reached.
    """
    kind = beats.schema[client].dataType.simpleString()
    rows = beats.select(client, at, F.unix_micros(at).alias("at"))
    return run(rows, [client], _Leases(f"{client} {kind}", timeout_s * 1_000_000)).select(client, F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "beats")


class _Held(InOrder):
    """A map from session to its sections, with the order in which sessions were last added to."""

    row = "at long, seq long, session string, run string, section string, take boolean"

    def __init__(self, host: str, hold: int, sessions: int):
        self.hold, self.sessions, self.out = hold, sessions, f"{host}, seq long, session string, sections string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "session string", "turn long, run array<string>, section array<string>, at array<long>")

    def take(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        held = {k[0]: [v[0], list(zip(v[1], v[2], v[3], strict=True))] for k, v in self.held.iterator()}
        before, told = set(held), []
        turn = max((x[0] for x in held.values()), default=0)
        for at, seq, session, of, section, taken in rows:
            if taken:
                mine = held.pop(session, (0, []))[1]
                fresh = [x[1] for x in mine if x[0] == of and at - x[2] < self.hold]
                told.append((seq, session, "\n\n".join(fresh) if fresh else None))
                continue
            turn += 1
            own = held.setdefault(session, [turn, []])
            own[0] = turn
            own[1].append((of, section, at))
            if len(held) > self.sessions:
                del held[min(held, key=lambda k: held[k][0])]
        for session, (_, entries) in list(held.items()):
            entries[:] = [x for x in entries if now - x[2] < self.hold]
            if not entries:
                del held[session]
        for session in before - set(held):
            self.held.removeKey((session,))
        for session, (n, entries) in held.items():
            self.held.updateValue((session,), (n, *(list(c) for c in zip(*entries, strict=True))))
        self.oldest = min((x[2] for _, entries in held.values() for x in entries), default=None)
        return told

    def wake(self) -> int | None:
        return None if self.oldest is None else self.oldest + self.hold


def held_sections(actions: DataFrame, host: str, at: str, seq: str, session: Column, of: Column, section: Column, take: Column, hold_ms: int = HELD_MS, sessions: int = SESSIONS) -> DataFrame:
    """host, seq, session, sections of each take: what its session was given for the same run and not yet taken.

    A take empties its session. Sections older than ``hold_ms`` are not delivered, and a timer removes them; of more than
    ``sessions`` sessions of a host, the one that was longest not added to goes. ``actions`` has a watermark on ``at``.
    """
    kind = actions.schema[host].dataType.simpleString()
    rows = actions.select(host, at, F.unix_micros(at).alias("at"), F.col(seq).cast("long").alias("seq"), session.cast("string").alias("session"), of.cast("string").alias("run"), section.alias("section"), take.alias("take"))
    return run(rows, [host], _Held(f"{host} {kind}", hold_ms * 1000, sessions))


def pairs_within(first: DataFrame, second: DataFrame, by: str, at: str, seq: str, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """by, first and second (their seq), first_at, second_at: each row of ``second`` with those of ``first`` of the same key in the time before it.

    Both are streams; a row that comes again with its seq within the watermark's delay counts once. Rows are held
    until the other side's watermark has passed the time in which they can still meet one, and no longer.
    """
    once = lambda rows, name: rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([seq]).select(F.col(by).alias(f"{name}_by"), F.col(at).alias(f"{name}_at"), F.col(seq).alias(name))
    a, b = once(first, "first"), once(second, "second")
    near = (F.col("second_at") >= F.col("first_at")) & (F.col("second_at") <= F.col("first_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, (F.col("first_by") == F.col("second_by")) & near).select(F.col("first_by").alias(by), "first", "second", "first_at", "second_at")
