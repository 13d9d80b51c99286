"""Streams whose rows depend on what came before: later blocks that change earlier rows, states that only move on, waits that end by a timer, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.validate import JOB_START, TRANSITIONS

BLOCKED = "run string, origin string, seq long, url string, what string, blocked boolean"


class _Stateful(StatefulProcessor):
    """What the processors share: a timer that is put off by each event, and state that goes when it rings."""

    idle_ms = 0

    def rearmed(self, at_ms: int, timerValues) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class _Blocks(_Stateful):
    """Of an origin of a run: whether it is blocked, the dependencies that aren't yet, and the URLs whose failures don't count."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocked = handle.getValueState("blocked", "yes boolean")
        self.open = handle.getListState("open", "seq long, url string")
        self.ignored = handle.getMapState("ignored", "url string", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        blocked, waiting, out = self.blocked.exists(), [tuple(r) for r in self.open.get()] if self.open.exists() else [], []
        for e in events.itertuples(index=False):
            if e.kind == "block":
                for seq, url in waiting if not blocked else ():
                    out.append((*key, seq, url, "dependency", True))
                    self.ignored.updateValue((url,), (True,))
                blocked, waiting = True, []
            elif e.kind == "dependency":
                out.append((*key, e.seq, e.url, "dependency", blocked))
                if blocked:
                    self.ignored.updateValue((e.url,), (True,))
                else:
                    waiting.append((e.seq, e.url))
            elif e.status >= 400 and not (self.ignored.exists() and self.ignored.containsKey((e.url,))):
                out.append((*key, e.seq, e.url, "failure", blocked))
        if blocked:
            self.blocked.update((True,))
        self.open.clear()
        if waiting:
            self.open.put(waiting)
        self.rearmed(int(events["at"].max()) + self.idle_ms, timerValues)
        yield pd.DataFrame(out, columns=["run", "origin", "seq", "url", "what", "blocked"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.blocked, self.open, self.ignored):
            state.clear()
        yield pd.DataFrame(columns=["run", "origin", "seq", "url", "what", "blocked"])


def _ms(spark, text: str) -> int:
    """The milliseconds of an interval."""
    return spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval '{text}'"))).first()[0]


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))


def blocks(events: DataFrame, late: str, idle: str = "1 hour") -> DataFrame:
    """``(run, origin, seq, url, what, blocked)``: the streaming form of :func:`validate.blocks`. A dependency's row comes again, blocked, once its origin is; the later row holds.

    ``events(run, origin, seq, ts, kind, url, status)`` come in order over triggers. An origin's state holds the dependencies that aren't blocked; it goes when the watermark is ``idle`` past its last event.
    """
    keyed = _timed(events, late).select("run", "origin", "ts", "seq", "kind", "url", F.coalesce("status", F.lit(0)).cast("long").alias("status"), "at")
    return keyed.groupBy("run", "origin").transformWithStateInPandas(_Blocks(_ms(events.sparkSession, idle)), BLOCKED, "Update", "EventTime")


class _Gate(_Stateful):
    """A job's state, which moves on by legal steps alone."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        now, out = self.now.get()[0] if self.now.exists() else JOB_START, []
        for e in events.itertuples(index=False):
            if e.state == now or e.state in TRANSITIONS.get(now, ()):
                now = e.state
                out.append((*key, e.seq, now))
        self.now.update((now,))
        self.rearmed(int(events["at"].max()) + self.idle_ms, timerValues)
        yield pd.DataFrame(out, columns=["job", "seq", "state"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        yield pd.DataFrame(columns=["job", "seq", "state"])


def gated(updates: DataFrame, late: str, idle: str = "1 hour") -> DataFrame:
    """``(job, seq, state)``: the updates that a job's state lets through: its own state again, or one that may follow it. ``updates(job, seq, ts, state)`` come in order over triggers; a job's state goes ``idle`` after its last update, by the watermark."""
    keyed = _timed(updates, late).select(F.col("job").cast("string").alias("job"), "ts", "seq", "state", "at")
    return keyed.groupBy("job").transformWithStateInPandas(_Gate(_ms(updates.sparkSession, idle)), "job string, seq long, state string", "Update", "EventTime")


class _Wait(_Stateful):
    """A job's first event, its last state, and one timer: for the deadline, or for the end of the grace period."""

    def __init__(self, timeout_ms: int, grace_ms: int, terminal: tuple, closing: tuple):
        self.timeout_ms, self.grace_ms, self.terminal, self.closing = timeout_ms, grace_ms, terminal, closing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "since long, state string, extended boolean, over boolean")
        self.later = handle.getListState("later", "at long, seq long, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [(int(e.at), int(e.seq), e.state) for e in pd.concat(list(rows)).itertuples(index=False)]
        if self.waiting.exists() and self.waiting.get()[3]:
            return
        held = [tuple(r) for r in self.later.get()] if self.later.exists() else []
        events = sorted(held + events)
        self.later.clear()
        self.later.put(events)
        since = min(events[0][0], self.waiting.get()[0]) if self.waiting.exists() else events[0][0]
        extended = bool(self.waiting.exists() and self.waiting.get()[2])
        self.waiting.update((since, None, extended, False))
        self.rearmed(since + self.timeout_ms + (self.grace_ms if extended else 0), timerValues)
        yield pd.DataFrame(columns=["job", "outcome", "state", "waited_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, _, extended, over = self.waiting.get()
        events = sorted(tuple(r) for r in self.later.get()) if self.later.exists() else []
        deadline = since + self.timeout_ms
        inside = [e for e in events if e[0] <= deadline]
        ended = next((e for e in inside if e[2] in self.terminal), None)
        last = inside[-1][2] if inside else None
        grace = [e for e in events if deadline < e[0] <= deadline + self.grace_ms]
        late = next((e for e in grace if e[2] in self.terminal), None)
        if ended:
            row = (*key, "done", ended[2], ended[0] - since)
        elif last not in self.closing:
            row = (*key, "timeout", last, self.timeout_ms)
        elif not extended and timerValues.getCurrentWatermarkInMs() < deadline + self.grace_ms:
            self.waiting.update((since, last, True, False))
            self.rearmed(deadline + self.grace_ms, timerValues)
            yield pd.DataFrame(columns=["job", "outcome", "state", "waited_ms"])
            return
        elif late:
            row = (*key, "late", late[2], late[0] - since)
        else:
            row = (*key, "timeout", (grace or inside)[-1][2], self.timeout_ms + self.grace_ms)
        self.later.clear()
        self.waiting.update((since, row[2], True, True))
        yield pd.DataFrame([row], columns=["job", "outcome", "state", "waited_ms"])


def waits(updates: DataFrame, terminal: tuple, closing: tuple, timeout: str, grace: str, late: str) -> DataFrame:
    """``(job, outcome, state, waited_ms)``: what waiting for a job came to, one row when the watermark passes the end of the wait: the streaming form of :func:`validate.waits`.

    ``updates(job, seq, ts, state)`` in any order that ``late`` allows. Until the wait is over a job's updates are held; after it one flag is, which keeps later updates from beginning a new wait.
    """
    spark = updates.sparkSession
    keyed = _timed(updates, late).select(F.col("job").cast("string").alias("job"), "ts", "seq", "state", "at")
    processor = _Wait(_ms(spark, timeout), _ms(spark, grace), terminal, closing)
    return keyed.groupBy("job").transformWithStateInPandas(processor, "job string, outcome string, state string, waited_ms long", "Update", "EventTime")


def distinct_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event to arrive of each key, among those within ``late`` of each other; state is kept no longer than that."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
