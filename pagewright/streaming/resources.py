"""Network events to resources on a stream, in whatever order the events arrive.

What the watermark has passed is settled into one small state for each request. Events that it hasn't passed wait in a list and are folded onto that state at each
trigger with events of the request, so an event that comes late moves what follows it. A timer drops a request's state once it has been quiet.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.capture import DEFAULT_TYPE, EVIDENCE

#: Buckets of requests: some milliseconds of a trigger each, whatever they hold.
BUCKETS = 2048
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAGS = ", ".join(f"{c} boolean" for c in EVIDENCE)
OUTPUT = f"session string, request_id string, hop long, version long, present boolean, url string, state string, status long, mime_type string, request_extra boolean, response_extra boolean, {FLAGS}, extra_status long, ambiguous boolean"
NEW = {"hop": 0, "row": None, "parked": [], "shown": [], "version": 0}


def _told(row: dict, e: dict) -> None:
    """Adds the evidence of an extra event."""
    side = e["kind"]
    row["ambiguous"] = row["ambiguous"] or row[side]
    row[side] = True
    for c in EVIDENCE:
        row[c] = row[c] or bool(e.get(c))
    found = e.get("extra_status") if side == "response_extra" else None
    if found is not None and row["extra_status"] is not None and found != row["extra_status"]:
        row["ambiguous"] = True
    elif found is not None:
        row["extra_status"] = found


def stepped(state: dict, e: dict) -> dict[int, dict]:
    """Moves the state on by one event and returns the hops that it changes."""
    changed, row, kind = {}, state["row"], e["kind"]
    if kind == "request":
        if e.get("redirect_status") is not None:
            if row:
                row.update(state="complete", status=e["redirect_status"], mime_type=DEFAULT_TYPE)
                changed[state["hop"]] = row
            state["hop"] += 1
        row = {"url": e.get("url"), "state": "discovered", "status": 0, "mime_type": DEFAULT_TYPE, "request_extra": False, "response_extra": False, "extra_status": None, "ambiguous": state["hop"] > 0}
        row |= dict.fromkeys(EVIDENCE, False)
        for early in state["parked"]:
            _told(row, early)
        state.update(row=row, parked=[])
    elif row is None:
        if kind.endswith("_extra"):
            state["parked"].append(e)
        return changed
    elif kind.endswith("_extra"):
        _told(row, e)
    elif kind == "response":
        row.update(state="response", status=e.get("status") or 0, mime_type=e.get("mime_type") or DEFAULT_TYPE)
        for c in EVIDENCE:
            row[c] = row[c] or (c in ("has_set_cookie", "private_or_no_store", "varies_by_credential") and bool(e.get(c)))
    else:
        row["state"] = "complete" if kind == "finished" else "failed"
    changed[state["hop"]] = row
    return changed


def moved(entry: dict, events: list[dict], watermark: int, idle_ms: int) -> tuple[dict[int, dict], list[int]]:
    """Takes the new events of a request into its entry (state, waiting, due); the rows of the hops that they change, and the hops that are gone."""
    state, parsed = entry["state"], sorted(entry["waiting"] + events, key=lambda e: e["seq"])
    n = next((i for i, e in enumerate(parsed) if e["at"] > watermark * 1000), len(parsed))
    changed: dict[int, dict] = {}
    for e in parsed[:n]:
        changed |= stepped(state, e)
    changed = {h: dict(row) for h, row in changed.items()}
    ahead = state | {"row": state["row"] and dict(state["row"]), "parked": list(state["parked"])}
    for e in parsed[n:]:
        changed |= stepped(ahead, e)
    settled = state["row"] is not None
    gone = [h for h in state["shown"] if (h > state["hop"] or not settled) and h not in changed]  # a hop that waited and has moved on
    state["version"] += 1
    state["shown"] = sorted(h for h in changed if h > state["hop"] or not settled)
    entry.update(waiting=parsed[n:], due=max(max(e["at"] for e in parsed) // 1000 + idle_ms, watermark + 1))
    return changed, gone


class ResourceFold(StatefulProcessor):
    """Requests are kept by bucket, a value and a timer each: a request takes no round trip to the state store and no data frame of its own. A value is
    what is settled of each of its requests and what waits for the watermark, and is written whole where one of them moves."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "requests string")

    def _entries(self) -> dict[tuple, dict]:
        return {(e["session"], e["request_id"]): e for e in json.loads(self.held.get()[0])} if self.held.exists() else {}

    def _keep(self, entries: dict[tuple, dict]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not entries:
            self.held.clear()
            return
        self.held.update((json.dumps(list(entries.values()), separators=(",", ":")),))
        self.handle.registerTimer(min(e["due"] for e in entries.values()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, entries = timerValues.getCurrentWatermarkInMs(), self._entries()
        fresh: dict[tuple, list[dict]] = {}
        for batch in rows:
            events = json.loads(f"[{','.join(batch['event'])}]")
            for session, request, e in zip(batch["session"].tolist(), batch["request_id"].tolist(), events, strict=True):
                fresh.setdefault((session, request), []).append(e)
        out = []
        for own, events in fresh.items():
            entry = entries.setdefault(own, {"session": own[0], "request_id": own[1], "state": NEW | {"parked": [], "shown": []}, "waiting": []})
            changed, gone = moved(entry, events, watermark, self.idle_ms)
            version = entry["state"]["version"]
            out += [(*own, h, version, True, *[row[c] for c in COLUMNS]) for h, row in changed.items()]
            out += [(*own, h, version, False, *[None] * len(COLUMNS)) for h in gone]
        self._keep({own: e for own, e in entries.items() if own in fresh or e["due"] > watermark})
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._keep({own: e for own, e in self._entries().items() if e["due"] > watermark})
        yield _frame([])

    def close(self) -> None:
        pass


COLUMNS = ["url", "state", "status", "mime_type", "request_extra", "response_extra", *EVIDENCE, "extra_status", "ambiguous"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Objects, so that whole numbers stay whole beside nulls."""
    return pd.DataFrame(rows, columns=["session", "request_id", "hop", "version", "present", *COLUMNS], dtype=object)


def folded(events: DataFrame, late: str, idle: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The streaming form of :func:`capture.resources`: rows of changed hops, of which the one of the highest version holds; ``present`` is false for a hop that an earlier event has moved away.

    ``events`` as there, with a time ``ts`` that rises with ``seq``. Events may come in any order that ``late`` allows; later ones are dropped. The state of a request goes once the watermark is ``idle`` past its last event. A null session
    is root. Requests are kept in ``buckets`` by a hash, of which a trigger writes those that it has events for; streams of many millions of live requests ask for more. The stream needs the state store that keeps timers (ROCKSDB).
    """
    micros, kind = F.unix_micros("ts").alias("at"), F.col("kind")
    # What no step looks at for such an event, and flags that are not set, need not be kept.
    asked = {"request": ["url", "redirect_status"], "response": ["status", "mime_type"], "response_extra": ["extra_status"]}
    fields = [F.when(kind == k, F.col(c)).alias(c) for k, names in asked.items() for c in names]
    flags = [F.when(F.col(c) & (F.endswith(kind, F.lit("_extra")) | (kind == "response")), True).alias(c) for c in EVIDENCE]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    keyed = timed.select(F.coalesce("session_id", F.lit("root")).alias("session"), "request_id", "ts", F.to_json(F.struct("kind", "seq", *fields, *flags, micros)).alias("event"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("session", "request_id"), F.lit(buckets)))
    millis = F.expr(f"interval '{idle}'")
    idle_ms = events.sparkSession.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + millis)).first()[0]
    return keyed.groupBy("bucket").transformWithStateInPandas(ResourceFold(idle_ms), OUTPUT, "Update", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """The table that the rows of :func:`folded` amount to."""
    last = changes.groupBy("session", "request_id", "hop").agg(F.max_by(F.struct("present", *COLUMNS), "version").alias("r")).where("r.present")
    return last.select("session", "request_id", "hop", *[f"r.{c}" for c in COLUMNS])
