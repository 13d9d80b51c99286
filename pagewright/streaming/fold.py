"""Streams of network events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "hop int, url string, status long, mime_type string, state string, seen long"
OUTPUT = "id string, url string, state string, status long, mime_type string"
DEFAULT_TYPE = "application/octet-stream"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    """One request's events in order; each change of a hop gives a row with the hop's state so far."""
    session, request = key
    if held.hasTimedOut:
        held.remove()
        return
    hop, url, status, mime, state, seen = held.get if held.exists else (-1, None, None, None, None, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    out: dict[str, tuple] = {}

    def shown() -> None:
        name = f"{session}:{request}:{hop}"
        out[name] = (name, url, state, int(status or 0), mime or DEFAULT_TYPE)

    for e in rows.itertuples(index=False):
        if e.kind == "request":
            if hop >= 0 and not pd.isna(e.redirect_status):
                status, state = int(e.redirect_status), "complete"
                shown()
            hop = hop + 1 if hop < 0 or not pd.isna(e.redirect_status) else hop
            url, status, mime, state = e.url, None, None, "request"
        elif hop < 0:
            continue  # nothing is known of a request before its first event
        elif e.kind == "response":
            status, mime, state = None if pd.isna(e.status) else int(e.status), e.mime_type, "response"
        else:
            state = "complete" if e.kind == "finished" else "failed"
        shown()
    if "kept_until" in rows:
        seen = max(seen, int(rows["kept_until"].max()))
    held.update((hop, url, status, mime, state, seen))
    if "kept_until" in rows:
        held.setTimeoutTimestamp(max(seen, held.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(list(out.values()), columns=["id", "url", "state", "status", "mime_type"])


def folded(events: DataFrame, late: str | None = None, idle: str = "1 hour") -> DataFrame:
    """The streaming form of the batch fold: rows of changed hops, the last of an id being its state.

    Keyed by session and request, so state is one hop's fields for each request. With ``late``, events have a time ``ts``: those later than that are dropped, and a request's state goes once ``idle`` has passed after its last event, by the
    watermark; without it state is kept until the query ends. Events of one request must come in order over triggers; within a trigger they are sorted by ``seq``.
    """
    keyed = events.withColumn("session", F.coalesce("session_id", F.lit("root")))
    if late is None:
        return keyed.groupBy("session", "request_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
    timed = keyed.withColumn("kept_until", F.unix_millis(F.col("ts") + F.expr(f"interval '{idle}'"))).withWatermark("ts", late)
    return timed.groupBy("session", "request_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def late_bodies(requests: DataFrame, bodies: DataFrame, late: str = "10 minutes", within: str = "5 minutes") -> DataFrame:
    """``(session, request_id, url, sha256)``: requests with the bodies that arrive after them, within ``within``; a request whose body doesn't come has a null, once the watermarks have passed its time. A stream-stream join whose state both watermarks bound.

    ``requests(session, request_id, url, ts)``, ``bodies(session, request_id, sha256, body_ts)``.
    """
    a, b = requests.withWatermark("ts", late).alias("a"), bodies.withWatermark("body_ts", late).alias("b")
    on = F.expr(f"a.session = b.session and a.request_id = b.request_id and b.body_ts >= a.ts and b.body_ts <= a.ts + interval '{within}'")
    return a.join(b, on, "leftOuter").select("a.session", "a.request_id", "a.url", "b.sha256")


def quiet_network(events: DataFrame, late: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """``(session, start, end, opened, closed, quiet)`` for windows of a session's events: quiet where as many requests closed as opened. ``events(session, kind, ts)``."""
    found = events.withWatermark("ts", late).groupBy("session", F.window("ts", window).alias("w")).agg(
        F.count_if(F.col("kind") == "opened").alias("opened"), F.count_if(F.col("kind") == "closed").alias("closed")
    )
    return found.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "opened", "closed", (F.col("opened") == F.col("closed")).alias("quiet"))


def quiet_windows(events: DataFrame, quiet: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(user_id, start, end, n)``: sessions that end after ``quiet`` without an event; events later than the watermark are dropped."""
    window = F.session_window("ts", quiet)
    found = events.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
