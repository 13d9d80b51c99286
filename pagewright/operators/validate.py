"""Results of validation runs: statuses, scores, evidence by action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, urls


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def summary(resources: DataFrame, *keys: str) -> DataFrame:
    """Counts by status and bytes, for each of ``keys``; a null size is none."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "downloaded", "failed", "skipped", "cancelled")]
    return resources.groupBy(*keys).agg(F.count("*").alias("total"), *counts, F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def mirror_status(statuses: Column) -> Column:
    """Of an array of resource statuses: cancelled, complete, partial or failed; an empty one is complete."""
    some = lambda s: F.exists(statuses, lambda x: x == s)
    incomplete = F.exists(statuses, lambda x: x != "downloaded")
    return F.when(some("cancelled"), "cancelled").when(~incomplete, "complete").when(some("downloaded"), "partial").otherwise("failed")


def run_status(r) -> Column:
    """failed, partial or complete, of a column getter over the run's figures."""
    blank = r("canvas_checked") & ~r("canvas_truncated") & (r("canvas_inspected") > 0) & (r("canvas_non_empty") == 0) & (r("canvas_unreadable") == 0)
    failed = r("runner_error") | ~r("entry_ok") | (r("page_errors") > 0) | (r("blocking_console_errors") > 0) | (r("dropped_blocking") > 0) | blank
    partial = (
        (r("http_failures") > 0) | (r("remote") > 0) | ~r("screenshot_passed") | (r("canvas_checked") & ~r("canvas_passed")) | r("canvas_truncated")
        | (r("interactions_checked") & ~r("interactions_passed")) | (r("perceptual_checked") & ~r("perceptual_passed")) | r("diagnostics_truncated") | (r("recoverable_errors") > 0)
    )
    return F.when(failed, "failed").when(partial, "partial").otherwise("complete")


def score(r) -> Column:
    """Completeness from 0 to 100, of a column getter over the run's figures; similarity is the mean over compared checkpoints, null for none."""
    visual = F.when(r("perceptual_checked"), half_up(10 * F.coalesce(r("similarity"), F.lit(0.0)))).otherwise(
        F.when(r("screenshot_passed"), 5).otherwise(0)
        + F.when(r("canvas_checked"), F.when(r("canvas_passed"), 5).when(r("canvas_unreadable") > 0, 2).otherwise(0)).otherwise(0)
    )
    done = F.when(r("actions") == 0, F.when(r("interactions_passed"), 1.0).otherwise(0.0)).otherwise(r("completed") / F.greatest(r("actions"), F.lit(1)))
    interaction = F.when(r("interactions_checked"), half_up(10 * done)).otherwise(10)
    runtime = F.when((r("page_errors") == 0) & (r("blocking_console_errors") == 0), 15).otherwise(0)
    total = 25 + F.greatest(F.lit(0), 25 - 5 * r("http_failures")) + runtime + F.greatest(F.lit(0), 15 - 5 * r("remote")) + visual + interaction
    status = run_status(r)
    capped = F.when(status == "failed", F.least(F.lit(59), total)).when(status == "partial", F.least(F.lit(99), total)).otherwise(100)
    return F.when(~r("entry_ok"), 0).otherwise(capped).cast("long")


def after_failure(actions: DataFrame) -> DataFrame:
    """``actions(run_id, idx, status)`` with those after a run's first failed one marked skipped."""
    before = Window.partitionBy("run_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((F.col("status") == "failed").cast("int")).over(before), F.lit(0)) == 1
    return actions.withColumn("status", F.when(failed, "skipped").otherwise(F.col("status")))


def action_slices(actions: DataFrame, events: DataFrame) -> DataFrame:
    """``(run_id, idx, n_events, n_errors)``: events from an action's start up to the next one's, by sequence number. Actions have ``start``, events ``seq`` and ``kind``.

    An action's interval ends where the next begins, so an as-of lookup over the union of both finds each event's action without a range join.
    """
    both = actions.select("run_id", F.col("start").alias("at"), F.lit(0).alias("o"), "idx", F.lit(None).cast("string").alias("kind")).unionByName(
        events.select("run_id", F.col("seq").alias("at"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("idx"), "kind")
    )
    last = F.last("idx", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("of", last).where("of is not null")
    return rows.groupBy("run_id", F.col("of").alias("idx")).agg(F.count_if(F.col("o") == 1).alias("n_events"), F.count_if(F.col("kind") == "error").alias("n_errors"))


def merged_remote(rows: DataFrame) -> DataFrame:
    """Remote dependencies by reason and URL: flags joined by or, a type that is no proxy's preferred, the first method."""
    plain = F.when(~F.col("resource_type").startswith("proxy-"), F.col("resource_type"))
    return rows.groupBy("reason", "url").agg(
        F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"),
        F.coalesce(F.min_by(plain, F.when(plain.isNotNull(), F.col("seq"))), F.min_by("resource_type", "seq")).alias("resource_type"),
        F.min_by("method", F.when(F.col("method").isNotNull(), F.col("seq"))).alias("method"),
    )


# From each job state, the states that may follow.
_RUNNING = "created preflight attaching discovering downloading localizing starting_preview fast_validating ready deep_validating".split()
JOB_EDGES = [
    ("created", "preflight"), ("preflight", "attaching"), ("attaching", "discovering"), ("discovering", "downloading"), ("downloading", "localizing"),
    ("localizing", "starting_preview"), ("starting_preview", "fast_validating"), ("fast_validating", "ready"), ("fast_validating", "partial"),
    ("ready", "deep_validating"), ("ready", "complete"), ("ready", "partial"), ("deep_validating", "complete"), ("deep_validating", "partial"),
    ("complete", "downloading"), ("complete", "fast_validating"), ("partial", "downloading"), ("partial", "fast_validating"),
    ("cancelling", "complete"), ("cancelling", "partial"), ("cancelling", "cancelled"), ("cancelling", "failed"),
    *((s, t) for s in _RUNNING for t in ("cancelling", "failed")),
]


def illegal_transitions(transitions: DataFrame) -> DataFrame:
    """``(job_id, seq, before, state)``: changes of state that the job edges don't have; a job's first state should be created."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("seq"))
    rows = transitions.withColumn("before", before)
    legal = rows.sparkSession.createDataFrame(JOB_EDGES, "before string, state string")
    first = rows.where("before is null and state <> 'created'")
    rest = rows.where("before is not null").join(F.broadcast(legal), ["before", "state"], "left_anti")
    return first.select("job_id", "seq", "before", "state").unionByName(rest.select("job_id", "seq", "before", "state"))


def progress(rows: DataFrame, key: str, finished: str) -> DataFrame:
    """Counts of a job's finished resources and their bytes; ``completed`` is what was reported, at most what is finished."""
    done = F.col("status").isin("downloaded", "failed", "skipped", "cancelled")
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy(key).agg(
        F.count("*").alias("total"), F.least(F.max(finished), F.count_if(done)).alias("completed"), *[count(s) for s in ("downloaded", "failed", "skipped", "cancelled")],
        F.sum(F.when(done, F.coalesce("size", F.lit(0))).otherwise(0)).alias("bytes"),
    )


def job_status(statuses: Column, online: Column) -> Column:
    """A job's status from its resources' and the number of dependencies that stay online."""
    some = lambda *s: F.arrays_overlap(statuses, F.array(*[F.lit(x) for x in s]))
    open_ = (online > 0) | some("failed", "skipped", "pending")
    return F.when(some("cancelled"), "cancelled").when(~open_, "complete").when(some("downloaded"), "partial").otherwise("failed")


def downgraded(status: Column, *counts: Column) -> Column:
    """complete is partial if anything was warned of or stays online."""
    return F.when((status == "complete") & (F.greatest(F.lit(0), *counts) > 0), "partial").otherwise(status)


def canvases(details: DataFrame, key: str, omitted: str) -> DataFrame:
    """A run's canvases by outcome; it passed if one has something on it, or if none applies and none was left out."""
    count = lambda s, name: F.count_if(F.col("outcome") == s).alias(name)
    out = details.groupBy(key).agg(
        F.count_if(F.col("outcome") != "skipped").alias("inspected"), count("non-empty", "non_empty"), count("empty", "empty"), count("unreadable", "unreadable"), (F.max(omitted) > 0).alias("truncated")
    )
    return out.withColumn("passed", (F.col("non_empty") > 0) | (~F.col("truncated") & (F.col("inspected") == 0)))


def finite_sets(rows: DataFrame, key: str, name: str, value: str, most: int = 64) -> DataFrame:
    """``(key, name, values)``: the first ``most`` distinct values, sorted; a set of more is cut, which ``complete`` says. Values are counted before any is gathered."""
    distinct = rows.select(key, name, value).where(F.col(value).isNotNull()).distinct()
    ranked = distinct.withColumn("_n", F.row_number().over(Window.partitionBy(key, name).orderBy(value)))
    return ranked.where(F.col("_n") <= most + 1).groupBy(key, name).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(value)))), " ").alias("values"), (F.max("_n") <= most).alias("complete")
    )


def remote_class(url: Column, local: Column, source: Column, allowed: Column, blocked: Column) -> Column:
    """``{reason, allowed, blocked}`` of a request to another origin than the preview's; null for one to it, to trackers and the like, and to what is no network.

    ``allowed`` and ``blocked`` are arrays of origins; sockets count as the web origins that they are.
    """
    web = F.regexp_replace(F.regexp_replace(url, "(?i)^wss:", "https:"), "(?i)^ws:", "http:")

    def of(u: urls.Parts) -> Column:
        origin = urls.origin(u)
        reason = F.when(origin == source, "source-origin").otherwise("unexpected-remote")
        found = F.struct(reason.alias("reason"), F.array_contains(allowed, origin).alias("allowed"), F.array_contains(blocked, origin).alias("blocked"))
        return F.when(origin.isNotNull() & (origin != local) & ~classify.is_nonessential(u), found)

    return urls._of(web, of)


def ignores_failure(url: Column, method: Column, error: Column, navigation: Column, local: Column, blocked: Column) -> Column:
    """Whether a failed request says nothing: to trackers, to no network, an aborted read of the preview's own, or another origin's that was blocked on purpose."""
    web = F.regexp_replace(F.regexp_replace(url, "(?i)^wss:", "https:"), "(?i)^ws:", "http:")

    def of(u: urls.Parts) -> Column:
        own = F.coalesce(urls.origin(u) == local, F.lit(False))
        aborted = own & ~F.coalesce(navigation, F.lit(False)) & method.isin("GET", "HEAD") & (F.lower(F.trim(error)) == "net::err_aborted")
        stopped = u["web"] & ~own & (F.lower(error).contains("blocked_by_client") | F.coalesce(blocked, F.lit(False)))
        other = (u["scheme"] != "") & ~u["scheme"].isin("http", "https")
        return classify.is_nonessential(u) | other | aborted | stopped

    return F.coalesce(urls._of(web, of), F.lit(False))


# Network errors of a source that pass.
TRANSIENT_ERRORS = ["CONNECTION_ABORTED", "CONNECTION_CLOSED", "CONNECTION_RESET", "HTTP2_PROTOCOL_ERROR", "NETWORK_CHANGED", "QUIC_PROTOCOL_ERROR", "TIMED_OUT"]
#: The path that stands for a script which the mirror lacks.
UNAVAILABLE = "/.preview/unavailable.js"


def is_transient(message: Column) -> Column:
    found = F.regexp_extract_all(message, F.lit(r"net::ERR_([A-Z0-9_]+)"), 1)
    return F.coalesce(F.arrays_overlap(found, F.array(*[F.lit(e) for e in TRANSIENT_ERRORS])), F.lit(False))


def loopback_class(url: Column) -> Column:
    """unavailable (the stand-in for a script), loopback, external, or null for what is no network address."""
    web = F.regexp_replace(F.regexp_replace(url, "(?i)^wss:", "https:"), "(?i)^ws:", "http:")
    six = F.lower(url).rlike(r"^(https?|wss?)://\[(::1|0:0:0:0:0:0:0:1)\]")

    def of(u: urls.Parts) -> Column:
        near = six | (u["host"] == "localhost") | u["host"].endswith(".localhost") | u["host"].rlike(r"^127(\.[0-9]{1,3}){3}$")
        reaches = six | (u["scheme"].isin("http", "https") & (u["host"] != ""))
        return F.when(reaches & near & (u["path"] == UNAVAILABLE), "unavailable").when(reaches & near, "loopback").when(reaches, "external")

    return urls._of(web, of)


JOB_START = "created"
TRANSITIONS = {a: [t for s, t in JOB_EDGES if s == a] for a in dict.fromkeys(s for s, _ in JOB_EDGES)}


def accepted_updates(events: DataFrame, key: str) -> DataFrame:
    """``events(key, seq, state)`` with ``accepted``: whether an update's state follows, or is, that of the last one accepted; a job begins as created. One job's updates are folded in order."""
    legal = F.create_map(*[x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "state")))

    def step(a: Column, e: Column) -> Column:
        ok = F.coalesce((a["now"] == e["state"]) | F.array_contains(F.try_element_at(legal, a["now"]), e["state"]), F.lit(False))
        return F.struct(F.when(ok, e["state"]).otherwise(a["now"]).alias("now"), F.when(ok, F.concat(a["seqs"], F.array(e["seq"]))).otherwise(a["seqs"]).alias("seqs"))

    start = F.struct(F.lit("created").alias("now"), F.array().cast("array<bigint>").alias("seqs"))
    kept = events.groupBy(key).agg(ordered.alias("e")).select(key, F.explode(F.aggregate("e", start, step, lambda a: a["seqs"])).alias("seq"), F.lit(True).alias("_ok"))
    return events.join(kept, [key, "seq"], "left").select(*events.columns, F.coalesce("_ok", F.lit(False)).alias("accepted"))


MOST_EVENTS, MOST_EVENT_BYTES, EVENT_OVERHEAD = 64, 64 * 1024, 24


def recorded_events(events: DataFrame) -> DataFrame:
    """``events(run, seq, category, text)`` with ``recorded``: the first MOST_EVENTS of a category, as long as a run's texts and their overhead fit in MOST_EVENT_BYTES.

    One that is too long is passed over and later ones may fit, so a run's events are gone through in order by one task; those beyond a category's limit by
    number are out before.
    """
    import pandas as pd

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, used, n, out = part.sort_values("seq", kind="stable"), 0, {}, []
        for category, size in zip(part["category"], part["size"], strict=True):
            fits = n.get(category, 0) < MOST_EVENTS and used < MOST_EVENT_BYTES and size <= MOST_EVENT_BYTES - used
            if fits:
                used, n[category] = used + size, n.get(category, 0) + 1
            out.append(bool(fits))
        return pd.DataFrame({"run": part["run"], "seq": part["seq"], "recorded": out})

    sized = events.select("run", "seq", "category", (F.octet_length("text") + EVENT_OVERHEAD).cast("long").alias("size"))
    kinds_ = f"run {events.schema['run'].dataType.simpleString()}, seq {events.schema['seq'].dataType.simpleString()}, recorded boolean"
    return events.join(sized.groupBy("run").applyInPandas(fold, kinds_), ["run", "seq"])


def blocks(events: DataFrame) -> DataFrame:
    """``(run, origin, seq, url, what, blocked)``: the dependencies of a run, and the failures that count.

    ``events(run, origin, seq, kind, url, status)``; kinds dependency, block and response. A block changes all dependencies of its origin, those before it too. A response of 400 or more is a failure unless its URL was already that of a blocked
    dependency; its ``blocked`` tells whether the origin was by then. Rows without an origin are left out. Origins' blocks are aggregated and joined back, so an origin of any number of rows is no one task's work.
    """
    known = events.where("origin is not null")
    first = known.where("kind = 'block'").groupBy("run", "origin").agg(F.min("seq").alias("b"))
    rows = known.where("kind <> 'block'").join(first, ["run", "origin"], "left")
    asked = rows.where("kind = 'dependency'")
    ignored = asked.where("b is not null").groupBy("run", "origin", "url").agg(F.min(F.greatest("seq", "b")).alias("since"))
    failed = rows.where("kind = 'response' and status >= 400").join(ignored, ["run", "origin", "url"], "left").where("since is null or since > seq")
    out = asked.select("run", "origin", "seq", "url", F.lit("dependency").alias("what"), F.col("b").isNotNull().alias("blocked"))
    return out.unionByName(failed.select("run", "origin", "seq", "url", F.lit("failure").alias("what"), F.coalesce(F.col("b") < F.col("seq"), F.lit(False)).alias("blocked")))


def waits(updates: DataFrame, terminal: tuple, closing: tuple, timeout: str, grace: str) -> DataFrame:
    """``(job, outcome, state, waited_ms)``: what waiting for each job from its first update on comes to.

    done: its first terminal state within ``timeout``. Otherwise, if its last state by then is one of ``closing``, late: its first terminal state within ``grace`` more. Otherwise timeout, with its last state.
    ``updates(job, seq, ts, state)``; updates of one millisecond stand by seq.
    """
    span = lambda text: F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval '{text}'"))
    rows = updates.withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    rows = rows.withColumn("since", F.min("at").over(Window.partitionBy("job"))).withColumns({"deadline": F.col("since") + span(timeout), "end": F.col("since") + span(timeout) + span(grace)})
    inside, over = F.col("at") <= F.col("deadline"), F.col("at").between(F.col("deadline") + 1, F.col("end"))
    ends, order = F.col("state").isin(*terminal), F.struct("at", "seq")
    first = lambda on: F.min_by(F.struct("state", "at"), F.when(on, order))
    told = rows.groupBy("job", "since", "deadline", "end").agg(first(inside & ends).alias("done"), F.max_by("state", F.when(inside, order)).alias("last"), first(over & ends).alias("late"), F.max_by("state", F.when(inside | over, order)).alias("then"))
    waits_on = F.coalesce(F.col("last").isin(*closing), F.lit(False))
    outcome = F.when(F.col("done").isNotNull(), "done").when(waits_on & F.col("late").isNotNull(), "late").otherwise("timeout")
    state = F.when(outcome == "done", F.col("done.state")).when(outcome == "late", F.col("late.state")).when(waits_on, F.col("then")).otherwise(F.col("last"))
    until = F.when(outcome == "done", F.col("done.at")).when(outcome == "late", F.col("late.at")).when(waits_on, F.col("end")).otherwise(F.col("deadline"))
    return told.select(F.col("job").cast("string").alias("job"), outcome.alias("outcome"), state.alias("state"), (until - F.col("since")).alias("waited_ms"))
