"""Queries of the event folds, batch and stream, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capture, validate
from ..operators.work import new_path, written
from ..streaming import resources, states
from .queries import events, query

#: The events table as network events: a session for each user, four requests in each, kinds by type and id.
_EVENTS = """e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id % 4 AS VARCHAR) AS request_id, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'response' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 3 = 0 THEN 'request_extra' ELSE 'response_extra' END END AS kind,
  'https://e.example/' || event_id AS url, 200 + event_id % 5 AS status, CASE WHEN event_id % 2 = 0 THEN 'text/css' END AS mime_type, CASE WHEN event_id % 7 < 3 THEN 302 END AS redirect_status,
  event_id % 5 = 0 AS has_cookie, event_id % 7 = 0 AS has_authorization, event_id % 3 = 1 AS has_set_cookie, event_id % 11 = 0 AS private_or_no_store, event_id % 13 = 0 AS varies_by_credential, value > 40 AS cookie_policy_affected,
  CASE WHEN event_id % 2 = 0 THEN 200 + event_id % 3 END AS extra_status FROM events)"""


def network_events(table: DataFrame) -> DataFrame:
    """The same on Spark."""
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "view", "response").when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed")
    return table.select(
        F.col("user_id").cast("string").alias("session_id"), (n % 4).cast("string").alias("request_id"), n.alias("seq"), "ts", kind.otherwise(F.when(n % 3 == 0, "request_extra").otherwise("response_extra")).alias("kind"),
        F.concat(F.lit("https://e.example/"), n.cast("string")).alias("url"), (200 + n % 5).alias("status"), F.when(n % 2 == 0, "text/css").alias("mime_type"), F.when(n % 7 < 3, 302).cast("long").alias("redirect_status"),
        (n % 5 == 0).alias("has_cookie"), (n % 7 == 0).alias("has_authorization"), (n % 3 == 1).alias("has_set_cookie"), (n % 11 == 0).alias("private_or_no_store"), (n % 13 == 0).alias("varies_by_credential"),
        (F.col("value") > 40).alias("cookie_policy_affected"), F.when(n % 2 == 0, 200 + n % 3).alias("extra_status"),
    )


_flag = lambda c: f"coalesce(bool_or({c}) FILTER (what LIKE '%\\_extra' ESCAPE '\\'{' OR what = ' + chr(39) + 'response' + chr(39) if c in ('has_set_cookie', 'private_or_no_store', 'varies_by_credential') else ''}), false) AS {c}"
_RESOURCES = rf"""WITH {_EVENTS},
p AS (SELECT *, count_if(kind = 'request') OVER w AS life, count_if(kind = 'request' AND redirect_status IS NOT NULL) OVER w AS hop, arg_min(CAST(redirect_status IS NOT NULL AS BIGINT), seq) FILTER (kind = 'request') OVER (PARTITION BY session_id, request_id) AS first FROM e WINDOW w AS (PARTITION BY session_id, request_id ORDER BY seq)),
q AS (SELECT *, kind AS what, greatest(life, 1) AS l, CASE WHEN life = 0 THEN first ELSE hop END AS h, status AS code, mime_type AS typ FROM p WHERE first IS NOT NULL AND (life > 0 OR kind LIKE '%\_extra' ESCAPE '\')
  UNION ALL SELECT *, 'closed', life - 1, hop - 1, redirect_status, NULL FROM p WHERE kind = 'request' AND redirect_status IS NOT NULL AND life > 1),
g AS (SELECT session_id AS session, request_id, h, l, arg_max(url, seq) FILTER (what = 'request') AS url, arg_max(CASE what WHEN 'request' THEN 'discovered' WHEN 'finished' THEN 'complete' WHEN 'closed' THEN 'complete' ELSE what END, seq) FILTER (what NOT LIKE '%\_extra' ESCAPE '\') AS state,
  coalesce(arg_max(code, seq) FILTER (what IN ('response', 'closed')), 0) AS status, (list(typ ORDER BY seq DESC) FILTER (what IN ('response', 'closed')))[1] AS typ, count_if(what = 'request_extra') AS asked, count_if(what = 'response_extra') AS said, {', '.join(map(_flag, capture.EVIDENCE))},
  arg_min(extra_status, seq) FILTER (what = 'response_extra' AND extra_status IS NOT NULL) AS extra_status, count(DISTINCT extra_status) FILTER (what = 'response_extra') AS codes FROM q GROUP BY session_id, request_id, h, l)
SELECT session, request_id, CAST(h AS BIGINT) AS hop, url, state, CAST(status AS BIGINT) AS status, coalesce(typ, 'application/octet-stream') AS mime_type, asked > 0 AS request_extra, said > 0 AS response_extra, {', '.join(capture.EVIDENCE)}, CAST(extra_status AS BIGINT) AS extra_status,
  h > 0 OR asked > 1 OR said > 1 OR codes > 1 AS ambiguous FROM (SELECT *, max(l) OVER (PARTITION BY session, request_id, h) AS top FROM g) WHERE l = top"""


@query("folded_resources", _RESOURCES)
def folded_resources(spark, d):
    return capture.resources(network_events(events(spark, d)))


def run_stream(made: DataFrame, mode: str = "update") -> DataFrame:
    """The rows that a stream gives until its source ends, written to the shared folder."""
    spark, state = made.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    out, before = new_path(spark, "stream-out"), spark.conf.get(state, None)
    spark.conf.set(state, resources.ROCKSDB)
    try:
        job = made.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("append").parquet(out)).option("checkpointLocation", new_path(spark, "stream-at")).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.unset(state) if before is None else spark.conf.set(state, before)
    return spark.read.schema(made.schema).parquet(out)


def streamed(table: DataFrame, make, mode: str = "update", parts: int = 4) -> DataFrame:
    """The rows of the stream that ``make`` makes of ``table``, dealt at random into files that come one at a time."""
    shuffled = written(table.repartition(parts, F.xxhash64(F.lit("dealt"), *[F.col(c) for c in table.columns])), "stream-in")
    source = table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(shuffled.inputFiles()[0].rpartition("/")[0])
    return run_stream(make(source), mode)


@query("streamed_resources", _RESOURCES)
def streamed_resources(spark, d):
    """The same table from a stream of the events in no order."""
    return resources.latest(streamed(network_events(events(spark, d)), lambda s: resources.folded(s, late="60 days", idle="1 day")))


# --- blocks, gates, waits, repeats ----------------------------------------------------------------------------------------


def dealt(table: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """The stream of a table in files of consecutive ``order``, which come one at a time."""
    spark, path = table.sparkSession, new_path(table.sparkSession, "stream-in")
    low, high = table.agg(F.min(order), F.max(order)).first()
    for k in range(parts):
        at = F.least(F.floor((F.col(order) - F.lit(low)) * parts / F.lit(max((high or 0) - (low or 0), 1))), F.lit(parts - 1))
        table.where(F.coalesce(at, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


_BLOCKS = """e AS (SELECT CAST(user_id % 10 AS VARCHAR) AS run, props AS origin, event_id AS seq, ts, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'block' WHEN event_type IN ('click', 'view') THEN 'dependency' ELSE 'response' END AS kind,
  'u' || event_id % 4 AS url, CASE WHEN event_id % 5 < 3 THEN 404 ELSE 200 END AS status FROM events)"""
_BLOCKED = f"""WITH {_BLOCKS}, b AS (SELECT run, origin, min(seq) AS b FROM e WHERE kind = 'block' GROUP BY ALL), r AS (SELECT e.*, b FROM e LEFT JOIN b USING (run, origin)),
i AS (SELECT run, origin, url, min(greatest(seq, b)) AS since FROM r WHERE kind = 'dependency' AND b IS NOT NULL GROUP BY ALL)
SELECT run, origin, seq, url, 'dependency' AS what, b IS NOT NULL AS blocked FROM r WHERE kind = 'dependency' UNION ALL SELECT run, origin, seq, url, 'failure', coalesce(b < seq, false) FROM r LEFT JOIN i USING (run, origin, url) WHERE kind = 'response' AND status >= 400 AND (since IS NULL OR since > seq)"""


def _block_events(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    what = F.when((kind == "error") & (n % 3 == 0), "block").when(kind.isin("click", "view"), "dependency").otherwise("response")
    return events(spark, d).select((F.col("user_id") % 10).cast("string").alias("run"), F.col("props").alias("origin"), n.alias("seq"), "ts", what.alias("kind"), F.concat(F.lit("u"), (n % 4).cast("string")).alias("url"), F.when(n % 5 < 3, 404).otherwise(200).cast("long").alias("status"))


@query("blocked_dependencies", _BLOCKED)
def blocked_dependencies(spark, d):
    return validate.blocks(_block_events(spark, d))


@query("streamed_blocks", _BLOCKED)
def streamed_blocks(spark, d):
    """The same from a stream, on which a block sends earlier rows again."""
    rows = run_stream(states.blocks(dealt(_block_events(spark, d), "seq"), "1 minute", "60 days"))
    return rows.groupBy("run", "origin", "seq", "url", "what").agg(F.bool_or("blocked").alias("blocked"))


_STATES = "CASE event_type WHEN 'click' THEN 'preflight' WHEN 'view' THEN 'attaching' WHEN 'signup' THEN 'discovering' WHEN 'purchase' THEN 'downloading' ELSE CASE WHEN event_id % 8 = 0 THEN 'failed' ELSE 'localizing' END END"
_GATED = f"""WITH RECURSIVE u AS (SELECT CAST(user_id AS VARCHAR) AS job, event_id AS seq, {_STATES} AS state, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
t(before, after) AS (VALUES {', '.join(str(x) for x in validate.JOB_EDGES)}), j AS (SELECT DISTINCT job FROM u),
w AS (SELECT job, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, 'created' AS now, false AS ok FROM j
  UNION ALL SELECT w.job, u.k, u.seq, CASE WHEN u.state = now OR (now, u.state) IN (SELECT (before, after) FROM t) THEN u.state ELSE now END, u.state = now OR (now, u.state) IN (SELECT (before, after) FROM t) FROM w JOIN u ON u.job = w.job AND u.k = w.k + 1)
SELECT job, seq, now AS state FROM w WHERE ok"""


def _updates(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    state = F.when(kind == "click", "preflight").when(kind == "view", "attaching").when(kind == "signup", "discovering").when(kind == "purchase", "downloading").otherwise(F.when(n % 8 == 0, "failed").otherwise("localizing"))
    return events(spark, d).select(F.col("user_id").cast("string").alias("job"), n.alias("seq"), "ts", state.alias("state"))


@query("accepted_states", _GATED)
def accepted_states(spark, d):
    return validate.accepted_updates(_updates(spark, d), "job").where("accepted").select("job", "seq", "state")


@query("streamed_states", _GATED)
def streamed_states(spark, d):
    return run_stream(states.gated(dealt(_updates(spark, d), "seq"), "1 minute", "60 days"))


_TIMEOUT, _GRACE, _TERMINAL, _CLOSING = "2 days", "1 day", ("purchase",), ("view", "click")
_WAITS = f"""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS job, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type AS state, min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS since FROM events),
d AS (SELECT *, since + epoch_ms(TIMESTAMP '1970-01-01' + INTERVAL '{_TIMEOUT}') AS dl, since + epoch_ms(TIMESTAMP '1970-01-01' + INTERVAL '{_TIMEOUT}' + INTERVAL '{_GRACE}') AS en FROM u),
g AS (SELECT job, since, dl, en, min((ms, seq)) FILTER (ms <= dl AND state = 'purchase') AS done, arg_max(state, (ms, seq)) FILTER (ms <= dl) AS last, min((ms, seq)) FILTER (ms > dl AND ms <= en AND state = 'purchase') AS late, arg_max(state, (ms, seq)) FILTER (ms <= en) AS after FROM d GROUP BY ALL)
SELECT job, CASE WHEN done IS NOT NULL THEN 'done' WHEN last IN {_CLOSING} AND late IS NOT NULL THEN 'late' ELSE 'timeout' END AS outcome, CASE WHEN done IS NOT NULL OR last IN {_CLOSING} AND late IS NOT NULL THEN 'purchase' WHEN last IN {_CLOSING} THEN after ELSE last END AS state,
  CASE WHEN done IS NOT NULL THEN done[1] WHEN last IN {_CLOSING} AND late IS NOT NULL THEN late[1] WHEN last IN {_CLOSING} THEN en ELSE dl END - since AS waited_ms FROM g"""


def _jobs(spark, d):
    return events(spark, d).select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("state"))


@query("terminal_waits", _WAITS)
def terminal_waits(spark, d):
    return validate.waits(_jobs(spark, d), _TERMINAL, _CLOSING, _TIMEOUT, _GRACE)


@query("streamed_waits", _WAITS)
def streamed_waits(spark, d):
    """The same from timers; one last row far ahead lets them all ring."""
    jobs = _jobs(spark, d)
    ahead = jobs.agg(F.lit("").alias("job"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"), (F.max("ts") + F.expr("interval 90 days")).alias("ts"), F.lit("view").alias("state"))
    return run_stream(states.waits(dealt(jobs.union(ahead), "seq"), _TERMINAL, _CLOSING, _TIMEOUT, _GRACE, "1 minute")).where("job <> ''")


@query("distinct_streamed_events", "SELECT event_id, user_id, event_type FROM events")
def distinct_streamed_events(spark, d):
    """Of events of which a third comes again a minute later, in no order, each once."""
    table = events(spark, d).select("event_id", "user_id", "event_type", "ts")
    twice = table.unionByName(table.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 minute")))
    return streamed(twice, lambda s: states.distinct_events(s, ["event_id", "user_id", "event_type"], "60 days"), "append").select("event_id", "user_id", "event_type")
