"""Network events to resources, and resources to candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, reuse, urls


def folded(events: DataFrame) -> DataFrame:
    """One row for each (session, request, redirect hop) of ``events(session_id, request_id, seq, kind, url, status, mime_type, redirect_status)``.

    kind is request, response, finished or failed. A request with a redirect_status closes the hop before it as complete with that status
    and opens the next one. state is the last that the hop's events give: request, response, complete or failed. Events before a request's first
    request event are left out. Defaults: status 0, type application/octet-stream.
    """
    key = Window.partitionBy(F.coalesce("session_id", F.lit("root")), "request_id").orderBy("seq")
    opens = ((F.col("kind") == "request") & F.col("redirect_status").isNotNull()).cast("int")
    rows = events.withColumn("hop", F.sum(opens).over(key)).withColumn("begun", F.count_if(F.col("kind") == "request").over(key)).where("begun > 0")
    state = F.when(F.col("kind") == "finished", "complete").otherwise(F.col("kind"))
    by_hop = rows.groupBy(F.coalesce("session_id", F.lit("root")).alias("session"), "request_id", "hop").agg(
        F.max_by(F.when(F.col("kind") == "request", F.col("url")), F.when(F.col("kind") == "request", F.col("seq"))).alias("url"),
        F.max_by("status", F.when(F.col("kind") == "response", F.col("seq"))).alias("status"),
        F.max_by("mime_type", F.when(F.col("kind") == "response", F.col("seq"))).alias("mime_type"),
        F.max_by(state, F.col("seq")).alias("state"),
    )
    closing = rows.where("kind = 'request' and redirect_status is not null").select(
        F.coalesce("session_id", F.lit("root")).alias("session"), "request_id", (F.col("hop") - 1).alias("hop"), F.col("redirect_status").alias("closed")
    )
    joined = by_hop.join(closing, ["session", "request_id", "hop"], "left")
    return joined.select(
        F.concat_ws(":", "session", "request_id", F.col("hop").cast("string")).alias("id"), "url",
        F.when(F.col("closed").isNotNull(), "complete").otherwise(F.col("state")).alias("state"),
        F.coalesce("closed", "status", F.lit(0)).cast("long").alias("status"),
        F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type"),
    )


#: What extra events and responses tell of credentials and caching.
EVIDENCE = ["has_cookie", "has_authorization", "has_set_cookie", "private_or_no_store", "varies_by_credential", "cookie_policy_affected"]
DEFAULT_TYPE = "application/octet-stream"


def resources(events: DataFrame) -> DataFrame:
    """``(session, request_id, hop, url, state, status, mime_type, request_extra, response_extra, <EVIDENCE>, extra_status, ambiguous)``, one row for each redirect hop of a request.

    ``events(session_id, request_id, seq, kind, url, status, mime_type, redirect_status, <EVIDENCE>, extra_status)``; kinds request, response, finished, failed, request_extra and response_extra. A request with a redirect_status
    completes the hop before it and opens the next; any request begins its hop anew. Extra events before the first request wait for it, other events before it are
    left out. Two extra events of one kind for a hop, statuses that differ, and every hop after a redirect are ambiguous. A null session is root; defaults are the status 0 and DEFAULT_TYPE. One shuffle, by
    request; all that follows stays in its partitions.
    """
    keyed = events.withColumn("session", F.coalesce("session_id", F.lit("root")))
    whole = Window.partitionBy("session", "request_id")
    running = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    asks, extra = F.col("kind") == "request", F.col("kind").endswith("_extra")
    opens = asks & F.col("redirect_status").isNotNull()
    placed = keyed.withColumns({"life": F.count_if(asks).over(running), "hop": F.count_if(opens).over(running), "first": F.min_by(opens.cast("long"), F.when(asks, F.col("seq"))).over(whole)})
    placed = placed.where(F.col("first").isNotNull() & ((F.col("life") > 0) | extra))
    early = F.col("life") == 0
    own = F.struct(F.when(early, 1).otherwise(F.col("life")).alias("life"), F.when(early, F.col("first")).otherwise(F.col("hop")).alias("hop"), F.col("kind").alias("what"), F.col("status").alias("code"), F.col("mime_type").alias("type"))
    shut = F.struct((F.col("life") - 1).alias("life"), (F.col("hop") - 1).alias("hop"), F.lit("closed").alias("what"), F.col("redirect_status").alias("code"), F.lit(None).cast("string").alias("type"))
    parted = placed.select("session", "request_id", "seq", "url", *EVIDENCE, "extra_status", F.inline(F.when(opens & (F.col("life") > 1), F.array(own, shut)).otherwise(F.array(own))))
    what = F.col("what")
    state = F.when(what == "request", "discovered").when(what.isin("finished", "closed"), "complete").otherwise(what)
    answers = F.when(what.isin("response", "closed"), F.col("seq"))
    told = [
        F.coalesce(F.bool_or(F.col(c) & (what.endswith("_extra") | ((what == "response") & F.lit(c in ("has_set_cookie", "private_or_no_store", "varies_by_credential"))))), F.lit(False)).alias(c)
        for c in EVIDENCE
    ]
    asked, said = F.count_if(what == "request_extra"), F.count_if(what == "response_extra")
    codes = F.when(what == "response_extra", F.col("extra_status"))
    lives = parted.groupBy("session", "request_id", "hop", "life").agg(
        F.max_by(F.when(what == "request", F.col("url")), F.when(what == "request", F.col("seq"))).alias("url"), F.max_by(F.when(~what.endswith("_extra"), state), F.when(~what.endswith("_extra"), F.col("seq"))).alias("state"),
        F.coalesce(F.max_by("code", answers), F.lit(0)).cast("long").alias("status"), F.coalesce(F.max_by("type", answers), F.lit(DEFAULT_TYPE)).alias("mime_type"), (asked > 0).alias("request_extra"), (said > 0).alias("response_extra"), *told,
        F.min_by(codes, F.when(codes.isNotNull(), F.col("seq"))).cast("long").alias("extra_status"), ((F.col("hop") > 0) | (asked > 1) | (said > 1) | (F.count_distinct(codes) > 1)).alias("ambiguous"),
    )
    fields = [c for c in lives.columns if c not in ("session", "request_id", "hop", "life")]
    last = lives.groupBy("session", "request_id", "hop").agg(F.max_by(F.struct(*fields), "life").alias("r"))
    return last.select("session", "request_id", F.col("hop").cast("long").alias("hop"), "r.*")


def evidence_score(body, content_type, size):
    """4 for a body, 2 for a type, 1 for a size."""
    return body.isNotNull().cast("int") * 4 + content_type.isNotNull().cast("int") * 2 + size.isNotNull().cast("int")


def best_evidence(rows: DataFrame) -> DataFrame:
    """Of ``rows(url, seq, body, content_type, size)`` one for each URL: the best by evidence, the earliest of equals, its gaps filled by the next best."""
    order = Window.partitionBy("url").orderBy(F.desc(evidence_score(F.col("body"), F.col("content_type"), F.col("size"))), "seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = [F.first(c, ignorenulls=True).over(whole).alias(c) for c in ("body", "content_type", "size")]
    ranked = rows.select("url", "seq", *best, F.row_number().over(order).alias("_n"))
    return ranked.where("_n = 1").drop("_n")


def reassembled(chunks: DataFrame) -> DataFrame:
    """``(body_id, length, sha256, complete)`` of ``chunks(body_id, offset, data, declared_length, declared_sha256)``: complete if the offsets join up and length and hash are those declared."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "data")))
    bodies = chunks.groupBy("body_id").agg(parts.alias("p"), F.max("declared_length").alias("n"), F.max("declared_sha256").alias("h"))
    ends = F.transform("p", lambda x: x["offset"] + F.length(x["data"]))
    joined = F.forall(F.transform("p", lambda x, i: x["offset"] == F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))), lambda ok: ok)
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))
    out = bodies.select("body_id", "n", "h", joined.alias("joined"), data.alias("d"))
    return out.select(
        "body_id", F.length("d").cast("long").alias("length"), F.sha2("d", 256).alias("sha256"),
        (F.col("joined") & (F.length("d") == F.col("n")) & (F.sha2("d", 256) == F.col("h"))).alias("complete"),
    )


def sessions(events: DataFrame, quiet: str = "30 minutes", deadline: str | None = None) -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events with less than ``quiet`` between them; with a deadline, events later than that after a run's start are left out."""
    seconds = F.expr(f"interval '{quiet}'")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = F.coalesce((F.col("ts") >= F.lag("ts").over(own) + seconds).cast("int"), F.lit(1))
    rows = events.select("user_id", "ts", "event_id", opens.alias("opens")).withColumn("run", F.sum("opens").over(own))
    if deadline:
        first = F.min("ts").over(Window.partitionBy("user_id", "run"))
        rows = rows.withColumn("first", first).where(F.col("ts") <= F.col("first") + F.expr(f"interval '{deadline}'"))
    return rows.groupBy("user_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("run")


def privacy(events: DataFrame) -> DataFrame:
    """``(session, request_id, hop, ...)``: what the extra events of requests and responses tell of each hop, in whatever order they arrive.

    ``events(session_id, request_id, seq, kind, redirect_status, has_cookie, has_authorization, has_set_cookie, private_or_no_store, varies_by_credential, cookie_policy_affected, extra_status)``; kinds
    request_extra and response_extra carry evidence. What comes before its request is kept for the first hop. Two pieces of evidence of one kind for a hop, or statuses that differ, make it ambiguous. Without a request there is no row.
    """
    session = F.coalesce("session_id", F.lit("root"))
    key = Window.partitionBy(session, "request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.count_if((F.col("kind") == "request") & F.col("redirect_status").isNotNull()).over(key)
    begun = F.count_if(F.col("kind") == "request").over(key)
    known = F.count_if(F.col("kind") == "request").over(Window.partitionBy(session, "request_id"))
    rows = events.select("*", session.alias("session"), opens.alias("hop"), (begun == 0).alias("parked"), known.alias("_k")).where("_k > 0 and kind like '%_extra'")
    asks, says = F.col("kind") == "request_extra", F.col("kind") == "response_extra"
    early, late = (lambda k: F.count_if(k & F.col("parked"))), (lambda k: F.count_if(k & ~F.col("parked")))
    any_ = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False)).alias(c)
    twice = lambda k: (early(k) > 1) | (F.least(early(k), F.lit(1)) + late(k) > 1)
    # Of parked statuses the first is kept; it is compared with those that come later.
    first_early = F.min_by("extra_status", F.when(says & F.col("parked") & F.col("extra_status").isNotNull(), F.col("seq")))
    differ = F.count_distinct(F.when(says & ~F.col("parked"), F.col("extra_status"))) > 1
    first_late = F.min_by("extra_status", F.when(says & ~F.col("parked") & F.col("extra_status").isNotNull(), F.col("seq")))
    return rows.groupBy("session", "request_id", "hop").agg(
        F.bool_or(asks).alias("request_extra"), F.bool_or(says).alias("response_extra"), *[any_(c) for c in ("has_cookie", "has_authorization", "has_set_cookie", "private_or_no_store", "varies_by_credential", "cookie_policy_affected")],
        F.coalesce(first_early, first_late).alias("status"), (twice(asks) | twice(says) | differ | F.coalesce(first_early != first_late, F.lit(False))).alias("ambiguous"),
    )


def admitted_requests(requests: DataFrame) -> DataFrame:
    """``requests(url, resource_type, initiator)`` worth a row: no tracker or the like, no ping, no icon that the browser asks for by itself."""
    icon = (urls.path(F.col("url")) == "/favicon.ico") & (F.coalesce(F.lower("initiator"), F.lit("other")) == "other")
    return requests.where(~classify.is_nonessential(F.col("url")) & (F.coalesce("resource_type", F.lit("")) != "Ping") & ~F.coalesce(icon, F.lit(False)))


def pending(events: DataFrame) -> DataFrame:
    """``events(session, request_id, seq, kind, resource_type, worker)`` with ``pending``: requests of the session that are open after each event.

    kind opened or closed; those of workers and long-lived ones hold nothing up. Closing what is not open changes nothing.
    """
    counts = ~F.coalesce("worker", F.lit(False)) & ~F.coalesce(F.col("resource_type").isin(reuse.LONG_LIVED), F.lit(False))
    own = Window.partitionBy("session", "request_id").orderBy("seq")
    fresh = (F.col("kind") == "opened") & (F.coalesce(F.lag("kind").over(own), F.lit("closed")) == "closed")
    shut = (F.col("kind") == "closed") & (F.lag("kind").over(own) == "opened")
    change = F.when(counts & fresh, 1).when(F.coalesce(counts & shut, F.lit(False)), -1).otherwise(0)
    rows = events.withColumn("_c", change)
    return rows.withColumn("pending", F.sum("_c").over(Window.partitionBy("session").orderBy("seq"))).drop("_c")


def seeded_hints(hints: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """``(url, resource_type)``: static files that the page's timing names and no request does, the first ``most`` by ``seq``. ``hints(url, seq)``, ``known(url)``."""
    named = hints.select(urls.canonical(F.col("url")).alias("url"), "seq").where("url is not null").groupBy("url").agg(F.min("seq").alias("seq"))
    typed = named.withColumn("resource_type", reuse.static_resource_type(F.col("url"))).where(F.col("resource_type").isNotNull() & (urls.path(F.col("url")) != "/favicon.ico"))
    return typed.orderBy("seq", "url").limit(most).join(known.select("url"), "url", "left_anti").select("url", "resource_type")


def stored_matches(missing: DataFrame, stored: DataFrame) -> DataFrame:
    """``(url, sha256)``: bodies of the page's own caches for resources without one. ``missing(url)``, ``stored(cache, entry, url, method, status, vary, cache_control, sha256)``.

    A stored response counts if it is a GET's with a status of 200 to 203, doesn't vary and is not private; of several the first by cache and entry.
    """
    usable = (F.upper("method") == "GET") & F.col("status").between(200, 203) & (F.trim(F.coalesce("vary", F.lit(""))) == "") & ~reuse.is_private(F.col("cache_control"))
    rows = stored.where(usable).select(urls.canonical(F.col("url")).alias("_u"), F.struct("cache", "entry").alias("_at"), "sha256")
    first = rows.where("_u is not null").groupBy("_u").agg(F.min_by("sha256", "_at").alias("sha256"))
    return missing.withColumn("_u", urls.canonical(F.col("url"))).join(first, "_u").select("url", "sha256").distinct()


def candidates(rows: DataFrame, source: str, reason: str) -> DataFrame:
    """Of captured ``rows(url, seq, method, status, resource_type, historical, incomplete, body, content_type, size)`` what a mirror is to fetch, one for each URL, with the source page added if none is it.

    Kept are GETs with a response of 200 to 399 that are neither trackers and the like nor long-lived, historical candidates, and, if the capture ended by its maximum duration, incomplete ones.
    """
    answered = (F.upper("method") == "GET") & F.col("status").between(200, 399) & ~classify.is_nonessential(F.col("url")) & ~F.coalesce(F.col("resource_type").isin(reuse.LONG_LIVED), F.lit(False))
    kept = rows.where(F.coalesce(answered, F.lit(False)) | F.coalesce("historical", F.lit(False)) | (F.coalesce("incomplete", F.lit(False)) & F.lit(reason == "maximum_duration")))
    best = best_evidence(kept.withColumn("url", F.coalesce(urls.canonical(F.col("url")), "url")))
    entry = rows.sparkSession.createDataFrame([(source,)], "url string").select(urls.canonical(F.col("url")).alias("url"))
    own = entry.join(best.select("url"), "url", "left_anti").select("url", F.lit(0).cast("long").alias("seq"), *[F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("body", "content_type", "size")])
    return best.unionByName(own).withColumn("is_entry", F.col("url") == urls.canonical(F.lit(source)))


def worker_tagged(resources: DataFrame, sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """``resources(session, url, ...)`` with ``worker``: whether their session is a worker's or a worker was started from their URL. ``sessions(session)``, ``targets(url)``."""
    by_session = sessions.select(F.col("session").alias("_s")).distinct()
    by_url = targets.select(urls.canonical(F.col("url")).alias("_u")).where("_u is not null").distinct()
    rows = resources.withColumn("_c", urls.canonical(F.col("url")))
    rows = rows.join(by_session, rows["session"] == by_session["_s"], "left").join(by_url, rows["_c"] == by_url["_u"], "left")
    return rows.select(*resources.columns, (F.col("_s").isNotNull() | F.col("_u").isNotNull()).alias("worker"))


def preflight_warnings(resources, transferred, controlled, media_elements):
    """What a page's first look gives reason to warn of: slow, service_worker, media; missing or negative counts are zero."""
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    slow = (count(resources) > 500) | (count(transferred) > 100 * 1024 * 1024)
    named = F.array(F.when(slow, F.lit("slow")), F.when(F.coalesce(controlled, F.lit(False)), F.lit("service_worker")), F.when(count(media_elements) > 0, F.lit("media")))
    return F.filter(named, lambda w: w.isNotNull())
