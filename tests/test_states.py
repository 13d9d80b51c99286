"""Streams with state give what their tables give, whatever the order of arrival, and drop what is over."""

import random

from pyspark.sql import functions as F

from pagewright.operators import capture, validate
from pagewright.streaming import resources, states

KINDS = ["request", "response", "finished", "failed", "request_extra", "response_extra"]
SCHEMA = "session_id string, request_id string, seq long, ts timestamp, kind string, url string, status long, mime_type string, redirect_status long, " + ", ".join(f"{c} boolean" for c in capture.EVIDENCE) + ", extra_status long"


def network(spark, n, requests, seed):
    """Events of some requests, a minute apart."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choices(KINDS, (5, 3, 2, 1, 3, 3))[0]
        flags = [rng.random() < 0.3 if kind.endswith("_extra") or kind == "response" else None for _ in capture.EVIDENCE]
        rows.append((rng.choice(["s", None]), str(rng.randrange(requests)), k, 1_700_000_000 + 60 * k, kind, f"u{k}", rng.choice([200, 404, None]), rng.choice(["text/css", None]), rng.choice([None, None, 302]) if kind == "request" else None, *flags, rng.choice([None, 200, 302]) if kind == "response_extra" else None))
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "t long")).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def stream(spark, parts, path):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def rows_of(spark, made, path, name):
    """The rows of a stream until its source ends, and the rows of state at its end."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, resources.ROCKSDB)
    try:
        job = made.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(str(path / "out"))).option("checkpointLocation", str(path / "at")).trigger(availableNow=True).queryName(name).start()
        assert job.awaitTermination(300)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(made.schema).parquet(str(path / "out")), job.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_steps_are_the_table(spark):
    """The fold of a sorted list, by hand on plain dicts."""
    events = network(spark, 400, 12, 1)
    folds, hops = {}, {}
    for e in sorted((r.asDict() for r in events.collect()), key=lambda e: e["seq"]):
        key = (e["session_id"] or "root", e["request_id"])
        state = folds.setdefault(key, {"hop": 0, "row": None, "parked": []})
        for hop, row in resources.stepped(state, e).items():
            hops[(*key, hop)] = dict(row)
    want = sorted((*k, *[row[c] for c in resources.COLUMNS]) for k, row in hops.items())
    assert sorted(map(tuple, capture.resources(events).select("session", "request_id", "hop", *resources.COLUMNS).collect()), key=str) == sorted(want, key=str)
    assert capture.resources(events.where("false")).count() == 0


def test_any_order_of_arrival(spark, tmp_path):
    """Events arrive up to half an hour late; what the watermark has passed is settled, and the state of quiet requests goes."""
    events = network(spark, 240, 15, 2)
    shaken = events.withColumn("due", F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(29)))
    parts = [shaken.where(f"due >= {a} and due < {a + 45}").drop("due").orderBy(F.xxhash64("seq")) for a in range(0, 270, 45)]
    end = [events.limit(1).withColumns({"request_id": F.lit(f"end{k}"), "ts": F.expr(f"timestamp_seconds(1700000000 + {86_400 * (5 + k)})"), "kind": F.lit("request"), "redirect_status": F.lit(None).cast("long")}) for k in range(2)]
    made = resources.folded(stream(spark, [*parts, *end], tmp_path), late="30 minutes", idle="2 hours")
    rows, held = rows_of(spark, made, tmp_path, "any_order")
    got = resources.latest(rows).where("request_id not like 'end%'").select("session", "request_id", "hop", *resources.COLUMNS)
    # A request that was quiet for over two hours begins anew, so the table is that of its events since.
    assert rows.count() > got.count()
    gaps = capture.resources(events).select("session", "request_id", "hop", *resources.COLUMNS)
    quiet = events.withColumn("session", F.coalesce("session_id", F.lit("root"))).selectExpr("session", "request_id", "seq - lag(seq) over (partition by session, request_id order by seq) as gap").where("gap > 85").select("session", "request_id").distinct()
    assert sorted(map(str, got.join(quiet, ["session", "request_id"], "left_anti").collect())) == sorted(map(str, gaps.join(quiet, ["session", "request_id"], "left_anti").collect()))
    assert quiet.count() < 15 and held <= 3


def test_a_hop_that_moves_away(spark, tmp_path):
    """A redirect that comes late moves the hop that was shown."""
    events = network(spark, 2, 1, 3).withColumns({"session_id": F.lit("s"), "kind": F.lit("request"), "redirect_status": F.when(F.col("seq") == 0, 302).cast("long")})
    made = resources.folded(stream(spark, [events.where("seq = 1"), events.where("seq = 0")], tmp_path), late="1 hour")
    rows, _ = rows_of(spark, made, tmp_path, "moves")
    assert {r["hop"]: r["present"] for r in rows.orderBy("version").collect()} == {0: False, 1: True}
    assert [r["hop"] for r in resources.latest(rows).collect()] == [r["hop"] for r in capture.resources(events).collect()] == [1]


def test_blocks(spark, tmp_path):
    rows = [
        ("r", "o", 1, "dependency", "a", None), ("r", "o", 2, "response", "a", 404), ("r", "o", 3, "block", None, None), ("r", "o", 4, "response", "a", 500), ("r", "o", 5, "response", "b", 500), ("r", "o", 6, "dependency", "b", None), ("r", "o", 7, "response", "b", 500),
        ("r", "p", 8, "dependency", "c", None), ("r", "p", 9, "response", "c", 200), ("q", "o", 10, "dependency", "a", None), ("r", None, 11, "block", None, None),
    ]
    events = spark.createDataFrame(rows, "run string, origin string, seq long, kind string, url string, status long")
    want = {("r", "o", 1, "dependency", True), ("r", "o", 2, "failure", False), ("r", "o", 5, "failure", True), ("r", "o", 6, "dependency", True), ("r", "p", 8, "dependency", False), ("q", "o", 10, "dependency", False)}
    pick = lambda df: {(r["run"], r["origin"], r["seq"], r["what"], r["blocked"]) for r in df.collect()}
    assert pick(validate.blocks(events)) == want and validate.blocks(events.where("false")).count() == 0
    timed = events.where("origin is not null").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq")))
    told, _ = rows_of(spark, states.blocks(stream(spark, [timed.where("seq <= 2"), timed.where("seq > 2")], tmp_path), "1 minute"), tmp_path, "blocks")
    assert pick(told.groupBy("run", "origin", "seq", "what").agg(F.bool_or("blocked").alias("blocked"))) == want
    assert told.where("seq = 1").count() == 2


def test_waits(spark):
    rows = [("done", 0, "x"), ("done", 50, "end"), ("late", 0, "x"), ("late", 90, "closing"), ("late", 130, "end"), ("late", 140, "end"), ("over", 0, "closing"), ("over", 160, "end"), ("open", 0, "x"), ("open", 120, "end"), ("edge", 0, "x"), ("edge", 100, "end")]
    table = spark.createDataFrame([(j, k, t, s) for k, (j, t, s) in enumerate(rows)], "job string, seq long, t long, state string").withColumn("ts", F.timestamp_seconds("t"))
    found = {r["job"]: tuple(r)[1:] for r in validate.waits(table, ("end",), ("closing",), "100 seconds", "50 seconds").collect()}
    assert found == {"done": ("done", "end", 50_000), "late": ("late", "end", 130_000), "over": ("timeout", "closing", 150_000), "open": ("timeout", "x", 100_000), "edge": ("done", "end", 100_000)}


def test_many_requests_share_a_bucket(spark, tmp_path):
    """State is a row for each bucket, whatever the number of requests; null ids are a request, and a late event moves only its own."""
    events = network(spark, 1200, 300, 5).withColumn("request_id", F.when(F.col("request_id") != "7", F.col("request_id")))
    made = resources.folded(stream(spark, [events.where(f"seq % 3 = {k}") for k in (1, 0, 2)], tmp_path), late="30 days", idle="1 day", buckets=4)
    rows, held = rows_of(spark, made, tmp_path, "buckets")
    shown = lambda df: sorted(map(str, df.select("session", "request_id", "hop", *resources.COLUMNS).collect()))
    assert shown(resources.latest(rows)) == shown(capture.resources(events)) and held <= 8
