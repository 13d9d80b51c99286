"""The streaming fold gives what the batch fold gives; images are compared as tables of pixels."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import capture, images
from pagewright.plans.queries import _NET
from pagewright.streaming import fold


def test_stream_equals_batch(spark, tmp_path):
    events = _NET.frame(spark)
    for part, kept in enumerate(("seq <= 4", "seq > 4")):
        events.where(kept).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _ = part
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = fold.folded(stream).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert job.awaitTermination(120)
    last = {}
    for r in spark.table("folded").collect():
        last[r["id"]] = tuple(r)
    assert sorted(last.values()) == sorted(tuple(r) for r in capture.folded(events).select("id", "url", "state", "status", "mime_type").collect())


def run(stream, name, path, mode="append"):
    job = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(path)).start()
    assert job.awaitTermination(120)
    return job


def test_stream_with_time_equals_batch_and_drops_state(spark, tmp_path):
    events = _NET.frame(spark).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    later = events.where("seq = 7").withColumn("ts", F.col("ts") + F.expr("interval 3 hours")).withColumn("request_id", F.lit("9"))
    for part in (events.where("seq <= 4"), events.where("seq > 4"), later, later.withColumn("request_id", F.lit("10"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = run(fold.folded(stream, late="1 minute", idle="10 minutes"), "timed", tmp_path / "c", "update")
    last = {r["id"]: tuple(r) for r in spark.table("timed").collect()}
    want = capture.folded(events.unionByName(later).unionByName(later.withColumn("request_id", F.lit("10"))).drop("ts")).select("id", "url", "state", "status", "mime_type")
    assert sorted(last.values()) == sorted(tuple(r) for r in want.collect())
    assert job.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_quiet_windows_equal_batch_sessions(spark, tmp_path):
    rows = [(u, k, 1_700_000_000 + 60 * m) for u, ms in ((1, (0, 10, 50, 51)), (2, (5,))) for k, m in enumerate(ms)]
    end = [(9, 0, 1_700_000_000 + 864_000)]  # moves the watermark on
    make = lambda r: spark.createDataFrame(r, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    for part in (rows, end):
        make(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(make(end).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(fold.quiet_windows(stream), "quiet", tmp_path / "c")
    found = sorted((r["user_id"], r["start"], r["n"]) for r in spark.table("quiet").collect())
    assert found == sorted((r["user_id"], r["start"], r["n"]) for r in capture.sessions(make(rows)).collect())


def test_late_bodies_and_quiet_network(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    asked = spark.createDataFrame([("s", "1", "u1", 0), ("s", "2", "u2", 0)], "session string, request_id string, url string, n int").withColumn("ts", at(F.col("n"))).drop("n")
    got = spark.createDataFrame([("s", "1", "h1", 100), ("s", "2", "h2", 400)], "session string, request_id string, sha256 string, n int").withColumn("body_ts", at(F.col("n"))).drop("n")
    seen = spark.createDataFrame([("s", "opened", 0), ("s", "closed", 5), ("s", "opened", 70), ("t", "opened", 100_000)], "session string, kind string, n int").withColumn("ts", at(F.col("n"))).drop("n")
    later = F.expr("interval 3 hours")  # moves both watermarks on, in two steps
    ahead = lambda df, c: [df.limit(1).withColumns({"request_id": F.lit("end"), c: F.col(c) + k * later}) for k in (1, 2)]
    for parts, name in (([asked, *ahead(asked, "ts")], "a"), ([got, *ahead(got, "body_ts")], "b"), ([seen], "e")):
        for df in parts:
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda df, name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    run(fold.late_bodies(read(asked, "a"), read(got, "b")), "bodies", tmp_path / "cb")
    assert sorted(tuple(r) for r in spark.table("bodies").where("request_id <> 'end'").collect()) == [("s", "1", "u1", "h1"), ("s", "2", "u2", None)]
    run(fold.quiet_network(read(seen, "e")), "network", tmp_path / "ce")
    assert sorted((r["session"], r["opened"], r["closed"], r["quiet"]) for r in spark.table("network").where("session = 's'").collect()) == [("s", 1, 0, False), ("s", 1, 1, True)]


def pixels(spark, shown: dict) -> DataFrame:
    rows = [(name, x, y, *map(int, p)) for name, a in shown.items() for y, row in enumerate(a) for x, p in enumerate(row)]
    return spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int, a int")


def test_images(spark):
    white = np.full((20, 20, 4), 255, np.uint8)
    few, many, clear = white.copy(), white.copy(), white.copy()
    few[0, :10, :3] = 0
    many[:10, :, :3] = 0
    clear[..., :3], clear[..., 3] = 0, 0  # nothing but the white below it
    reference = pixels(spark, {k: white for k in ("same", "few", "many", "clear")} | {"size": white[:9], "lost": white[:2]})
    actual = pixels(spark, {"same": white, "few": few, "many": many, "clear": clear, "size": white[:8]})
    found = {r["image"]: tuple(r)[1:] for r in images.compared(actual, reference).collect()}
    assert found["same"] == found["clear"] == ("match", 0, 400, 0.0, 1.0) and found["few"] == ("partial", 10, 400, 0.025, 0.975) and found["many"] == ("mismatch", 200, 400, 0.5, 0.5)
    assert found["size"] == found["lost"] == ("error", None, None, None, None)
    assert [r[0] for r in spark.createDataFrame([(0.02,), (0.15,), (0.16,)], "r double").select(images.outcome(F.col("r"))).collect()] == ["match", "partial", "mismatch"]
