"""Addresses against the standard library, waits and failures by hand."""

import ipaddress
import random

from pyspark.sql import functions as F

from pagewright.functions import network

BLOCKED = [ipaddress.ip_network(n) for n in network.BLOCKED_IPV6]


def test_addresses(spark):
    rng = random.Random(2)
    some = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)] + [str(ipaddress.IPv6Address(int(n.network_address) + rng.randrange(min(n.num_addresses, 1 << 60)))) for n in BLOCKED for _ in range(6)]
    some += [ipaddress.ip_address(a).exploded for a in some[:20]] + ["::1.2.3.4", "1::8", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::ffff:8.8.8.8", "FE80::1"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", "1:2:3:4:5:6:7::8:9", "::1.2.3.400", "::1.2.3", "1.2.3.4:80", " ::1"]
    rows = spark.createDataFrame([(a,) for a in [*some, *bad, "8.8.8.8", "10.0.0.1", "x", None]], "a string")
    found = {r["a"]: r["p"] for r in rows.select("a", network.is_public_address(F.col("a")).alias("p")).collect()}
    assert {a: found[a] for a in some} == {a: not any(ipaddress.ip_address(a) in n for n in BLOCKED) for a in some}
    assert all(found[a] is None for a in [*bad, "x", None]) and found["8.8.8.8"] and not found["10.0.0.1"]
    names = ["localhost", "A.Localhost", "printer.local", "db.internal", "x.home.arpa", "local", "localhost.com", "example.org", None]
    rows = spark.createDataFrame([(h,) for h in names], "h string").select(network.is_local_name(F.col("h"))).collect()
    assert [r[0] for r in rows] == [True] * 5 + [False] * 3 + [None]


def test_waits(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    values = {"5": 5000, " 120 ": 30_000, "0": 0, "99999999999": 30_000, "7 seconds": 7000, "-3": None, "soon": None, "": None, None: None, "Thu, 01 Jan 2026 00:00:09 GMT": 9000, "Wed, 31 Dec 2025 23:00:00 GMT": 0, "Thu, 01 Jan 2026 09:00:00 GMT": 30_000, "Thu, 41 Jan 2026 09:00:00 GMT": None}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", network.retry_after(F.col("v"), now).alias("w")).collect()
    assert {r["v"]: r["w"] for r in rows} == values
    wait = lambda asked, delay=250: spark.range(1).select(network.retry_wait(F.lit("u"), F.lit(3), F.lit(asked).cast("long"), delay)).first()[0]
    assert 1000 < wait(None) <= 1250 and 5000 < wait(5000) <= 5250 and wait(30_000) == 30_000 and wait(None, 0) == 0
    quiet = spark.createDataFrame([(100,), (1000,), (9000,)], "w long")
    assert [tuple(r) for r in quiet.select(network.longest_quiet_wait(F.col("w")), network.longest_quiet_wait(F.col("w"), False)).collect()] == [(3000, 1000), (6000, 6000), (15_000, 10_000)]
