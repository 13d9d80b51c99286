"""Admission by rounds is admission row by row."""

import random

import pytest

from pagewright.operators import budget

SCHEMA = "job string, seq long, size long, media string"


def sequential(rows, most, media_bytes, unknown):
    out = {}
    state = {}
    for job, seq, size, media in sorted(rows, key=lambda r: (r[0], r[1])):
        used, media_used = state.get(job, (0, 0))
        n = max(unknown if size is None else size, 0)
        counts = media is not None and media_bytes is not None
        ok = used + n <= most and (not counts or media_used + n <= (budget.video_limit(media_bytes) if media == "video" else media_bytes))
        state[job] = (used + n * ok, media_used + n * (ok and counts))
        out[job, seq] = ok
    return out


@pytest.mark.parametrize(("most", "media_bytes", "unknown", "stretch"), [(4000, None, 0, 7), (4000, 900, 5, 3), (10**9, None, 0, 50), (500, 100, 400, 1000), (0, 0, 1, 4), (10**8, 5 * 1024 * 1024, 0, 20)])
def test_admitted(spark, most, media_bytes, unknown, stretch):
    rng = random.Random(stretch)
    scale = 100_000 if most >= 10**8 else 1
    rows = []
    for job, n in (("hot", 260), ("b", 40), ("c", 1)):
        rows += [(job, k, rng.choice([None, 0, -3, rng.randrange(1, 40), rng.randrange(1, 600)]), rng.choice([None, None, "audio", "video"])) for k in range(n)]
    rows = [(j, s, n if n is None or n < 1 else n * scale, m) for j, s, n, m in rows]
    found = budget.admitted(spark.createDataFrame(rows, SCHEMA).repartition(3), most, media_bytes, unknown, stretch)
    assert {(r["job"], r["seq"]): r["admitted"] for r in found.collect()} == sequential(rows, most, media_bytes, unknown)


def test_nothing(spark):
    assert budget.admitted(spark.createDataFrame([], SCHEMA), 10).count() == 0
