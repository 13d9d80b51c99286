"""Admission under a byte budget, in order: what fits is taken, what doesn't is passed over, and later smaller ones may still fit.

Each decision depends on those before it, but in two ways only: a run of rows that fits as a whole is taken by prefix sums, and a row that is larger than what is left
never fits again. Rounds of both leave short stretches, which tasks go through row by row, each job's at most STRETCH rows at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .work import dropped, small, written

STRETCH = 4096
#: Of a media budget of at least the first, the smaller of the second and a quarter is kept for audio.
LEAST_MEDIA, MOST_AUDIO = 1024 * 1024, 32 * 1024 * 1024


def video_limit(media_bytes: int | None) -> int | None:
    """What videos may take of the budget of media."""
    if media_bytes is None or media_bytes < LEAST_MEDIA:
        return media_bytes
    return media_bytes - min(MOST_AUDIO, media_bytes // 4)


def _prefixed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``upto``, ``media_upto`` (sums of their job's sizes up to each) and ``place`` (counted from 0), and the written table that they come from."""
    spark = rows.sparkSession
    order = ["job", "seq"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    placed = written(dealt, "budget-rows")
    sums = placed.groupBy("job", "part").agg(F.sum("size").alias("s"), F.sum("media_size").alias("m"), F.count("*").alias("c"))
    before = Window.partitionBy("job").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("job", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "smc"])
    own = Window.partitionBy("job", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumns({"upto": F.sum("size").over(own), "media_upto": F.sum("media_size").over(own), "place": F.count("*").over(own) - 1}).join(sums, ["job", "part"])
    return found.select("job", "seq", "size", "media", "media_size", (F.col("upto") + F.col("s0")).alias("upto"), (F.col("media_upto") + F.col("m0")).alias("media_upto"), (F.col("place") + F.col("c0")).alias("place"), "used", "media_used"), placed


def admitted(rows: DataFrame, most_bytes: int, media_bytes: int | None = None, unknown: int = 0, stretch: int = STRETCH) -> DataFrame:
    """``rows(job, seq, size, media)`` with ``admitted``: in order of seq, each that fits in what the job's admitted ones left of ``most_bytes``.

    media is audio, video or null; admitted media must also fit in ``media_bytes`` together, videos in what that leaves for audio (:func:`video_limit`). A null size reserves ``unknown`` bytes; a negative one counts as none. seq is a key within a job; jobs aren't
    null. The result is that of going through each job row by row; no job is one task's work, but for stretches of ``stretch`` rows.
    """
    spark, video = rows.sparkSession, video_limit(media_bytes)
    kind = rows.schema["job"].dataType.simpleString()
    size = F.greatest(F.coalesce("size", F.lit(unknown)).cast("long"), F.lit(0))
    limited = F.col("media").isNotNull() & F.lit(media_bytes is not None)
    own = rows.select("job", F.col("seq").cast("long").alias("seq"), size.alias("size"), "media", F.when(limited, size).otherwise(0).cast("long").alias("media_size"))
    pending = written(own, "pending")
    state = written(pending.select("job").distinct().select("job", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("media_used")), "state")
    taken = []

    def cap() -> Column:
        return F.when(F.col("media") == "video", F.lit(video)).otherwise(F.lit(media_bytes)).cast("long")

    def fits(used: Column, media_used: Column) -> Column:
        return (used <= most_bytes) & F.coalesce((F.col("media_size") == 0) & F.col("media").isNull() | (media_used <= cap()), F.lit(True))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        used, media_used, ok = int(part["used"].iloc[0]), int(part["media_used"].iloc[0]), []
        for n, media in zip(part["size"].tolist(), part["media"].tolist(), strict=True):
            counts = media_bytes is not None and isinstance(media, str)
            yes = used + n <= most_bytes and (not counts or media_used + n <= (video if media == "video" else media_bytes))
            used += n if yes else 0
            media_used += n if yes and counts else 0
            ok.append(yes)
        return pd.DataFrame({"job": part["job"], "seq": part["seq"], "ok": ok, "size": part["size"], "media_size": part["media_size"]})

    while pending.limit(1).count():
        open_ = pending.join(state, "job")
        open_ = open_.where(fits(F.col("used") + F.col("size"), F.col("media_used") + F.col("media_size")))  # others never fit again
        summed, placed = _prefixed(open_)
        summed = written(summed, "summed")
        whole = fits(F.col("used") + F.col("upto"), F.col("media_used") + F.col("media_upto"))
        stops = small(written(summed.where(~whole).groupBy("job").agg(F.min("place").alias("stop")), "stops"))
        parted = summed.join(stops, "job", "left")
        bulk = parted.where(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
        bulk_sums = bulk.groupBy("job").agg(F.sum("size").alias("s"), F.sum("media_size").alias("m"))
        here = parted.where((F.col("place") >= F.col("stop")) & (F.col("place") < F.col("stop") + stretch)).join(bulk_sums, "job", "left")
        here = here.select("job", "seq", "size", "media", "media_size", (F.col("used") + F.coalesce("s", F.lit(0))).alias("used"), (F.col("media_used") + F.coalesce("m", F.lit(0))).alias("media_used"))
        told = written(here.groupBy("job").applyInPandas(fold, f"job {kind}, seq long, ok boolean, size long, media_size long"), "told")
        new = written(bulk.select("job", "seq", "size", "media_size").unionByName(told.where("ok").select("job", "seq", "size", "media_size")), "taken")
        rest = written(parted.where(F.col("place") >= F.col("stop") + stretch).select("job", "seq", "size", "media", "media_size"), "pending")
        grown = new.groupBy("job").agg(F.sum("size").alias("s"), F.sum("media_size").alias("m"))
        later = written(state.join(grown, "job", "left").select("job", (F.col("used") + F.coalesce("s", F.lit(0))).alias("used"), (F.col("media_used") + F.coalesce("m", F.lit(0))).alias("media_used")), "state")
        dropped(pending, state, placed, summed, told)
        pending, state = rest, later
        taken.append(new.select("job", "seq", F.lit(True).alias("_ok")))
    if not taken:
        return rows.withColumn("admitted", F.lit(False))
    all_ = taken[0]
    for t in taken[1:]:
        all_ = all_.unionByName(t)
    return rows.join(all_, ["job", "seq"], "left").select(*rows.columns, F.coalesce("_ok", F.lit(False)).alias("admitted"))
