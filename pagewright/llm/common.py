"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a table that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 200_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value``, computed once for each row where it stands.

    The optimizer copies a deterministic expression into every filter and lambda that uses it; costly arrays are kept from that.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(text, UPPER, LOWER)


def shingles(w: Column, width: int, make) -> Column:
    """``make`` of each run of ``width`` words, repeats included; a shorter text is one run, an empty one gives null.

    ``make`` gets the list of word columns of a run. ``w`` should be a column, not a long expression.
    """
    runs = F.transform(
        F.sequence(F.lit(0), F.size(w) - width), lambda i: make([F.get(w, i + k) for k in range(width)])
    )
    whole = F.when(F.size(w) > 0, F.array(make([F.array_join(w, " ")])))
    return F.when(F.size(w) >= width, runs).otherwise(whole)


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset one below the warehouse; a cluster with neither shared is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and (warehouse.startswith(("file:", "/"))):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = warehouse + "/_work"
    return f"{shared.rstrip('/')}/pagewright"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and kept as a table in the shared folder; cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Tables written meanwhile send their Python tasks batches of about ``size`` bytes, or a row where that is larger: what a task holds doesn't grow with its input."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def released() -> None:
    """Gives the system what this process has freed: a worker that waits for its next task keeps it otherwise, beside what the executor holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        deleted(spark, *{f.rpartition("/")[0] for f in df.inputFiles()})


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``rows`` rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
