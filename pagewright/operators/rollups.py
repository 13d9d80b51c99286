"""Roll-ups with a clear winner, and reports over collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls


def strict_winner(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, n)``: each key's commonest value; a key whose first two tie has none."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(key).orderBy(F.desc("n"), value)
    ranked = counts.withColumn("_k", F.row_number().over(by)).withColumn("_next", F.lead("n").over(by))
    return ranked.where("_k = 1 and (_next is null or _next < n)").select(key, value, "n")


def best_base(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)``: each key's commonest value, of equals the shortest, then the first by its text."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.length(value), value)).alias(value))


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last record by ``order``, with all its columns; of several last ones that with the largest hash of its columns."""
    return records.groupBy(key).agg(F.max_by(F.struct(*records.columns), F.struct(order, F.xxhash64(*records.columns))).alias("_r")).select("_r.*")


def online_dependencies(rows: DataFrame, key: str, url: str) -> DataFrame:
    """``(key, urls, ignored)``: the distinct web URLs of at most 8192 characters, sorted and joined by blanks, and how many rows were none."""
    good = urls.is_web(F.col(url)) & (F.length(url) <= 8192)
    kept = F.array_join(F.array_sort(F.collect_set(F.when(good, F.col(url)))), " ")
    return rows.groupBy(key).agg(kept.alias("urls"), F.count_if(~F.coalesce(good, F.lit(False))).alias("ignored"))


def perceptual(checkpoints: DataFrame, key: str) -> DataFrame:
    """Counts of a run's comparisons by outcome; it passed if all of them match and there is one."""
    count = lambda s: F.count_if(F.col("outcome") == s)
    out = checkpoints.groupBy(key).agg(
        F.count_if(F.col("outcome").isin("match", "partial", "mismatch")).alias("compared"), count("match").alias("matched"),
        count("partial").alias("partial"), count("mismatch").alias("mismatched"), count("error").alias("errors"),
    )
    return out.withColumn("passed", (F.col("compared") > 0) & (F.col("matched") == F.col("compared")) & (F.col("errors") == 0))
