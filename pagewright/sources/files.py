"""Files of a mirror as tables: JSON documents of one version, and texts that can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20


def json_documents(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The JSON documents below a path, a row each; a document that breaks the schema, or with ``version`` has another one in its field ``version``, fails the job."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if version is None:
        return rows
    odd = F.concat(F.lit("unknown version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))
    return rows.withColumn("version", F.when(F.col("version") == version, F.col("version")).otherwise(F.raise_error(odd).cast(rows.schema["version"].dataType)))


def texts(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(file, length, text, problem)`` of the files below a path: too_large, whose contents are not read, or not_utf8, or null with the text."""
    files = spark.read.format("binaryFile").load(path)
    read = files.where(F.col("length") <= most_bytes)
    plain = F.col("content").cast("string")
    good = F.is_valid_utf8(plain)
    few = read.select(F.col("path").alias("file"), "length", F.when(good, plain).alias("text"), F.when(~good, "not_utf8").alias("problem"))
    large = files.select("path", "length").where(F.col("length") > most_bytes).select(F.col("path").alias("file"), "length", F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("problem"))
    return few.unionByName(large)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Writes a manifest as JSON lines, in place of what was there: Spark's committer shows it whole or not at all."""
    rows.write.mode("overwrite").json(path)
