"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, huffman, mixing, quality, simhash
from pagewright.llm.common import deleted, new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; ``n_chars`` follows the text.

    Null, empty and blank texts go; repeated rows stay or go alike.
    """
    clean = quality.cleaned(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, null ids last; of equal ids the first by a hash of the row. No group is lost, whatever its ids."""
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and blank texts hold none. Items that are null or blank are held by none."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as its source's target asks, up to three times; a null source is one. Texts without words are not taken."""
    return mixing.selected(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written and read back: doc_id, start, n_tokens, ids_crc32, a row for each row; null texts are an end id alone."""
    back = huffman.round_trip(docs)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", quality_rules),
    ("near-duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", target_weights),
    ("tokens", token_files),
]
ORACLE_SQL = None  # SQL has neither the fingerprints' hash nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over what the one before kept, by way of Parquet in the shared folder; a stage's table is deleted once the next one's is written."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            deleted(spark, done)
        done = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # the token files are written by now
    deleted(spark, done)
    return out
