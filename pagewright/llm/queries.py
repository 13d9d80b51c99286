"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, huffman, language, licenses, lines, lm, merkle, mixing, pii, quality, simhash, tokencount
from .oracles import ORACLES  # noqa: F401  (read by the registry)

#: Key of the pseudonyms in the registered query; a real run has a secret one.
KEY = "example-key"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.quality(docs).select(
        "doc_id",
        *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_clean_lines", "clean_chars")],
    )


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contained(_documents(spark, sf_dir), items)
    pair = found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_common", "containment")
    return pair.distinct()


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymised(docs, KEY)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = huffman.round_trip(_documents(spark, sf_dir))
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_counts(_documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = licenses.licenses(docs)
    return found.select("doc_id", "license.name", "license.template", "license.containment", "license.first_word")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return lines.deduplicated(docs)


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.scores(_documents(spark, sf_dir))
    return found.withColumnRenamed("id", "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(_documents(spark, sf_dir).select("doc_id", "text"))
    hashed = lambda text: F.sha2(text, 256)
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", hashed(F.col("fim.output")).alias("output_sha256"), hashed(back).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), merkle.leaf(*[F.col(c) for c in columns[:-1]], F.replace("text", F.lit("\n"), F.lit(""))))
    rows = merkle.manifest(docs, columns, more=tampered)
    again = merkle.folded(F.coalesce("more", "node"), F.col("path"))
    found = rows.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = language.predicted(docs.select("doc_id", "text"), language.fitted(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_simhash_groups, op3_benchmark_leaks, op4_pseudonyms, op5_token_files,
        op6_source_mix, op7_token_counts, op8_license_scan, op9_line_templates, op10_context_mixing,
        op11_fill_in_middle, op12_merkle_manifest, op13_language_id,
    )
}

