"""Benchmark decontamination: which documents contain which test items.

Containment search in the manner of an LSH ensemble: items are put into partitions by size, and each partition has its own
threshold on the MinHash side. A short item inside a long document has a Jaccard similarity near zero, where bands of several
rows miss; so bands have one row, an item's bands are its k smallest shingle hashes, and a document offers all of
its hashes. With k = size - ceil(threshold * size) + 1 at the partition's least size and up, a document that holds the threshold share of an
item holds one of the k for certain: no link is lost. Documents with fewer shingles than an item needs are left out.
Every candidate is then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, once, shingles, small, words, written

WIDTH, THRESHOLD = 5, 0.8


def _shingled(df: DataFrame, keys: list, text: str) -> DataFrame:
    """keys and ``w``, the lower-cased words."""
    return df.select(*keys, once(words(ascii_lower(df[text]))).alias("w"))


def _hashes() -> Column:
    return once(F.array_distinct(shingles(F.col("w"), WIDTH, lambda run: F.xxhash64(*run))))


def _texts() -> Column:
    return once(F.array_distinct(shingles(F.col("w"), WIDTH, lambda run: F.concat_ws(" ", *run))))


def item_bands(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(hash, item, need)``: the bands of each item and the shingles that a document must share with it.

    ``items`` has the columns item and w. The size partition is the power of two below the item's number of shingles; the bands of
    an item number its missable shingles plus one, rounded up to those of the largest item of its partition that has as many.
    """
    sized = items.select("item", _hashes().alias("h")).where("size(h) > 0").withColumn("n", F.size("h"))
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    part = sized.withColumn("need", need).withColumn("partition", F.floor(F.log2("n")).cast("int"))
    top = 2 ** (F.col("partition") + 1) - 1
    bands = F.least(F.col("n"), F.greatest(F.col("n") - F.col("need"), (top * (1 - threshold)).cast("int")) + 1)
    return part.select("item", "need", F.explode(F.slice(F.sort_array("h"), F.lit(1), bands.cast("int"))).alias("hash"))


def contained(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Pairs of a document and an item of which it holds ``threshold`` of the distinct 5-word shingles, or more.

    Columns: doc, key (hash of the document's text; rows that share an id stay apart by it), item, n_item, n_common, containment.
    Words are runs between white space, A-Z lower-cased; a text of fewer than five words is one shingle, so it matches only
    such a text. Null and blank texts match nothing. Equal rows give one pair. Null ids are an id like any other.
    """
    own = docs.select(F.col(id).alias("doc"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    tests = written(_shingled(items, [F.col(item).alias("item")], item_text).distinct(), "items")
    bands = small(written(item_bands(tests, threshold), "item-bands"))
    offered = _shingled(own, ["doc", "key"], "text").select("doc", "key", _hashes().alias("h"))
    offered = offered.select("doc", "key", F.size("h").alias("n"), F.explode("h").alias("hash"))
    found = offered.join(bands, "hash").where("n >= need").select("doc", "key", "item").distinct()
    found = written(found, "candidates")

    some = small(written(found.select("doc", "key").distinct(), "candidate-documents"))
    of_doc = own.join(some, own["doc"].eqNullSafe(some["doc"]) & (own["key"] == some["key"]), "left_semi").distinct()
    of_doc = _shingled(of_doc, ["doc", "key"], "text").select("doc", "key", F.explode(_texts()).alias("shingle"))
    of_item = tests.select("item", _texts().alias("s")).select("item", F.size("s").alias("n_item"), F.explode("s").alias("shingle"))
    of_item = small(written(of_item.distinct(), "item-shingles"))
    shared = of_doc.join(of_item, "shingle").groupBy("doc", "key", "item", "n_item").agg(F.count("*").alias("n_common"))
    pair = shared.alias("s").join(
        found.alias("f"), F.expr("s.doc <=> f.doc and s.key = f.key and s.item <=> f.item"), "left_semi"
    )
    share = F.col("n_common") / F.col("n_item")
    return pair.withColumn("containment", share).where(F.col("n_common") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9))


def decontaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    leaks = small(written(contained(docs, items, id, text, **names).select("doc", "key").distinct(), "leaks"))
    return docs.join(leaks, docs[id].eqNullSafe(leaks["doc"]) & (F.xxhash64(docs[text]) == leaks["key"]), "left_anti")
