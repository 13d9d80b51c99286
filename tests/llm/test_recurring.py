"""Templates that documents share are found without a row for each document and template in a shuffle."""

from pyspark.sql import functions as F

from pagewright.llm import lines


def test_documents_of_a_template_are_not_shuffled_one_by_one(spark):
    rows = [("a", 1, 10), ("a", 1, 10), ("b", 1, 10), ("b", 1, 11), ("c", None, 10), ("c", 2, 10), ("d", None, None), ("d", None, None), ("e", 1, 5), ("e", 2, 5), ("e", 3, 5)]
    named = spark.createDataFrame(rows, "template string, id long, key long")
    found = {n: sorted(r["template"] for r in lines._recurring(named, n).collect()) for n in (1, 2, 3)}
    assert found == {1: ["a", "b", "c", "d", "e"], 2: ["b", "c", "e"], 3: ["e"]}
    big = spark.range(1000).select((F.col("id") % 3).alias("template"), "id", F.lit(1).alias("key"))
    plan = lines._recurring(big, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
