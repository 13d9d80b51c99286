"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, written

#: Tasks among which the links of one node are dealt.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Star contraction: each round first links a node's larger neighbours to the smallest node of its neighbourhood, then
    does the same with the smaller ones, until every edge points at its root. Each round is two aggregations with
    map-side combine and a join in which a hub's links are salted. Edges from a node to itself and
    repeated edges do no harm; an empty graph gives no rows.
    """
    now = written(edges.select("a", "b").where("a <> b"), "edges")
    known = None
    while True:
        large = _star(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        step = written(_star(large, larger=False).distinct(), "edges")
        size, total = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now.sparkSession, now)
        now = step
        if (size, total) == known or size == 0:
            break
        known = (size, total)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Edges (greater, smaller) after one star operation; ``links`` holds both directions for the larger star."""
    if not larger:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = written(links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    joined = _joined(links, least)
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.where("m < a").select("a", F.col("m").alias("b"))
        )
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )


def _joined(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` with the ``m`` of their ``a``. A hub's links are dealt to SALTS tasks by their other end; a small ``least`` goes to all."""
    marked = small(least)
    if marked is not least:
        return links.join(marked, "a")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(salted, ["a", "salt"]).drop("salt")
