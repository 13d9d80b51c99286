"""Merkle manifest of a table: a tree of hashes for each source, a tree of their roots on top, and a proof for each row.

Rows are ranked within their sources by a range partitioning and counts a partition. Blocks of consecutive leaves are reduced in the tasks, level by level, and
again while many nodes remain. The small rest, a top tree of a bounded number of nodes, is built by the driver, which broadcasts each node's path to the root; the
tasks append it to the paths within the blocks and fold each row's leaf along the whole path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, once, small, written

#: Children of a node, and the levels that a block's leaves are reduced by.
ARITY, LEVELS = 3, 7
#: Nodes that the driver may hold; more are reduced by tasks once more.
TOP_NODES = 20_000
PATH = "array<struct<left: string, right: string>>"


def leaf(*columns: Column) -> Column:
    """The hash of values: each as ``-`` if null, otherwise its UTF-8 byte count, a colon and itself."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof(path: Column) -> Column:
    """The hash of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ranked(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows, and the written tables that they are read from. The rows: ``(tree, id, node, more)`` with rank, the row's place in its tree, and n, the tree's rows. Equal rows may be split over partitions, so no tree or id is too large for one."""
    spark = leaves.sparkSession
    order = [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("node").asc(), F.col("tie").asc()]
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = written(dealt.drop("tie").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "merkle-ordered")
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(F.col("tree").alias("of"), F.col("part").alias("at"), F.col("first"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n")), "merkle-runs")
    found = placed.join(small(runs), (F.col("part") == F.col("at")) & F.col("tree").eqNullSafe(F.col("of")))
    return found.select("tree", "id", "node", "more", (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "n"), [placed, runs]


def _raised(level: Column) -> Column:
    """The hashes of each ARITY consecutive nodes."""
    last = F.floor((F.size(level) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(level, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _reduced(nodes: DataFrame, name: str, levels: int) -> DataFrame:
    """Blocks of consecutive nodes of a tree: ``(tree, block, n, up, node, levels, rows)``; levels are the hashes from the block's rows upwards, up says how many of them the tree has."""
    row = F.struct("rank", "id", "node", "more")
    blocks = nodes.groupBy("tree", F.floor(F.col("rank") / ARITY**levels).cast("long").alias("block"), "n").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    blocks = blocks.withColumn("level0", once(F.transform("rows", lambda r: r["node"])))
    for k in range(levels):
        blocks = blocks.withColumn(f"level{k + 1}", once(_raised(F.col(f"level{k}"))))
    up = F.lit(levels)
    for k in reversed(range(levels)):
        up = F.when(F.col("n") <= ARITY**k, k).otherwise(up)
    all_levels = F.array(*[f"level{k}" for k in range(levels + 1)])
    blocks = blocks.select("tree", "block", "n", up.alias("up"), all_levels.alias("levels"), "rows")
    return written(blocks.select("tree", "block", "n", "up", F.get(F.get("levels", F.col("up")), F.lit(0)).alias("node"), F.slice("levels", 1, levels).alias("levels"), "rows"), name)


def _paths(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(tree, rank, id, node, more, path, subroot, root)`` of the rows of blocks; ``above`` has the path from each block's node on."""

    def step(level: int, place: Column) -> Column:
        at = F.floor(place / ARITY**level).cast("int")
        mine = at % ARITY
        left = F.slice(F.get("levels", F.lit(level)), at - mine + 1, mine)
        right = F.slice(F.get("levels", F.lit(level)), at + 2, ARITY - 1 - mine)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    joined = blocks.join(above, F.col("tree").eqNullSafe(F.col("top_tree")) & (F.col("block") == F.col("top_rank")))
    own = lambda i: F.slice(F.array(*[step(k, i) for k in range(levels)]), F.lit(1), F.col("up"))
    rows = F.transform("rows", lambda r, i: F.struct(r["rank"].alias("rank"), r["id"].alias("id"), r["node"].alias("node"), r["more"].alias("more"), own(i).alias("path")))
    found = joined.select("tree", F.explode(once(rows)).alias("r"), "suffix", "subroot", "root")
    return found.select("tree", "r.rank", "r.id", "r.node", "r.more", F.concat("r.path", F.col("suffix").cast(PATH)).alias("path"), "subroot", "root")


def _above(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("tree").alias("top_tree"), F.col("rank").alias("top_rank"), F.col("path").alias("suffix"), "subroot", "root")


def _tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of consecutive nodes, and each node's path to it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        groups = [nodes[i : i + ARITY] for i in range(0, len(nodes), ARITY)]
        for path, i in zip(paths, at, strict=True):
            group, mine = groups[i // ARITY], i % ARITY
            path.append(("".join(group[:mine]), "".join(group[mine + 1 :])))
        nodes, at = [hashlib.sha256("".join(g).encode()).hexdigest() for g in groups], [i // ARITY for i in at]
    return nodes[0], paths


def _top(spark: SparkSession, nodes: DataFrame, joined: bool) -> DataFrame:
    """The paths above at most TOP_NODES nodes, made by the driver: each tree's own, and unless ``joined`` (there is one tree, of roots of trees) the tree of the trees' roots."""
    trees: dict = {}
    for r in sorted(nodes.select("tree", "block", "node").collect(), key=lambda r: (r["tree"] is not None, (r["tree"] or "").encode(), r["block"])):
        trees.setdefault(r["tree"], []).append(r)
    made = {t: _tree([r["node"] for r in rows]) for t, rows in trees.items()}
    root, paths = _tree([sub for sub, _ in made.values()]) if made else ("", [])
    out = [
        (t, r["block"], own + ([] if joined else path), made[t][0], root)
        for (t, rows), path in zip(trees.items(), paths, strict=True) for r, own in zip(rows, made[t][1], strict=True)
    ]
    return F.broadcast(spark.createDataFrame(out, f"top_tree string, top_rank long, suffix {PATH}, subroot string, root string"))


def _nodes(blocks: DataFrame, block: int) -> DataFrame:
    """The blocks' own nodes as the next round's rows."""
    n = F.when(F.col("n") > block, F.ceil(F.col("n") / block)).otherwise(1)
    return blocks.select("tree", F.lit(None).cast("string").alias("id"), "node", F.lit(None).cast("string").alias("more"), F.col("block").alias("rank"), n.cast("long").alias("n"))


def _proved(leaves: DataFrame, most: int, levels: int, joined: bool = False) -> DataFrame:
    """``(tree, rank, id, node, more, path, subroot, root)`` of the rows of a written table of leaves, which is deleted."""
    spark, block = leaves.sparkSession, ARITY**levels
    ranked, tables = _ranked(leaves)
    rounds = [_reduced(ranked, "merkle-blocks", levels)]
    dropped(spark, leaves, *tables)
    while True:
        nodes = rounds[-1].select("tree", "block", "n", "node")
        if nodes.limit(most + 1).count() <= most:
            above = _top(spark, nodes, joined)
            break
        if not nodes.where(F.col("n") > block).limit(1).count():  # roots of too many trees: they are one tree's leaves
            roots = nodes.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "node", F.lit(None).cast("string").alias("more"))
            over = _proved(written(roots, "merkle-roots"), most, levels, True)
            above = over.select(F.col("id").alias("top_tree"), F.lit(0).cast("long").alias("top_rank"), F.col("path").alias("suffix"), F.col("node").alias("subroot"), "root")
            break
        rounds.append(_reduced(_nodes(rounds[-1], block), "merkle-blocks", levels))
    for blocks in reversed(rounds[1:]):
        above = _above(written(_paths(blocks, above, levels), "merkle-paths"))
        dropped(spark, blocks)
    return _paths(rounds[0], above, levels)


def manifest(docs: DataFrame, columns: list[str], id: str = "doc_id", by: str = "source", more: Column | None = None, top_nodes: int = TOP_NODES, levels: int = LEVELS) -> DataFrame:
    """``(tree, rank, id, node, more, path, subroot, root)`` of each row: its source, its place there, its id, its leaf, the value of ``more`` (a string column, such as
    another leaf to be folded), its siblings up to the root, and the two roots.

    A leaf hashes ``columns``. Within a source rows stand by id, nulls first, rows of one id by their leaves; repeated rows stand side by side. Null is a source of
    its own, before the others. A source of one row has that row's leaf for its root. Texts are read once and of any length, and only their hashes are moved. Columns that
    aren't named are left out, so their names don't matter. An empty table gives no rows.
    """
    more = F.lit(None).cast("string") if more is None else more
    leaves = docs.select(F.col(by).cast("string").alias("tree"), F.col(id).alias("id"), leaf(*[F.col(c) for c in columns]).alias("node"), more.alias("more"))
    return _proved(written(leaves, "merkle-leaves"), top_nodes, levels)
