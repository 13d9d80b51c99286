"""SimHash near-duplicates with a Gray-order hierarchical index.

The index is a tree. Top: four masks, one for each 16-bit block of the fingerprint; of two fingerprints at most
three bits apart, one block at least is equal, so the groups that share a masked block hold every link. Below, a group's
fingerprints, sorted by Gray rank, are cut into leaves; the bits that all members of a leaf share are its mask and pattern. As many levels of nodes
as the largest group needs stand over the leaves, and sixteenths of a leaf under it, with the same factoring. Pairs of nodes are dropped from the top, with all that is below them, as soon as the
differences in the bits that both fix exceed the distance; only what is left is compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import ascii_lower, once, shingles, small, words, written
from .components import components

WIDTH, BITS, DISTANCE, BLOCK = 3, 64, 3, 16
LEAF, NODE, FANOUT = 256, 16, 16


@F.pandas_udf(LongType())
def _majority(hashes: pd.Series) -> pd.Series:
    """The bits that are set in over half the hashes of each row."""
    out = np.zeros(len(hashes), np.int64)
    for k, h in enumerate(hashes):
        if h is None or not len(h):
            continue
        bits = np.zeros(BITS, np.int64)
        for part in np.array_split(np.asarray(h, np.int64), len(h) // 65536 + 1):
            bits += np.unpackbits(part.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(bits * 2 > len(h)).view(">i8")[0]
    return pd.Series(out)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the 64 bits as a long: of the XXH64 of all 3-word shingles, those set in over half; zero for no words."""
    out = [c for c in docs.columns if c.lower() not in ("fp", "_w")]
    with_words = docs.select(*out, once(words(ascii_lower(docs[text]))).alias("_w"))
    hashes = shingles(F.col("_w"), WIDTH, lambda run: F.xxhash64(F.concat_ws(" ", *run)))
    return with_words.withColumn("_w", hashes).select(*out, _majority("_w").alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the Gray sequence, where neighbours differ by one bit."""
    x = fp.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _factor(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that all of a group share, and their values."""
    ones = np.array([np.bitwise_and.reduce(g) for g in groups], np.uint64)
    anys = np.array([np.bitwise_or.reduce(g) for g in groups], np.uint64)
    mask = ~(ones ^ anys)
    return mask, ones & mask


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of fingerprints within the distance, by nodes of Gray neighbours."""
    na, nb = (np.split(x, range(NODE, len(x), NODE)) for x in (a, b))
    (ma, va), (mb, vb) = _factor(na), _factor(nb)
    differences = np.bitwise_count((va[:, None] ^ vb[None]) & ma[:, None] & mb[None])
    left, right = [], []
    for i, j in zip(*np.nonzero(differences <= distance), strict=True):
        x, y = np.nonzero(np.bitwise_count(na[i][:, None] ^ nb[j][None]) <= distance)
        left.append(x + i * NODE)
        right.append(y + j * NODE)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _forest(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links x-y, a subset that connects the same values: fewer than the values at hand."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out[0].append(int(values[i]))
            out[1].append(int(values[j]))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one partition, sorted by (mask, block, rank), to leaves of at most LEAF fingerprints of one group."""
    rest = None

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows.groupby(["mask", "block"], sort=False)
        part = group.cumcount() // LEAF
        out = []
        for (mask, block, _), own in rows.groupby([rows["mask"], rows["block"], part], sort=False):
            fps = own["fp"].to_numpy(np.int64).view(np.uint64)
            m, v = _factor([fps])
            out.append((mask, block, int(own["rank"].iloc[0]), int(_signed(m)[0]), int(_signed(v)[0]), fps.tobytes()))
        return pd.DataFrame(out, columns=["mask", "block", "leaf", "shared", "pattern", "fps"])

    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        last = rows.iloc[-1:][["mask", "block"]].iloc[0] if len(rows) else None
        if last is None:
            continue
        open_ = (rows["mask"] == last["mask"]) & (rows["block"] == last["block"])
        keep = int(open_.sum()) % LEAF or LEAF
        rest = rows.iloc[len(rows) - min(keep, int(open_.sum())) :]
        if done := len(rows) - len(rest):
            yield cut(rows.iloc[:done])
    if rest is not None and len(rest):
        yield cut(rest)


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        a, b = [], []
        for raw in rows["fps"]:
            fps = np.frombuffer(raw, np.uint64)
            x, y = close_pairs(fps, fps)
            up = x < y
            p, q = _forest(_signed(fps), x[up], y[up])
            a += p
            b += q
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        a, b = [], []
        for one, two in zip(rows["fps"], rows["fps2"], strict=True):
            f, g = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            x, y = close_pairs(f, g)
            p, q = _forest(_signed(np.concatenate([f, g])), x, y + len(f))
            a += p
            b += q
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


@F.pandas_udf(LongType())
def _rank(fp: pd.Series, mask: pd.Series) -> pd.Series:
    """Gray rank of the fingerprint turned so that the masked block leads; its order as a signed number."""
    x, s = fp.to_numpy(np.int64).view(np.uint64), (mask.to_numpy() * BLOCK).astype(np.uint64)
    turned = np.where(s == 0, x, (x << s) | (x >> ((np.uint64(64) - s) % np.uint64(64))))
    return pd.Series(_signed(gray_rank(turned) ^ np.uint64(1 << 63)))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between the distinct values of ``fps(fp)`` that connect exactly those within DISTANCE bits.

    Within a leaf and within a pair of leaves only a spanning forest of the links is returned, so a dense group costs rows in
    proportion to its fingerprints and not to its pairs.
    """
    masks = BITS // BLOCK
    rows = fps.select("fp", F.explode(F.array(*[F.lit(k) for k in range(masks)])).alias("mask"))
    rows = rows.select("mask", F.expr(f"int(shiftrightunsigned(fp, {BLOCK} * ({masks - 1} - mask)) & {2**BLOCK - 1})").alias("block"), "fp")
    rows = rows.select("mask", "block", _rank("fp", "mask").alias("rank"), "fp")
    rows = rows.repartitionByRange("mask", "block", "rank").sortWithinPartitions("mask", "block", "rank")
    leaf = written(
        rows.mapInPandas(_leaves, "mask int, block int, leaf long, shared long, pattern long, fps binary"), "gray-leaves"
    )
    inside = leaf.where("length(fps) > 8").mapInPandas(_within, "a long, b long")
    pairs = _leaf_pairs(leaf)
    return inside.union(pairs.select("fps", "fps2").mapInPandas(_between, "a long, b long"))


def _leaf_pairs(leaf: DataFrame) -> DataFrame:
    """``(fps, fps2)`` of the pairs of leaves of a group that may hold a link.

    Nodes over leaves are a tree in each group: FANOUT neighbours in Gray order share a parent, which has the bits that all of them share. From the top, pairs of
    nodes whose shared bits differ in more than DISTANCE places are dropped with all that is below them; the children of the others are paired.
    """
    order = Window.partitionBy("mask", "block").orderBy("leaf")
    of_group = Window.partitionBy("mask", "block")
    level = leaf.withColumn("node", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(of_group)).where("n > 1")
    level = written(level.select("mask", "block", F.col("node").cast("long"), "shared", "pattern", "n", "fps"), "gray-nodes")
    levels, most = [level], level.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most > FANOUT:
        below = levels[-1].groupBy("mask", "block", F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.bit_and("shared").alias("shared"), F.bit_and("pattern").alias("ones"), F.bit_or("pattern").alias("any")
        )
        shared = F.col("shared").bitwiseAND(F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any"))))
        levels.append(written(below.select("mask", "block", "node", shared.alias("shared"), F.col("ones").bitwiseAND(shared).alias("pattern")), "gray-nodes"))
        most = -(-most // FANOUT)
    near = f"bit_count((pattern ^ pattern2) & shared & shared2) <= {DISTANCE}"
    keys = ["mask", "block", "node", "shared", "pattern"]
    twice = lambda df, *more: df.select("mask", "block", *[F.col(c).alias(c + "2") for c in (*keys[2:], *more)])
    top = levels[-1]
    pairs = top.select(keys).join(twice(top), ["mask", "block"]).where(f"node <= node2 and {near}").select("mask", "block", "node", "node2")
    for below in reversed(levels[:-1]):
        up = lambda df, c: df.withColumn("up" + c, F.floor(F.col("node" + c) / FANOUT))
        pairs = pairs.select("mask", "block", F.col("node").alias("up"), F.col("node2").alias("up2"))
        pairs = pairs.join(up(below.select(keys), ""), ["mask", "block", "up"]).join(up(twice(below), "2"), ["mask", "block", "up2"])
        pairs = pairs.where(f"node <= node2 and {near}").select("mask", "block", "node", "node2")
    pairs = pairs.where("node < node2").join(level.select("mask", "block", "node", "fps"), ["mask", "block", "node"])
    return pairs.join(level.select("mask", "block", F.col("node").alias("node2"), F.col("fps").alias("fps2")), ["mask", "block", "node2"])


def _groups(prints: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct value of the written ``prints(id, fp)``; root is a fingerprint of the component."""
    values = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    roots = components(links(values.select("fp")))
    parts = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = small(written(parts.groupBy("root").agg(F.min("first").alias("component_id")), "components"))
    return parts.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id, ``fp``, ``component_id``.

    component_id is the smallest id reachable over links of fingerprints at most three bits apart, equal ones included. Texts
    without words share fingerprint zero and are linked like any other. Null ids are kept and never name a component unless
    all of it is null; repeated rows give repeated rows; an empty table gives none.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    prints = written(fingerprint(own).select("id", "fp"), "fingerprints")
    by_print = _groups(prints).select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id), "fp", "component_id")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the row with the smallest id, with all its columns.

    Of rows that share a component's smallest id the first by a hash of all columns stays, once if it is repeated; null ids stay only in components without another id.
    An id that names rows of several components stays once for each of those that it is the smallest of. Who stays is settled on ids and
    hashes; texts are joined with the rows to drop, and moved only if those are many.
    """
    mark = F.xxhash64(*[F.col(c) for c in docs.columns])
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), mark.alias("mark"))
    prints = written(fingerprint(own).select("id", "mark", "fp"), "fingerprints")
    keys = prints.groupBy("id", "mark", "fp").agg(F.count("*").alias("n"))
    rooted = written(keys.join(_groups(prints.select("id", "fp")).select("fp", "root"), "fp").select("id", "mark", "n", "root"), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    first = small(written(first, "survivors"))
    judged = rooted.join(first, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))
    fate = judged.where("n > 1 or not stays").select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "stays")
    fate = small(written(fate, "dropped-copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).alias("_of"), mark.alias("_hash"))
    told = rows.join(fate, rows["_of"].eqNullSafe(fate["_id"]) & (rows["_hash"] == fate["_mark"]), "left")
    once_only = told.where("stays").groupBy("_id", "_mark").agg(F.first("_row").alias("_row"))  # equal rows only
    return told.where("stays is null").select("_row.*").unionByName(once_only.select("_row.*"))
