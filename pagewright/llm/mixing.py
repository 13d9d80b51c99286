"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are added up by membership pattern (the set of sources they belong to). Each pattern's words are capacity
that a flow routes to source quotas; a word's second use costs more than its first and its third more than its second. Then documents are
selected by a seeded hash until each pattern's flow is used. Only the pattern table and the flow are on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"

#: Documents that a bin of the selection holds on average.
BIN_ROWS = 1024


def targets(sizes: Sequence[float], weights: Sequence[float] = WEIGHTS, most: int = MOST) -> list[float]:
    """The total shared by weight; no target above ``most`` times its source, the excess shared again by weight."""
    shares = [weights[i % len(weights)] for i in range(len(sizes))]
    total, full = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - float(sum(most * sizes[i] for i in sorted(full)))
        of = float(sum(shares[i] for i in free))
        over = {i for i in free if shares[i] * rest / of > most * sizes[i]}
        if not over:
            return [float(most * sizes[i]) if i in full else shares[i] * rest / of for i in range(len(sizes))]
        full |= over


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each edge (from, to, capacity, cost): the largest at the least cost, by successive shortest paths."""
    to, cap, cost = [], [], []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c, w in edges:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
    potential = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, start)]
        far[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                y, reach = to[e], d + cost[e] + potential[x] - potential[to[e]]
                if cap[e] and (far[y] is None or reach < far[y]):
                    far[y], via[y] = reach, e
                    heapq.heappush(heap, (reach, y))
        if far[end] is None:
            return [cap[2 * i + 1] for i in range(len(edges))]
        longest = max(d for d in far if d is not None)
        potential = [p + (longest if d is None else d) for p, d in zip(potential, far, strict=True)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount


def routed(patterns: list[tuple[tuple, int]], quotas: dict, most: int = MOST) -> list[int]:
    """Words to take of each (sources, words) pattern so that each source's quota is met at the least repetition."""
    names = list(quotas)
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    edges = []
    for i, (sources, size) in enumerate(patterns):
        edges += [(0, 1 + i, size, k * k) for k in range(most)]
        edges += [(1 + i, at[s], most * size, 0) for s in sources]
    edges += [(at[s], end, quotas[s], 0) for s in names]
    flow = min_cost_flow(end + 1, edges, 0, end)
    starts: dict[int, int] = {}
    for (a, b, _, _), f in zip(edges, flow, strict=True):
        if a == 0:
            starts[b] = starts.get(b, 0) + f
    return [starts.get(1 + i, 0) for i in range(len(patterns))]


def seeded(id: Column, seed: str) -> Column:
    """A document's place in the selection: hex digits that look random."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(id.cast("string"), F.lit("null"))))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", sources: Column | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with the struct ``mix``: size, source_size, target, taken.

    ``sources`` is an array of source names, by default the one in the column source; null is a source, and comes last; a null or empty array is that source. size is
    the words of the text, null having none. source_size and target are those of the document's first source. taken is the words that
    the mix takes of the document, its repeats counted, ``most`` times its size at most: whole passes over a pattern's
    documents, and of one more pass those first by a seeded hash, up to the one nearest to what is left. Reruns agree. Rows with equal ids and sizes are
    ordered by a hash of the text and may be taken differently if they still tie. Empty tables give empty tables; a column named mix is replaced.
    """
    own = [c for c in docs.columns if c.lower() != "mix"]
    none = F.array(F.lit(None).cast("string"))
    member = F.array_sort(F.array_distinct(sources.cast("array<string>"))) if sources is not None else F.array(docs["source"])
    member = F.when(F.coalesce(F.size(member), F.lit(0)) > 0, member).otherwise(none)
    rows = docs.select(
        F.struct(*own).alias("row"), member.cast("array<string>").alias("pattern"), F.size(words(docs[text])).cast("long").alias("size"),
        F.concat(seeded(docs[id], seed), F.md5(F.coalesce(docs[text], F.lit("")))).alias("place"),
    )
    table = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = sorted(((tuple(r["pattern"]), r["size"], r["n"]) for r in table.collect()), key=lambda r: [(s is None, (s or "").encode()) for s in r[0]])
    names = sorted({s for p, _, _ in found for s in p}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size for p, size, _ in found if s in p) for s in names]
    goals = dict(zip(names, targets(sizes, weights, most) if sum(sizes) else [0.0] * len(names), strict=True))
    flow = routed([(p, size) for p, size, _ in found], {s: int(g) for s, g in goals.items()}, most)
    bins = 16 ** max(1, (max([1, *(n for _, _, n in found)]) // BIN_ROWS).bit_length() // 4 + 1)
    plan = [
        (list(p), *((f // size, f % size) if size else (0, 0)), dict(zip(names, sizes, strict=True))[p[0]], goals[p[0]])
        for (p, size, _), f in zip(found, flow, strict=True)
    ]
    spark = docs.sparkSession
    plan_table = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, passes long, rest long, source_size long, target double"))
    digits = len(f"{bins:x}") - 1

    # Which of the seeded order fit in the rest: by bins of the hash first, within the one bin that crosses it by rows.
    binned = rows.withColumn("bin", F.substring("place", 1, digits))
    order = Window.partitionBy("pattern").orderBy("bin")
    per_bin = binned.groupBy("pattern", "bin").agg(F.sum("size").alias("words"))
    per_bin = per_bin.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    cuts = per_bin.join(plan_table, _same(per_bin["pattern"], plan_table["pattern"]))
    cuts = cuts.where((F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest"))).select(
        per_bin["pattern"].alias("pattern"), "bin", (F.col("rest") - F.col("before")).alias("room")
    )
    cut = cuts.groupBy("pattern").agg(F.min_by(F.struct("bin", "room"), "bin").alias("cut"))
    cut = {tuple(r["pattern"]): r["cut"] for r in cut.collect()}
    plan = [(*p, cut[tuple(p[0])]["bin"] if tuple(p[0]) in cut else "g", cut[tuple(p[0])]["room"] if tuple(p[0]) in cut else 0) for p in plan]
    plan_table = F.broadcast(spark.createDataFrame(plan, "pattern array<string>, passes long, rest long, source_size long, target double, cut string, room long"))
    joined = binned.join(plan_table, _same(binned["pattern"], plan_table["pattern"])).select(binned["*"], *[plan_table[c] for c in plan_table.columns if c != "pattern"])
    crossing = joined.where("bin = cut").withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    crossing = crossing.withColumn("once", 2 * F.col("upto") - F.col("size") <= 2 * F.col("room")).drop("upto")
    both = joined.where("bin <> cut").withColumn("once", F.col("bin") < F.col("cut")).unionByName(crossing)
    taken = (F.col("passes") + F.col("once").cast("long")) * F.col("size")
    return both.select(*[F.col("row")[c].alias(c) for c in own], F.struct("size", "source_size", "target", taken.alias("taken")).alias("mix"))


def _same(a: Column, b: Column) -> Column:
    return F.to_json(F.struct(a)) == F.to_json(F.struct(b))


def selected(docs: DataFrame, id: str = "doc_id", text: str = "text", sources: Column | None = None, **how) -> DataFrame:
    """The mix as rows of ``docs``, with all their columns: each document as often as the mix takes it."""
    of = sources if sources is not None else F.array(docs["source"])
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).alias("_id"), F.col(text).alias("_text"), of.alias("_sources"))
    mix = mixed(rows, "_id", "_text", F.col("_sources"), **how)
    times = F.when(F.col("mix.size") > 0, F.floor(F.col("mix.taken") / F.col("mix.size"))).otherwise(F.lit(0)).cast("int")
    return mix.select("_row", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).select("_row.*")
