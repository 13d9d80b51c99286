"""Token output: canonical length-limited Huffman coding of ids, in blocks that are decoded on their own.

A file set has three tables, all Parquet: ``codes`` (id, bits: from which the canonical code follows), ``blocks`` (part, block, before,
doc_ids, n_tokens, n_bytes, payload, marks). A block holds whole documents in ascending id; each starts on a byte. marks has, for every document,
the bits of each run of 64 tokens but the last: with them a decoder starts at any run. Documents of a block are all decoded together, one
table look-up for each run and step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, dropped, new_path, written
from .tokenize import Encoder, vocabulary_file

RUN, MOST_BITS, BLOCK_TOKENS = 64, 20, 1 << 19
#: Bytes of a batch of texts that a task gets.
BATCH_BYTES = 8 << 20
#: Tokens of a range of ids, which one task packs.
PART_TOKENS = 1 << 23
END = 2


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Bits of each symbol's code: the least total of all codes of at most ``most`` bits (package-merge); 0 for unused symbols."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols don't fit in codes of {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    flags, items = [], leaves
    for level in range(most):
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
            items = np.concatenate([leaves, pairs])
            order = np.argsort(items, kind="stable")
            items, leaf = items[order], order < len(leaves)
        else:
            leaf = np.ones(len(leaves), bool)
        flags.append(leaf)
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(flags):
        n = int(leaf[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[used] = bits
    return out


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol)."""
    codes, code, last = np.zeros(len(bits), np.uint32), 0, 0
    used = np.flatnonzero(bits)
    for s in used[np.lexsort((used, bits[used]))].tolist():
        code <<= int(bits[s]) - last
        last = int(bits[s])
        codes[s] = code
        code += 1
    return codes


def encode(ids: np.ndarray, starts: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes of documents one after another, each from a new byte; bytes of each document; bits before each token in its document.

    starts: first token of each document.
    """
    if not len(ids):
        return b"", np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
    size = bits[ids].astype(np.int64)
    upto = np.cumsum(size)
    counts = np.diff(np.append(starts, len(ids)))
    base = (upto - size)[np.minimum(starts, len(ids) - 1)]
    in_doc = upto - size - np.repeat(base, counts)
    ends = np.append(upto, 0)[np.append(starts[1:], len(ids)) - 1]
    n_bytes = np.where(counts > 0, (ends - base + 7) // 8, 0)
    at = in_doc + np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, counts)
    byte, word = at >> 3, codes[ids].astype(np.uint64) << (32 - (at & 7) - size).astype(np.uint64)
    first = np.flatnonzero(np.diff(byte, prepend=-1))
    word, byte = np.add.reduceat(word, first), byte[first]
    out = np.zeros(int(n_bytes.sum()) + 4, np.uint8)
    for k in range(4):
        out[byte + k] |= ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:-4].tobytes(), n_bytes, in_doc


class Decoder:
    def __init__(self, bits: np.ndarray):
        self.width = max(1, int(bits.max(initial=0)))
        used = np.flatnonzero(bits)
        used = used[np.lexsort((used, bits[used]))]
        spans = np.left_shift(1, self.width - bits[used].astype(np.int64))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.bits = np.ones(1 << self.width, np.uint8)
        self.symbol[: spans.sum()] = np.repeat(used, spans)
        self.bits[: spans.sum()] = np.repeat(bits[used], spans)

    def decode(self, payload: bytes, n_tokens: np.ndarray, n_bytes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """All ids of a block, one document after another."""
        runs = (n_tokens + RUN - 1) // RUN
        total = int(n_tokens.sum())
        out = np.zeros(total, np.uint32)
        if not total:
            return out
        doc = np.repeat(np.arange(len(runs)), runs)
        first_run = np.cumsum(runs) - runs
        place = np.arange(len(doc)) - first_run[doc]
        step = np.zeros(len(doc), np.int64)
        step[place > 0] = marks
        inside = np.cumsum(step)
        at = inside - inside[first_run[doc]] + (np.cumsum(n_bytes) - n_bytes)[doc] * 8
        start = (np.cumsum(n_tokens) - n_tokens)[doc] + place * RUN
        left = np.minimum(RUN, n_tokens[doc] - place * RUN)
        raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        order = np.argsort(-left, kind="stable")
        at, start, left = at[order], start[order], left[order]
        for k in range(RUN):
            n = int(np.searchsorted(-left, -k, "left"))
            if not n:
                break
            key = (window[at[:n] >> 3] >> (32 - self.width - (at[:n] & 7)).astype(np.uint32)) & np.uint32((1 << self.width) - 1)
            out[start[:n] + k] = self.symbol[key]
            at[:n] += self.bits[key]
        return out


def token_table(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """A written table ``(id, ids, wide)``: each text's ids and the end id as bytes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or vocabulary_file())

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(shared.value)
        for rows in batches:
            ids = encoder.encode_ended(rows.column(1), end)
            wide = pa.array(np.full(len(ids), encoder.dtype.itemsize, np.int32))
            yield pa.RecordBatch.from_arrays([rows.column(0), ids, wide], ["id", "ids", "wide"])
        pa.default_memory_pool().release_unused()  # the worker process stays for other tasks

    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    with batches_of(spark, BATCH_BYTES):
        return written(own.mapInArrow(tokens, f"id {kind}, ids binary, wide int"), "ids")


def _null_safe(df: DataFrame, kind: str) -> DataFrame:
    """Ids as bytes of their text: pandas would turn a column of whole numbers with a null into floats."""
    return df.withColumn("id", F.col("id").cast("string").cast("binary"))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    Encoder.forget()  # all texts are encoded by now
    total = np.zeros(0, np.int64)
    for rows in batches:
        for raw, wide in zip(rows["ids"], rows["wide"], strict=True):
            c = np.bincount(np.frombuffer(raw, f"<u{wide}"))
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pd.DataFrame({"id": used, "n": total[used]})


def write_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> None:
    """Writes the texts' ids to ``path`` in this module's format, in ascending id.

    Null texts are empty: one end id. Null ids come first. Rows with equal ids follow one another, ordered by a hash of their ids, and equal rows are all written.
    An empty table gives files without rows. The counts have a row for each id of the vocabulary at most, and only they go to the driver.
    """
    table = token_table(docs, id, text, vocabulary, end)
    spark = docs.sparkSession
    with batches_of(spark, BATCH_BYTES):
        counts = table.select("ids", "wide").mapInPandas(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    bits = code_lengths(total)
    used = np.flatnonzero(bits)
    spark.createDataFrame(pd.DataFrame({"id": used, "bits": bits[used].astype(np.int32)}), "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((bits, canonical(bits)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def made() -> pd.DataFrame:
            nonlocal block, before
            ids = np.concatenate([np.frombuffer(raw, f"<u{wide}") for _, raw, wide in held])
            counts = np.array([len(raw) // wide for _, raw, wide in held], np.int64)
            starts = np.cumsum(counts) - counts
            payload, n_bytes, in_doc = encode(ids, starts, *shared.value)
            place = np.arange(len(ids)) - np.repeat(starts, counts)
            marked = in_doc[place % RUN == 0]
            new = place[place % RUN == 0] == 0
            marks = np.diff(marked, prepend=0)[~new].astype("<u2").tobytes()
            row = pd.DataFrame({"part": [part], "block": [block], "before": [before], "doc_ids": [[x for x, _, _ in held]], "n_tokens": [counts.tolist()], "n_bytes": [n_bytes.tolist()], "payload": [payload], "marks": [marks]})
            block += 1
            before += int(counts.sum())
            return row

        for rows in batches:
            for x, raw, wide in zip(rows["id"], rows["ids"], rows["wide"], strict=True):
                held.append((None if x is None else x.decode(), raw, wide))
                size += len(raw) // wide
                if size >= BLOCK_TOKENS:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()
        pa.default_memory_pool().release_unused()

    n = max(spark.sparkContext.defaultParallelism, -(-int(total.sum()) // PART_TOKENS))
    ordered = table.withColumn("h", F.xxhash64("ids")).repartitionByRange(n, F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    kind = docs.schema[id].dataType.simpleString()
    packed = _null_safe(ordered.select("id", "ids", "wide"), kind).mapInPandas(
        pack, "part int, block int, before long, doc_ids array<string>, n_tokens array<long>, n_bytes array<long>, payload binary, marks binary"
    )
    with batches_of(spark, BATCH_BYTES):
        packed.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>")).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(spark, table)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of all documents, from the files alone; ids are little-endian unsigned 32-bit."""
    blocks = spark.read.parquet(f"{path}/blocks")
    codes = spark.read.parquet(f"{path}/codes").toPandas()
    bits = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.uint8)
    bits[codes["id"].to_numpy(np.int64)] = codes["bits"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    offset = totals.withColumn("offset", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "offset")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Encoder.forget()
        decoder = Decoder(shared.value)
        for rows in batches:
            for r in rows.itertuples(index=False):
                n = np.asarray(r.n_tokens, np.int64)
                ids = decoder.decode(r.payload, n, np.asarray(r.n_bytes, np.int64), np.frombuffer(r.marks, "<u2")).astype("<u4")
                ends = np.cumsum(n)
                raw = ids.tobytes()
                yield pd.DataFrame({"part": r.part, "id": list(r.doc_ids), "start": r.before + ends - n, "n_tokens": n, "ids": [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]})

    plain = blocks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).drop("block")
    out = plain.mapInPandas(unpack, "part int, id string, start long, n_tokens long, ids binary")
    out = out.join(F.broadcast(offset), "part")
    return out.select(F.col("id").cast(kind).alias("id"), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Writes the documents' ids to a new folder and returns ``read_tokens`` of it."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id, text, vocabulary)
    return read_tokens(docs.sparkSession, path)
