"""Language-model scoring by online logistic context mixing, on Spark.

:mod:`mixer` has the model: bits of texts, predicted by hashed contexts of the text before them, mixed by gated weights that are refined bit after bit. What it learns covers all training documents: counts of
contexts and of inputs are summed over tasks, in steps of FAN tables a group, and the weights are fitted on the sums. The tables have 2 ** mixer.MOST_SLOT_BITS slots for each order at most, whatever the input: what
a task and the driver can hold. Word counts, for the base score, are exact and grow with the corpus.

Documents are packed into chunks of CHUNK_BYTES, whose distinct words are counted over the corpus and answered chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import mixer
from .common import batches_of, dropped, released, written

CHUNK_BYTES, SCORE_BYTES = 4 << 20, 1 << 19
#: Bytes of texts that become words at once, and of a batch that a task gets: what a task holds besides its chunk.
SERIAL_BYTES, BATCH_BYTES = 1 << 19, 4 << 20
#: Text of a counting task: at least, and at most where there are over COUNT_TASKS.
TASK_BYTES, MOST_TASK_BYTES, COUNT_TASKS = 48 << 20, 1 << 30, 64
#: Blocks of a table, and tables that are added up in one group.
BLOCKS, FAN = 64, 16
MODULUS, HELD = 7, 2


def held_out(id: Column) -> Column:
    """crc32 of the id's text leaves HELD; a null id is for training."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % MODULUS == HELD, F.lit(False))


def _pieces(flat: np.ndarray) -> pa.DictionaryArray:
    """The tokens of serialised texts, each with the blank or newline after it."""
    ends = np.flatnonzero((flat == 32) | (flat == mixer.END)).astype(np.int32) + 1
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()


def _packed(rows: DataFrame) -> DataFrame:
    """Chunks of documents: their texts as :func:`mixer.serialised` gives them, their distinct tokens with training counts, and how often a training byte comes after a pair of kinds (:func:`mixer.after_pairs`, those that occur)."""
    schema = pa.schema(
        [
            ("chunk", pa.int64()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("flat", pa.binary()),
            ("vocabulary", pa.binary()), ("train", pa.list_(pa.int32())), ("after", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(batches)
        released()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, flats, size = [], [], [], [], 0
        after = np.zeros(mixer.PAIRS * 256, np.int32)

        def made() -> pa.RecordBatch:
            flat, n = np.concatenate(flats), np.concatenate(lengths)
            learns = ~np.array(held, bool)
            own = np.repeat(learns, n)
            tokens = _pieces(flat)
            ends = np.flatnonzero((flat == 32) | (flat == mixer.END))
            train = np.bincount(tokens.indices.to_numpy()[own[ends]], minlength=len(tokens.dictionary))
            # Each token has its blank or newline as the last byte, and no other.
            words = tokens.dictionary.buffers()[2][: pc.sum(pc.binary_length(tokens.dictionary)).as_py() - 1].to_pybytes().replace(b" ", b"\n")
            some = np.flatnonzero(after)
            row = {
                "chunk": (part << 32) + number, "ids": ids, "held": held, "lengths": n.astype(np.int32), "flat": flat.tobytes(), "vocabulary": words,
                "train": train.astype(np.int32), "after": some.astype(np.int32), "times": after[some],
            }
            after[:] = 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            texts = batch.column(2).fill_null(b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in mixer.pieces(sizes, SERIAL_BYTES):
                some, own = texts.slice(int(at[0]), len(at)), sizes[at]
                first = np.frombuffer(some.buffers()[1], np.int32)[some.offset]
                raw = np.frombuffer(some.buffers()[2], np.uint8)[first : first + own.sum()] if own.any() else np.zeros(0, np.uint8)
                flat, n = mixer.serialised(raw, np.cumsum(own))
                flats.append(flat)
                lengths.append(n)
                learns = ~batch.column(1).slice(int(at[0]), len(at)).to_numpy(zero_copy_only=False).astype(bool)
                np.add.at(after, mixer.after_pairs(flat, n)[np.repeat(learns, n)], np.int32(1))
                ids += batch.column(0).slice(int(at[0]), len(at)).to_pylist()
                held += batch.column(1).slice(int(at[0]), len(at)).to_pylist()
                size += len(flat)
                if size >= CHUNK_BYTES:
                    yield made()
                    released()
                    number += 1
                    ids, held, lengths, flats, size = [], [], [], [], 0
        if ids:
            yield made()

    return rows.mapInArrow(pack, "chunk long, ids array<string>, held array<boolean>, lengths array<int>, flat binary, vocabulary binary, train array<int>, after array<int>, times array<int>")


def _tables(chunks: DataFrame, code: mixer.Code, slots: int, tasks: int) -> DataFrame:
    """``(order, block, part, n)``: the tables of each counting task, in blocks; the last order is the histogram of inputs, the one after it that of matches."""
    shared = chunks.sparkSession.sparkContext.broadcast(code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(batches)
        released()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, part = mixer.Learner(shared.value, slots), TaskContext.get().partitionId()
        for batch in batches:
            for lengths, held, flat in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                n = np.asarray(lengths.values)
                learns = ~np.asarray(held.values.to_numpy(zero_copy_only=False), bool)
                own = np.frombuffer(flat.as_buffer(), np.uint8)[np.repeat(learns, n)]
                n = n[learns].astype(np.int64)
                ends = np.cumsum(n)
                for at in mixer.pieces(n, mixer.PIECE):
                    learner.add(own[ends[at[0]] - n[at[0]] : ends[at[-1]]], n[at])
        if learner.seen:
            for order, table in enumerate([*learner.counts, learner.cells, learner.matches]):
                for block, some in enumerate(np.split(table, BLOCKS if len(table) % BLOCKS == 0 else 1)):
                    if some.any():
                        yield pa.RecordBatch.from_pydict({"order": pa.array([order], pa.int32()), "block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([some.astype("<i8" if order >= len(learner.counts) else "<i4").tobytes()])})

    return chunks.select("lengths", "held", "flat").coalesce(tasks).mapInArrow(count, "order int, block int, part int, n binary")


def _summed(last: bool, slots: int):
    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = key[0]
        total = sum(np.frombuffer(raw, "<i8" if order >= len(mixer.ORDERS) else "<i4").astype(np.int64) for raw in rows["n"])
        if order >= len(mixer.ORDERS):
            used = np.flatnonzero(total) if last else None
            raw = np.concatenate([used, total[used]]).tobytes() if last else total.tobytes()
        else:  # beyond 2 ** 30 only the proportion of the two counts matters
            halves = np.maximum(total.reshape(-1, 2).max(1) >> 30, 0)
            total = (total.reshape(-1, 2) >> np.ceil(np.log2(halves + 1)).astype(np.int64)[:, None]).ravel()
            raw = mixer.stretched(total).tobytes() if last else total.astype("<i4").tobytes()
        del total
        released()
        return pd.DataFrame({"order": [order], "block": [key[1]], "part": [key[2]], "n": [raw]})

    return add


def fitted(chunks: DataFrame) -> mixer.Model:
    """The model of the training documents of the written ``chunks``."""
    spark = chunks.sparkSession
    after = chunks.select(F.inline(F.arrays_zip("after", "times"))).groupBy("after").agg(F.sum("times").alias("n"))
    after = written(after, "bytes-after")
    # Both have bounded sizes: a row for each pair of kinds, and one for each byte of each code.
    totals = np.zeros(mixer.PAIRS, np.int64)
    for r in after.groupBy(F.shiftright("after", 8).alias("pair")).agg(F.sum("n").alias("n")).collect():
        totals[r["pair"]] = r["n"]
    rows = mixer.coded_pairs(totals)
    counts = np.zeros((rows.max() + 1, 256), np.int64)
    row = F.get(F.lit(rows.tolist()), F.shiftright("after", 8))
    for r in after.groupBy(row.alias("row"), (F.col("after") % 256).alias("byte")).agg(F.sum("n").alias("n")).collect():
        counts[r["row"], r["byte"]] = r["n"]
    dropped(spark, after)
    total = int(counts.sum())
    code, slots = mixer.Code(counts, rows), mixer.slot_bits(total)
    tasks = max(1, -(-total // MOST_TASK_BYTES), min(-(-total // TASK_BYTES), COUNT_TASKS))
    schema = "order int, block int, part int, n binary"
    with batches_of(spark, BATCH_BYTES):
        parts, left = written(_tables(chunks, code, slots, tasks), "context-counts"), tasks
    while True:
        last = left <= FAN
        grouped = parts.groupBy("order", "block", F.floor(F.col("part") / FAN).cast("int").alias("part"))
        step = written(grouped.applyInPandas(_summed(last, slots), schema), "context-counts")
        dropped(spark, parts)
        parts, left = step, -(-left // FAN)
        if last:
            break
    tables = [np.zeros(1 << slots, np.int8) for _ in mixer.ORDERS]
    cells, matches = [np.zeros((2, 0), np.int64)], np.zeros(32, np.int64)
    # A byte for each slot, whatever the input, and the cells of the histogram that hold something.
    for r in parts.toLocalIterator():
        order, block = r["order"], r["block"]
        if order < len(mixer.ORDERS):
            size = (1 << slots) // BLOCKS
            tables[order][block * size : (block + 1) * size] = np.frombuffer(r["n"], np.int8)
            continue
        used, n = np.frombuffer(r["n"], "<i8").reshape(2, -1)
        if order == len(mixer.ORDERS):
            cells.append(np.array([used + block * (mixer.CELLS // BLOCKS), n]))
        else:
            matches[used] = n
    dropped(spark, parts)
    used, n = np.concatenate(cells, 1)
    cell = np.unique(used >> 1)
    by_bit = np.zeros((2, len(cell)), np.int64)
    by_bit[used & 1, np.searchsorted(cell, used >> 1)] = n
    odds = mixer.match_odds(matches)
    return mixer.Model(code, tables, mixer.fitted(cell, *by_bit, odds), odds)


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` of each row of ``docs``.

    Tokens are the words of the text, A-Z lower-cased, and one end; null and blank texts have the end alone. base_score is the add-one unigram's log10
    probability, score the mixing model's of the words in their order, and bits_per_byte its bits for a byte of the words, a blank after each and the end. Both are learned from the rows that aren't held out. With no training
    rows every word is unknown and all bits are as likely as their codes. Ids may repeat and be null; rows stand for themselves. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).cast("string").alias("id"), held_out(F.col(id)).alias("held"), F.col(text).cast("string").cast("binary").alias("text"))
    with batches_of(spark, BATCH_BYTES):
        chunks = written(_packed(rows), "chunks")
    entry = F.arrays_zip(F.split(F.col("vocabulary").cast("string"), "\n", -1).alias("word"), F.col("train").alias("c"))
    asked = chunks.select("chunk", F.posexplode(entry).alias("place", "entry")).select("chunk", "place", "entry.word", "entry.c")
    # A word has as many rows as chunks hold it; its first chunk counts it among the distinct ones.
    own = Window.partitionBy("word")
    answered = asked.select("chunk", "place", F.sum("c").over(own).alias("c"), (F.min("chunk").over(own) == F.col("chunk")).alias("first"))
    answered = written(answered, "answers")
    total, known = answered.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    model = fitted(chunks)
    shared = spark.sparkContext.broadcast(model)
    base = math.log10(total + known + 1)
    out = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"

    def scored(key: tuple, answers: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        r, mine = chunk.iloc[0], shared.value
        n, flat = np.asarray(r["lengths"], np.int64), np.frombuffer(r["flat"], np.uint8)
        # The arrays of the bits are gone before those of the tokens are made.
        upto = np.cumsum(n)
        bits = np.concatenate([mine.bits(flat[upto[at[0]] - n[at[0]] : upto[at[-1]]], n[at]) for at in mixer.pieces(n, SCORE_BYTES)])
        released()
        c = np.zeros(len(answers), np.int64)
        c[answers["place"].to_numpy()] = answers["c"].to_numpy()
        own = c[_pieces(flat).indices.to_numpy()]
        ends = np.flatnonzero((flat == 32) | (flat == mixer.END))
        last = np.flatnonzero(flat[ends] == mixer.END)
        first = np.append(0, last[:-1] + 1)
        tokens = np.diff(np.append(first, len(own)))
        return pd.DataFrame(
            {
                "id": list(r["ids"]), "held_out": list(r["held"]), "n_tokens": tokens, "n_known": np.add.reduceat((own > 0).astype(np.int64), first),
                "base_score": np.add.reduceat(np.log10(own + 1), first) - tokens * base, "score": -bits * math.log10(2), "bits_per_byte": bits / n,
            }
        )

    texts = chunks.select(F.col("chunk").alias("of"), "ids", "held", "lengths", "flat")
    found = answered.select("chunk", "place", "c").groupBy("chunk").cogroup(texts.groupBy("of")).applyInPandas(scored, out)
    return found.select(F.col("id").cast(kind).alias("id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
