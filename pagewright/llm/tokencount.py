"""Token counts of flat token files: a scan for end-of-document ids.

The files hold nothing but ids, each as two little-endian bytes, with no index. They are read in byte ranges, so that a file of any size is many tasks' work. A
block's separators are found by one vectorised comparison; what a block cannot know, where its first document began, comes from a prefix scan over the blocks'
figures: first within each file, then over the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import deleted, new_path, written
from .tokenize import Encoder, vocabulary_file

WIDE, BLOCK_BYTES, TASK_BYTES = 2, 1 << 22, 1 << 26
#: End id of the files written here: above every id of the vocabulary, so that no text can hold it.
RESERVED = 0xFFFF


def _store(uri: str):
    """The file system of a path and the path in it, as pyarrow opens them (local and shared folders, HDFS, S3, GCS, Azure)."""
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = RESERVED) -> DataFrame:
    """Writes the ids of each text and an end id, a file for each partition, and returns the written table ``(id, file, in_file)``: where each row's document stands.

    A task names its own file and returns it with its rows, so the table holds files of finished tasks only; a lost or repeated task
    leaves a file that the table doesn't name. A text that holds the end id fails the job, since the files could not be read back. Null and blank texts
    write what they have: an end id alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(shared.value)
        if encoder.dtype.itemsize != WIDE:
            raise ValueError("the vocabulary has ids of more than two bytes")
        files, folder = _store(path)
        files.create_dir(folder, recursive=True)
        name, n, out = f"tokens-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.bin", 0, None
        places = []
        for rows in batches:
            ids = encoder.encode_ended(rows.column(1), end)
            raw = np.frombuffer(ids.buffers()[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
            raw = raw[at[0] : at[-1]]
            if int((raw.view(f"<u{WIDE}") == end).sum()) != len(ids):
                raise ValueError(f"a text has the end id {end}")
            out = out or files.open_output_stream(f"{folder}/{name}")
            out.write(raw)
            places.append(pa.RecordBatch.from_arrays([rows.column(0), pa.array([name] * len(ids), pa.string()), pa.array(np.arange(n, n + len(ids)))], ["id", "file", "in_file"]))
            n += len(ids)
        if out:
            out.close()
        yield from places

    own = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return written(own.mapInArrow(put, f"id {kind}, file string, in_file long"), "flat-places")


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, uri, length)``: the flat files below a path, a row each, by name; their contents are not read."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "length")
    return found.select(F.element_at(F.split("uri", "/"), -1).alias("file"), "uri", "length")


def _scan(end: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for r in rows.to_pylist():
                files, at = _store(r["uri"])
                with files.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(r["size"], r["offset"]), f"<u{WIDE}")
                if len(ids) * WIDE != r["size"]:
                    raise OSError(f"{r['uri']} is shorter than it was")
                found = np.flatnonzero(ids == end) + 1
                yield pa.RecordBatch.from_pylist(
                    [{"file": r["file"], "block": r["block"], "n": len(ids), "n_ends": len(found), "last": int(found[-1]) if len(found) else None, "ends": found.astype(np.int32)}],
                    pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("n_ends", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int32()))]),
                )

    return scan


def counts(files: DataFrame, end: int = RESERVED) -> DataFrame:
    """``(file, in_file, document, start, n_tokens)`` of every document in ``files``, rows of :func:`token_files`.

    Files follow one another by name; document counts from 0 over all of them, in_file from 0 in the file where the document ends, start is the first token's place
    over all files, n_tokens counts the end id. A document may run over blocks and files. Tokens after the last end id are a document
    without one. An odd last byte is not a token. No files, or empty ones, give no rows. Only the figures of blocks and files are put in order, not the documents.
    """
    size = F.col("length") - F.col("length") % WIDE
    ranges = files.where(size > 0).select("file", "uri", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(BLOCK_BYTES).cast("long"))).alias("offset"))
    ranges = ranges.select("file", "uri", "offset", F.floor(F.col("offset") / BLOCK_BYTES).alias("block"), F.least(F.lit(BLOCK_BYTES), F.col("size") - F.col("offset")).cast("long").alias("size"))
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    blocks = written(ranges.repartition(tasks).mapInArrow(_scan(end), "file string, block long, n long, n_ends long, last long, ends array<int>"), "token-blocks")

    figures = blocks.drop("ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    at = figures.withColumn("n0", sums("n", before)).withColumn("k0", sums("n_ends", before))
    at = at.withColumn("upto", F.col("n0") + F.col("last")).withColumn("open", F.max("upto").over(before))
    whole = at.groupBy("file").agg(F.sum("n").alias("fn"), F.sum("n_ends").alias("fe"), F.max("upto").alias("flast"))
    files_before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("fn0", sums("fn", files_before)).withColumn("fe0", sums("fe", files_before))
    whole = whole.withColumn("fopen", F.coalesce(F.max(F.col("fn0") + F.col("flast")).over(files_before), F.lit(0)))

    placed = at.where("n_ends > 0").join(whole, "file").select(
        "file", "block", "k0", "fe0", (F.col("fn0") + F.col("n0")).alias("base"), F.coalesce(F.col("fn0") + F.col("open"), F.col("fopen")).alias("begun")
    )
    ends = blocks.select("file", "block", "ends").join(placed, ["file", "block"])
    upto = F.transform("ends", lambda e: F.col("base") + e)
    starts = F.concat(F.array("begun"), F.slice(upto, 1, F.size("ends") - 1))
    ended = ends.select("file", "k0", "fe0", F.posexplode(F.arrays_zip(starts.alias("start"), upto.alias("upto"))).alias("k", "d"))
    done = ended.select("file", (F.col("k0") + F.col("k")).alias("in_file"), (F.col("fe0") + F.col("k0") + F.col("k")).alias("document"), "d.start", (F.col("d.upto") - F.col("d.start")).alias("n_tokens"))
    total = whole.agg(F.sum("fn").alias("all"), F.coalesce(F.max(F.col("fn0") + F.col("flast")), F.lit(0)).alias("closed"), F.sum("fe").alias("docs"), F.max("file").alias("file"), F.max_by("fe", "file").alias("in_file"))
    rest = total.where(F.col("all") > F.col("closed")).select(
        "file", "in_file", F.col("docs").alias("document"), F.col("closed").alias("start"), (F.col("all") - F.col("closed")).alias("n_tokens")
    )
    return done.unionByName(rest)


def document_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, start, n_tokens)`` of each row of ``docs``, from flat files written for it and scanned.

    The files hold no ids; the table of :func:`write_flat` says which document of a file is which row's. A file whose scan finds another number of documents than were
    written fails the job. Repeated rows and null ids have rows of their own; an empty table gives none.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "flat")
    places = write_flat(docs, path, id, text, vocabulary)
    names = places.groupBy("file").agg(F.count("*").alias("n"))
    if names.limit(1).count() == 0:
        return places.select(F.col("id").alias(id), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    found = written(counts(token_files(spark, path).join(names, "file", "left_semi")), "flat-counts")
    scanned = found.groupBy("file").agg(F.count("*").alias("scanned"))
    wrong = names.join(scanned, "file", "full").where(~F.col("n").eqNullSafe(F.col("scanned"))).limit(1).collect()
    if wrong:
        raise RuntimeError(f"flat file {wrong[0]['file']}: {wrong[0]['n']} documents written, {wrong[0]['scanned']} found")
    deleted(spark, path)
    return places.join(found, ["file", "in_file"]).select(F.col("id").alias(id), "start", "n_tokens")
