"""What a task holds at once doesn't grow with its input."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import huffman, lines, lm, mixer
from pagewright.llm.common import batches_of, released
from pagewright.llm.tokenize import Encoder, vocabulary_file

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def peak(make) -> tuple[int, object]:
    tracemalloc.start()
    try:
        out = make()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_packing_takes_little_more_than_a_chunk(monkeypatch):
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [f"Word{i % 977} and  word{i % 89}\n" * 300 for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(3000))), pa.array([i % 7 == 2 for i in range(3000)]), pa.array([t.encode() for t in texts])], ["id", "held", "text"])
    pack = lm._packed(SimpleNamespace(mapInArrow=lambda f, _: f))
    most, sizes = peak(lambda: [c.column("flat").nbytes for c in pack(iter([batch]))])
    size = batch.column(2).nbytes
    assert sum(sizes) > 0.8 * size and max(sizes) < lm.CHUNK_BYTES + 2 * lm.SERIAL_BYTES
    assert most < 8 * lm.CHUNK_BYTES


def test_serialised_texts_and_log_odds_take_little_more_than_their_bytes():
    raw = np.frombuffer(b"Some words,  and\tothers \n" * 100_000, np.uint8)
    most, (flat, n) = peak(lambda: mixer.serialised(raw, np.array([0, 7, len(raw)])))
    assert n.tolist() == [1, 9, len(flat) - 10] and bytes(flat[:10]) == b"\nsome wo \n" and most < 15 * len(raw)
    counts = np.arange(1 << 22, dtype=np.int32) % 5
    most, _ = peak(lambda: mixer.stretched(counts))
    assert most < counts.nbytes


def test_batches_of_a_size(spark):
    rows = spark.range(0, 4000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    count = lambda: max(r["n"] for r in rows.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in it), "n long").collect())
    before = spark.conf.get(KEY)
    with batches_of(spark, 200_000):
        assert count() < 400
    assert count() == 4000 and spark.conf.get(KEY) == before


def test_encoding_takes_little_more_than_its_batch():
    encoder = Encoder(vocabulary_file())
    texts = pa.array([f"Word{i % 977}, (and) other...\nwords: 'w{i % 89}'!!\n" * 400 + "end?!" for i in range(1600)])
    encoder.encode_ended(texts.slice(0, 100), 2)
    most, ids = peak(lambda: encoder.encode_ended(texts, 2))
    assert most < 3 * texts.nbytes
    some = [0, 7, 1599]
    assert [ids[i].as_py() for i in some] == [np.array([*encoder.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, 2], encoder.dtype).tobytes() for i in some]


def test_a_worker_lets_go_of_its_encoder():
    text = vocabulary_file()
    one = Encoder.of_worker(text)
    assert Encoder.of_worker(text) is one
    list(huffman._counted(iter([])))
    assert Encoder.of_worker(text) is not one
    Encoder.forget()


def test_lines_are_parsed_once(spark, monkeypatch):
    calls, parsed = [], lines._parsed
    monkeypatch.setattr(lines, "_parsed", lambda rows: calls.append(1) or parsed(rows))
    docs = spark.createDataFrame([(1, "user 17 came from here\nkept one"), (2, "user 18 came from here\nkept two")], "doc_id long, text string")
    assert sorted(r["text"] for r in lines.deduplicated(docs).collect()) == ["kept one", "kept two"]
    assert len(calls) == 1


def test_workers_give_back_what_a_task_has_freed():
    """Memory of arrays of 100 kB each, with one that stays behind them, is held by the process until it is released."""
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    arrays = [np.ones(100_000, np.uint8) for _ in range(1500)]
    last, full = np.ones(1000, np.uint8), held()
    del arrays
    released()
    assert held() < full - 100_000_000 and last.all()


def test_chunks_are_small_beside_an_executor():
    """Two tasks hold a chunk each, several times over, in Python, in the JVM and between them."""
    assert lm.CHUNK_BYTES + 2 * lm.SERIAL_BYTES <= 8 << 20 and lm.BATCH_BYTES <= 4 << 20
