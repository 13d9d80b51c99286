"""Token ids of whole texts, by a public tokenizer's file."""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than single blanks and newlines between other characters.
ODD_SPACE = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: ASCII punctuation: after a letter, a run of it at a word's end is a piece of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE, LETTER, MARK = 1, 2, 3
#: What each byte is, as far as words are cut by it.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \n")], KINDS[list(MARKS.encode())] = SPACE, MARK
KINDS[[b for b in range(128) if chr(b).isalpha()]] = LETTER
#: Bytes of words that a worker process remembers in each of two generations, and what a remembered word takes besides its characters.
REMEMBERED_BYTES, ENTRY_BYTES = 48 << 20, 200
#: Words that the library gets in one call, and bytes of texts that are looked up at once.
CALL_WORDS, BATCH_BYTES = 256, 2 << 20


def vocabulary_file(path: str | None = None) -> str:
    """The text of a tokenizers file; read on the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``; every id comes from the tokenizers library.

    A byte-level tokenizer never joins a blank or newline to what stands before it, so the ids of a text are those of its words in order, each with
    the blank or newline before it; nor does it join a letter to the punctuation after it. Words repeat a lot: each distinct word of a batch is encoded
    once, many in one call, and remembered; once the memory holds REMEMBERED_BYTES, what was not used since the last time is forgotten.
    Texts with unusual white space or a special token are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([ODD_SPACE, *special])
        self.begins = {}
        for mark in (" ", "\n"):
            first = self.tokenizer.encode(mark + "a", add_special_tokens=False).tokens[0][0]
            self.begins[mark] = np.zeros(max(vocab.values()) + 1, bool)
            self.begins[mark][[i for t, i in vocab.items() if t.startswith(first)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    @staticmethod
    def of_worker(vocabulary: str) -> Encoder:
        """The worker process's encoder for this vocabulary: workers run many tasks, and keep what they remember."""
        kept = sys.modules.setdefault("_pagewright_worker", types.ModuleType("_pagewright_worker")).__dict__
        key = zlib.crc32(vocabulary.encode())
        if key not in kept:
            kept[key] = Encoder(vocabulary)
        return kept[key]

    @staticmethod
    def forget() -> None:
        """Frees what :meth:`of_worker` keeps: later tasks of the process have its memory."""
        if "_pagewright_worker" in sys.modules:
            sys.modules["_pagewright_worker"].__dict__.clear()
        pa.default_memory_pool().release_unused()

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _together(self, words: list[bytes], mark: str) -> list[bytes]:
        """Ids of each word; all begin with ``mark``. Only a word's first id begins with it, so many words are told apart in one text's ids."""
        out: list[bytes] = []
        for k in range(0, len(words), CALL_WORDS):
            part = words[k : k + CALL_WORDS]
            ids = np.frombuffer(self.whole([b"".join(part).decode()])[0], self.dtype)
            starts = np.flatnonzero(self.begins[mark][ids])
            if len(starts) == len(part) and not starts[0]:
                raw, at = ids.tobytes(), [*(starts * self.dtype.itemsize).tolist(), ids.nbytes]
                out += [raw[i:j] for i, j in zip(at, at[1:])]
            else:
                out += self.whole([w.decode() for w in part])
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, each with its mark, and of runs of punctuation."""
        if self.size > REMEMBERED_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        young = self.young
        missing = [w for w in words if w not in young]
        young.update((w, self.old[w]) for w in missing if w in self.old)
        new = [w for w in missing if w not in young]
        for mark in (" ", "\n"):
            some = [w for w in new if w[0] == ord(mark)]
            young.update(zip(some, self._together(some, mark), strict=True))
        some = [w for w in new if w[0] not in b" \n"]
        young.update(zip(some, self.whole([w.decode() for w in some]), strict=True))
        self.size += sum(map(len, missing)) + ENTRY_BYTES * len(missing)
        return [young[w] for w in words]

    def _plain(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of texts whose words stand between single blanks and newlines."""
        marked = pc.binary_join_element_wise("", texts, "\n")
        _, offsets, data = marked.buffers()
        at = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[: at[-1]]
        kind = KINDS[raw]
        # A word ends before the punctuation after its last letter, where nothing but punctuation follows.
        after = np.flatnonzero((kind[1:] == MARK) & (kind[:-1] == LETTER)) + 1
        stops = np.append(np.flatnonzero((kind[1:] != MARK) & (kind[:-1] == MARK)) + 1, len(raw))
        follows = stops[np.searchsorted(stops, after)]
        run = after[(follows == len(raw)) | (kind.take(follows, mode="clip") == SPACE)]
        begins = kind == SPACE
        begins[run] = True
        places = np.flatnonzero(begins).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(np.append(places, at[-1]).astype(np.int32)), data]).dictionary_encode()
        own, distinct = words.indices.to_numpy(), self._ids(words.dictionary.to_pylist())
        length = np.fromiter(map(len, distinct), np.int32, len(distinct)) // self.dtype.itemsize
        begin, flat, counts = np.cumsum(length, dtype=np.int32) - length, np.frombuffer(b"".join(distinct), self.dtype), length[own]
        upto = np.cumsum(counts, dtype=np.int32)
        at_ids = np.repeat(begin[own] - (upto - counts), counts)
        at_ids += np.arange(len(at_ids), dtype=np.int32)
        ids = flat.take(at_ids)
        # Each text began with a newline that is not its own: its place is the end id's of the text before.
        first = (upto - counts)[np.searchsorted(places, at[:-1])]
        ids = np.append(ids[1:], ids.dtype.type(end))
        ids[first[1:] - 1] = end
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((np.append(first, len(ids)) * self.dtype.itemsize).astype(np.int32)), pa.py_buffer(ids)])

    def encode_ended(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of each text and the end id; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        out, where = [], []
        plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[plain].astype(np.int64))
        for part in np.split(plain, np.searchsorted(size, np.arange(BATCH_BYTES, size[-1] if len(size) else 0, BATCH_BYTES))):
            if len(part):
                out.append(self._plain(texts.take(pa.array(part)), end))
                where.append(part)
        others, last = np.flatnonzero(odd.to_numpy(zero_copy_only=False)), np.array([end], self.dtype).tobytes()
        if len(others):
            out.append(pa.array([x + last for x in self.whole(texts.take(pa.array(others)).to_pylist())], pa.binary()))
            where.append(others)
        return pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate(where), kind="stable"))) if out else pa.array([], pa.binary())

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text."""
        return [x[: -self.dtype.itemsize] for x in self.encode_ended(pa.array(texts, pa.string()), 0).to_pylist()]
