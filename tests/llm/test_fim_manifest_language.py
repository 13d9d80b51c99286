"""Fill-in-the-middle, the manifest and language identification against plain Python, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import fim, language, merkle

TEXTS = [
    None, "", " ", "a", "Zeta9 alpha, beta\nÉté 日本x𝒳y", "holds <S> a mark", "<P", "S><M", "one two\n" * 3, "é" * 7, "word " * 30_000, "[A]`z{@", "\n\n", "no marks < S > here", *(f"row {i} of some\nmore" for i in range(60)),
]
LANG = {"xx": "ba bo bi lamo tiru ", "yy": "skrt grmf plont drvask "}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "q", 3, "own", i) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "text without id\n", "s1", None, None, "own", 1), (None, None, "s1", "q", None, "own", 1), (900, "alone", "z", "q", 1, "own", 1), (7, "another\nseven", "s3", "q", 1, "own", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, row string, cut int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# --- fill in the middle --------------------------------------------------------------------------------------------------


def moved(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    k = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(k[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, empty):
    found = fim.transformed(docs)
    assert found.columns == [*docs.columns, "fim"] and docs.count() == found.count()
    forms = set()
    for r in found.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect():
        assert tuple(r["fim"]) == moved(r["doc_id"], r["text"] or "")
        assert r["back"] == (r["text"] or "") and r["row"] == "own"
        forms.add(r["fim"]["form"])
    assert forms == {"plain", "psm", "spm"}
    assert fim.transformed(empty).count() == 0
    assert fim.transformed(docs.withColumnRenamed("row", "fim")).columns == [c for c in docs.columns if c != "row"] + ["fim"]


def test_runs_and_cuts():
    for text in ("", "abc", "..", "ab..cd.e", "é日𝒳", "x" * 5 + "1" * 5):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
        starts, before = fim.runs(text)
        assert before[-1] == len(units) and starts[-1] == len(text)
        assert [fim.cut(starts, before, k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


# --- manifest ------------------------------------------------------------------------------------------------------------


def tree(nodes):
    """All levels of a tree of threes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def siblings(levels, i):
    for level in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
        yield "".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)
        i //= 3


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf((r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])), r) for r in by[s]), key=lambda x: x[:3])
        trees[s] = own, tree([x[2] for x in own])
    top = tree([trees[s][1][-1][0] for s in sources])
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, (_, _, h, r) in enumerate(own):
            path = [*siblings(levels, i), *siblings(top, k)]
            lost = h if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2 or r["text"] is None else leaf((r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"].replace("\n", "")))
            for a, b in path:
                lost = sha(a + lost + b)
            out.append((r["doc_id"], h, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), lost, lost == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    lost = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit("")))
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, lost)


@pytest.mark.parametrize(("top_nodes", "levels"), [(20_000, 7), (20_000, 1), (8, 1), (3, 2), (1, 1)])
def test_manifest(docs, top_nodes, levels):
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], more=tampered(), top_nodes=top_nodes, levels=levels)
    again = merkle.folded(F.coalesce("more", "node"), F.col("path"))
    found = rows.select("id", "node", "subroot", "root", merkle.proof(F.col("path")).alias("proof"), again.alias("again"), (again == F.col("root")).alias("same")).collect()
    want = expected(docs.collect())
    assert sorted(map(tuple, found), key=str) == want
    assert {x[-1] for x in want} == {True, False}


def test_manifest_of_nothing_and_of_one(docs, empty):
    columns = ["doc_id", "text"]
    assert merkle.manifest(empty, columns).count() == 0
    (one,) = merkle.manifest(docs.where("doc_id = 900"), columns).collect()
    assert one["root"] == one["subroot"] == one["node"] == leaf((900, "alone")) and one["path"] == []


# --- language ------------------------------------------------------------------------------------------------------------


def greedy(text, sample):
    """Phrases of a list of symbols by looking for each in the sample."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_are_the_longest():
    rng = np.random.default_rng(5)
    pieces = {a: ["".join(rng.choice(list("abc "), 60)), "".join(rng.choice(list("bcd "), 50))] for a in "xy"}
    model = language.learned(pieces)
    texts = ["".join(rng.choice(list("abcde. é"), n)) for n in (1, 9, 80, 400)]
    found, lengths = language.symbols(texts, model.classes)
    got = language.phrases(found, lengths, model.tables, model.width, block=64)
    at = np.append(0, np.cumsum(lengths))
    for i in range(len(texts)):
        own = bytes(found[at[i] : at[i + 1]])
        for j, lang in enumerate("xy"):
            sample = b"\xff".join(bytes(language.symbols([t], model.classes)[0]) for t in pieces[lang])
            assert got[i, j] == sum(greedy(own[k : k + 64], sample) for k in range(0, len(own), 64))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = sorted(LANG)[i % 2]
        words = LANG[lang].split()
        rows.append((i, " ".join(rng.choice(words, 1 + i % 40)) + (". " if i % 3 else "\n"), lang, "own"))
    rows += [(1000 + i, rows[1][1], "yy", "own") for i in range(80)] + [(2000, None, "xx", "own"), (2001, " 12 ... ", "xx", "own"), (None, "Skrt grmf!", "yy", "own"), (2002, "", None, "own"), (2003, "BA BO " * 40_000, None, "own"), (2004, "ЖЖ", None, "own")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, language string").repartition(5)


def test_language(labelled):
    model = language.fitted(labelled, sample=2000, piece=100)
    assert model.languages == ["xx", "yy"]
    found = language.predicted(labelled.withColumnRenamed("language", "score"), model).collect()
    assert len(found) == labelled.count()
    for r in found:
        want = {2000: "und", 2001: "und", 2002: "und", 2003: "xx", 2004: r["language"]["lang_pred"]}.get(r["doc_id"], r["lang"])
        assert r["language"]["lang_pred"] == want and 0 <= r["language"]["score"] <= 1 and r["score"] == "own"
        assert (r["language"]["score"] == 0) == (want == "und") or r["doc_id"] == 2004
    again = language.fitted(labelled.repartition(2), sample=2000, piece=100)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_what_is_learned_leaves_held_out_rows_alone(labelled):
    held = labelled.where(language.held_out(F.col("doc_id")))
    assert held.count() and held.where("doc_id IS NULL").count() == 1
    others = held.withColumn("text", F.lit("qqqq")).unionByName(labelled.where(~language.held_out(F.col("doc_id"))))
    a, b = language.fitted(labelled, sample=500, piece=50), language.fitted(others, sample=500, piece=50)
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_language_without_rows(spark, labelled):
    empty = labelled.where("doc_id < 0")
    model = language.fitted(empty)
    assert language.predicted(empty, model).count() == 0
    assert {r["language"]["lang_pred"] for r in language.predicted(labelled, model).collect()} == {"und"}
    alone = language.fitted(labelled.where("lang = 'xx'"))
    assert {r["language"]["lang_pred"] for r in language.predicted(labelled, alone).collect()} == {"und", "xx"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predicted(docs, language.fitted(docs)).where(language.held_out(F.col("doc_id")))
    right = rows.agg(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.98
