"""The training-data operators against plain Python, on small tables with nulls, blanks, ties, repeated rows and clashing column names."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, huffman, licenses, lines, lm, mixer, mixing, pii, quality, simhash, tokencount
from pagewright.llm.tokenize import Encoder, vocabulary_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potent brews in the old tower. "
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
TEXTS = [
    PROSE * 2 + "One more sentence stands here.", PROSE + "Another ending of the same text, quite long.", None, "", " \t\n ", "word",
    "Tabs\tand\x0bother\x0cspaces\r\nhere.", PROSE + "Another ending of the same text, quite long!", "x " * 30, "### $$$ %%% | a < b > c & d *** e # f $ g | h",
    f"Before the passage. {ITEM.upper()} after the passage.", ITEM, "Released under the MIT License.\n" + PROSE, "日本 語。 é ü " * 9, PROSE * 300,
    "Call +1 (523) 555-1055 or write to jo.doe@mail.example.com, card 4539 1488 0343 6467, host 10.20.30.40, born 1984-02-29, ssn 123-45-6789.",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and not a card 4539 1488 0343 6468 nor 999.1.1.1',
    "user 17 logged in from host 9\nkept line one", "user 18 logged in from host 3\nkept line two", "user 19 logged in from host 5\nkept line 3 here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" + str(i % 3) if i % 5 else None, "q", 0, [1]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, PROSE, "s1", "q", 0, [1])], "doc_id long, text string, source string, quality string, n_lines int, w array<int>").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def words(t):
    return WORD.findall(t or "")


def shingles(t, n):
    w = words((t or "").translate(LOWER))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])


def test_quality(docs, empty):
    for r in quality.quality(docs).collect():
        t, q = r["text"] or "", r["quality"]
        w, lines_ = words(t), [x for x in t.split("\n") if words(x)]
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines_) - len(set(lines_)), len(again))
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        assert q["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (q["kept"] and q["base_failed"])
    assert quality.quality(empty).count() == 0
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 7} and not {r["doc_id"] for r in kept.collect()} & {2, 3, 4, 5, 8, 9}


def test_lines_are_cleaned(spark):
    one, two, three = "This line is a sentence of its own and ends well.", "Another one stands right below it, quite unlike the first.", "The last of them closes the text without any fuss."
    essay = "Many people have written about what a privacy policy should say to its readers, in plain words or in those of lawyers, and this essay sums up some of what was said there, without an end."
    texts = [
        f"{one}\t\n {two}\r\nHome\nRead our privacy policy.\n{three}  ", f"{essay}\n{two}", "这个句子里有百分之五十(50%)的人都同意这种说法,而且他们还有别的看法要说。 第 二 句 话 也 在 这 里 面 没 有 问 题 呢。",
        f"Home | Next > Share | Menu.\nAll of it | with bars | between the words, so it goes.\n{one}",
    ]
    rows = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r["text"] for r in quality.cleaned(rows).collect()}
    assert out == {0: f"{one}\t\n {two}\r\n{three}  ", 1: texts[1], 2: texts[2]}


def fingerprint(t):
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles(t, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    prints = [fingerprint(r["text"]) for r in rows]
    roots = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = Counter((r["doc_id"], p, rows[k]["doc_id"]) for r, p, k in zip(rows, prints, roots, strict=True))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(docs).count() == len(set(roots))


def test_one_document_of_each_group_whatever_its_id(spark):
    other, third = ITEM + " and then some more of it", "Quite a different text that shares no run of words with any of these."
    rows = [(None, PROSE, "a"), (None, other, "a"), (None, PROSE, "b"), (5, third, "a"), (None, third, "a"), (5, "One id names a second text here.", "a"), (5, "One id names a second text here.", "a")]
    for n in (1, 3):
        out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n))
        assert out.columns == ["doc_id", "text", "source"]
        want = {(None, PROSE), (None, other), (5, third), (5, "One id names a second text here.")}
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(want)


def test_close_fingerprints_by_the_index(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(c) for c in centre}
    for c in centre[:4].tolist():  # dense groups of more than a leaf
        for _ in range(400):
            values.add(c ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 3))))
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    from pagewright.llm.components import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    a = np.array(values, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 3
    group = list(range(len(values)))
    while True:
        new = [min(group[j] for j in np.flatnonzero(near[i])) for i in range(len(values))]
        if new == group:
            break
        group = new
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    mine = [roots.get(signed(v), signed(v)) for v in values]
    assert len(set(zip(mine, group, strict=True))) == len(set(mine)) == len(set(group))


def test_a_tree_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "FANOUT", 3)
    rng = np.random.default_rng(3)
    head = int(rng.integers(0, 1 << 16)) << 48  # one block for all: a group of many leaves
    values = sorted({head | int(x) for x in rng.integers(0, 1 << 47, 150)} | {head | int(x) << 20 for x in rng.integers(0, 1 << 12, 60)})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    from pagewright.llm.components import components

    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"))).collect()}
    want = grouped(values, lambda a, b: (a ^ b).bit_count() <= 3)
    mine = [roots.get(signed(v), signed(v)) for v in values]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want)) < len(values)


def test_components_with_salted_hubs(spark, monkeypatch):
    from pagewright.llm import components

    monkeypatch.setattr(components, "small", lambda df: df)
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 340)] + [(500, 500)]
    out = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(200)} | {k: 300 for k in range(300, 341)}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, ITEM), (2, "nothing like it in any of the documents at all"), (3, None), (4, ""), (5, "word"), (1, ITEM)], "item_id long, text string")
    found = {(r["doc"], r["item"]) for r in decontaminate.contained(docs, items).collect()}
    of_items = {1: set(shingles(ITEM, 5)), 5: {("word",)}}
    want = {(i, k) for i, t in enumerate(TEXTS) for k, s in of_items.items() if len(s & set(shingles(t, 5))) >= 0.8 * len(s)}
    assert found == want and (10, 1) in want
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r["doc_id"] for r in docs.collect() if (r["doc_id"], 1) not in want and (r["doc_id"], 5) not in want)
    assert decontaminate.contained(empty, items).count() == 0 and decontaminate.contained(docs, items.limit(0)).count() == 0


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(docs, empty):
    found = pii.pseudonymised(docs, "k")
    text = {r["doc_id"]: r for r in found.collect()}
    before, after = TEXTS[15], text[15]["text"]
    for value in ("523", "555-1055", "jo.doe@", "4539 1488 0343 6467", "10.20.30.40", "1984-02-29", "123-45-6789"):
        assert value not in after
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or write to [a-z]{2}\.[a-z]{3}@mail\.example\.com, card 4\d{3}( \d{4}){3}, host [\d.]+, born \d{4}-\d\d-\d\d, ssn \d{3}-\d\d-\d{4}\.", after)
    assert luhn(re.search(r"card ([\d ]+),", after)[1]) and all(int(x) < 256 for x in re.search(r"host ([\d.]+),", after)[1].split("."))
    assert text[15]["n_card"] == text[15]["n_date"] == text[15]["n_email"] == 1
    assert "24be64" not in text[16]["text"] and text[16]["text"].endswith("4539 1488 0343 6468 nor 999.1.1.1")
    assert all(r["text"] == TEXTS[i] for i, r in text.items() if i is not None and i not in (15, 16))
    assert before != after and pii.pseudonymised(docs, "k2").where("doc_id = 15").first()["text"] != after
    assert pii.pseudonymised(empty, "k").count() == 0


def test_cards_beside_numbers_and_dates_in_other_formats(spark):
    card, other = "4539 1488 0343 6467", "4111111111111111"
    texts = [
        "card 4539148803436467 123", f"{card} 12/27", f"12 {card}", f"123456 {card} 123", f"{card} {other}", f"{card}-12", f"7 {card} 1984-02-29 x",
        "born 31.12.1984", "born 12/31/1984", "born 31/12/1984", "born 1984-12-31", "born 31-12-1984", "no 31.13.1984 nor 13/13/1984 nor 30.2.1984",
        "1 " * 30_000, "12 1984-02-29 345x 4539 1488 0343 6467 12.5",
    ]
    out = [r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    digits = lambda t: re.sub(r"\D", "", t)
    for r in (*out[:7], out[14]):
        assert "4539148803436467" not in digits(r["text"]) and other not in r["text"] and re.sub(r"\d", "0", r["text"]) == re.sub(r"\d", "0", texts[r["doc_id"]])
    assert [r["n_card"] for r in out[:7]] == [1, 1, 1, 1, 2, 1, 1] and out[6]["n_date"] == 1 and "1984-02-29" not in out[6]["text"]
    moved = re.search(r"card (\d+) 123$", out[0]["text"])[1]
    assert luhn(moved) and all(moved in digits(r["text"]) for r in out[:7])
    y, m, d = re.search(r"(\d+)-(\d+)-(\d+)", out[10]["text"]).groups()
    assert [out[k]["text"] for k in (7, 8, 11)] == [f"born {d}.{m}.{y}", f"born {m}/{d}/{y}", f"born {d}-{m}-{y}"]
    assert int(re.match(r"born (\d\d)/\d\d/\d{4}$", out[9]["text"])[1]) > 12 and out[9]["text"] != texts[9]
    assert out[12]["text"] == texts[12] and [r["n_date"] for r in out[7:12]] == [1] * 5 and out[14]["n_date"] == 1


def test_permutations_are_one_to_one(spark):
    rows = spark.range(3000)
    text = F.lpad(F.col("id").cast("string"), 4, "0")
    assert rows.select(pii.feistel_text(text, "k", "t", (pii.DIGITS,)).alias("x")).distinct().count() == 3000
    date = F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).cast("string")
    made = rows.select(pii.pseudonym(date, "k").alias("x"))
    assert made.distinct().count() == 3000 and made.where("try_cast(x as date) is null").count() == 0


def ids_of(tokenizer, t):
    return tokenizer.encode(t or "", add_special_tokens=False).ids + [2]


def test_token_files(docs, empty):
    tokenizer = Encoder(vocabulary_file()).tokenizer
    back = sorted(huffman.round_trip(docs).collect(), key=lambda r: r["start"])
    rows = docs.collect()
    want = Counter((r["doc_id"], tuple(ids_of(tokenizer, r["text"]))) for r in rows)
    assert Counter((r["id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in back) == want
    start = 0
    for r in back:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"])
        start += r["n_tokens"]
    ids = [r["id"] for r in back]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert huffman.round_trip(empty).count() == 0


def test_code_lengths():
    counts = np.array([1 << k for k in range(30)] + [0, 7])
    bits = huffman.code_lengths(counts, 8)
    assert bits.max() == 8 and bits[30] == 0 and sum(2.0 ** -int(b) for b in bits if b) <= 1
    even = huffman.code_lengths(np.ones(8, np.int64), 20)
    assert (even == 3).all() and (huffman.code_lengths(np.array([0, 5]), 20) == [0, 1]).all()


def test_token_counts(spark, docs, empty, tmp_path):
    table = tmp_path / "docs"
    docs.write.parquet(str(table))
    stored = spark.read.parquet(str(table))
    tokenizer = Encoder(vocabulary_file()).tokenizer
    found = Counter((r["doc_id"], r["n_tokens"]) for r in tokencount.document_counts(stored).collect())
    assert found == Counter((r["doc_id"], len(ids_of(tokenizer, r["text"]))) for r in stored.collect())
    assert tokencount.document_counts(empty).count() == 0


def test_token_counts_of_texts_with_any_token(spark, tmp_path):
    texts = ["one two", "Start\n# Title\nmore of it", "C# code and #! too", "last words here", None, "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    tokenizer = Encoder(vocabulary_file()).tokenizer
    found = sorted(tuple(r) for r in tokencount.document_counts(spark.read.parquet(str(tmp_path / "docs"))).collect())
    sizes = [len(ids_of(tokenizer, t)) for t in texts]
    assert found == [(k, sum(sizes[:k]), n) for k, n in enumerate(sizes)]
    for end, text in ((2, "# Title"), (200, "\x0c"), (50256, "<|endoftext|>")):
        with pytest.raises(Exception, match=f"end id {end}"):
            tokencount.write_flat(spark.createDataFrame([(1, text)], "doc_id long, text string"), str(tmp_path / "flat"), end=end)


@pytest.mark.parametrize("end", [200, 50256, 65535])
def test_any_end_id(spark, tmp_path, end):
    texts = ["one two", "a longer text with more words", None, "last"]
    tokencount.write_flat(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), str(tmp_path), end=end)
    sizes = [len(ids_of(Encoder(vocabulary_file()).tokenizer, t)) for t in texts]
    found = sorted((r["start"], r["n_tokens"]) for r in tokencount.counts(tokencount.token_files(spark, str(tmp_path)), end).collect())
    assert found == [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


def test_documents_that_run_over_blocks_and_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokencount, "BLOCK_BYTES", 6)
    parts = [[5, 2, 7, 8, 9, 10, 11, 2, 2, 4], [6, 6], [2, 3, 3, 3, 3, 3, 3]]
    for i, p in enumerate([*parts, []]):
        (tmp_path / f"part-{i}").write_bytes(np.array(p, "<u2").tobytes() + b"\0" * (i == 2))
    found = sorted((r["document"], r["start"], r["n_tokens"]) for r in tokencount.counts(tokencount.token_files(spark, str(tmp_path)), 2).collect())
    assert found == [(0, 0, 2), (1, 2, 6), (2, 8, 1), (3, 9, 4), (4, 13, 6)]


def test_mixing(docs, empty):
    out = mixing.mixed(docs).collect()
    assert len(out) == docs.count()
    sizes = {}
    for r in out:
        assert r["mix"]["size"] == len(words(r["text"])) and r["mix"]["taken"] <= 3 * r["mix"]["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix"]["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    assert math.isclose(sum(goals.values()), sum(sizes.values()))
    largest = max(r["mix"]["size"] for r in out)
    for s in names:
        own = [r["mix"] for r in out if r["source"] == s]
        assert {m["target"] for m in own} == {goals[s]} and {m["source_size"] for m in own} == {sizes[s]}
        assert abs(sum(m["taken"] for m in own) - goals[s]) <= largest
    assert mixing.mixed(empty).count() == 0
    assert Counter(map(str, out)) == Counter(map(str, mixing.mixed(docs).collect()))
    assert mixing.selected(docs).columns == docs.columns


def test_mixing_of_overlapping_empty_and_null_sources(spark):
    rows = [(1, "a b c d", ["x", "y"]), (2, "a b", ["x"]), (3, "a b c", []), (4, "a", None), (5, "a b", [None, "y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    out = {r["doc_id"]: r["mix"] for r in mixing.mixed(docs, sources=F.col("of")).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and out[3]["source_size"] == out[4]["source_size"] == 6 and all(m["taken"] <= 3 * m["size"] for m in out.values())


def test_flow_prefers_first_uses():
    assert mixing.routed([(("a",), 10), (("a", "b"), 10)], {"a": 12, "b": 8}) == [10, 10]
    assert mixing.targets([100, 1, 1]) == [96.0, 3.0, 3.0]


def test_licenses(docs, empty):
    found = {(r["doc_id"], r["license"]["name"]) for r in licenses.licenses(docs).collect()}
    assert found == {(12, "MIT")}
    assert licenses.licenses(empty).count() == 0
    long = licenses.TEMPLATES["MIT"][4]
    spark = docs.sparkSession
    one = spark.createDataFrame([(1, PROSE * 5 + long.upper() + " " + PROSE), (2, " ".join(long.split()[:20]))], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]["name"], r["license"]["containment"]) for r in licenses.licenses(one).collect()] == [(1, "MIT", 1.0)]


def test_licenses_by_brute_force(spark):
    """Any table of templates; whole recall against the containment of all pairs, on texts with words lost and put in."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    templates = {f"L{k}": (" ".join(rng.choice(vocabulary, int(n))),) for k, n in enumerate(rng.integers(2, 120, 150))}
    rows = []
    for k in range(120):
        t = list(templates.values())[int(rng.integers(len(templates)))][0].split()
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(len(t)))
            t[at : at + int(rng.integers(0, 2))] = ["zz"] * int(rng.integers(0, 2))
        rows.append((k, " ".join([*rng.choice(vocabulary, int(rng.integers(0, 30))), *t, *rng.choice(vocabulary, int(rng.integers(0, 30)))])))
    found = {(r["doc_id"], r["license"]["name"]) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=licenses.template_table(spark, templates)).collect()}
    of = {name: set(shingles(t, 5)) for name, (t,) in templates.items()}
    held = {k: set(shingles(t, 5)) for k, t in rows}
    passed = {(k, n): of[n] & held[k] for k in held for n in of if len(of[n] & held[k]) >= 0.8 * len(of[n]) - 1e-9}
    share = lambda k, n: len(passed[k, n]) / len(of[n])
    want = {(k, n) for k, n in passed if not any(j == k and share(j, m) > share(k, n) and passed[j, m] >= passed[k, n] for j, m in passed)}
    assert found == want and len(want) > 60


def test_licenses_in_comments(spark):
    import textwrap

    texts = [licenses.TEMPLATES["MIT"][4], licenses.TEMPLATES["GPL-3.0"][2]]
    marks = [("// ", ""), ("-- ", ""), ("/* ", " */"), ("<!-- ", " -->"), ("  REM ", "\r"), ("/// ", ""), (" * ", ""), ("# ", "")]
    rows = [(k, "int x;\n" + "\n".join(a + x + b for x in textwrap.wrap(texts[k % 2], 74)) + "\nint y;") for k, (a, b) in enumerate(m for m in marks for _ in (0, 1))]
    found = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]["name"], r["license"]["containment"]) for r in found} == {(k, ("MIT", "GPL-3.0")[k % 2], 1.0) for k, _ in rows}


def test_line_templates(docs, empty):
    found = {r["doc_id"]: r for r in lines.deduplicated(docs).collect()}
    assert found[17]["text"] == "kept line one" and found[18]["text"] == "kept line two"
    assert found[17]["n_lines"] == 2 and found[17]["n_dropped"] == 1
    assert found[2]["text"] is None and found[3]["text"] == "" and found[2]["n_dropped"] == 0
    assert lines.deduplicated(empty).count() == 0


def test_two_families_in_a_leaf_that_vary_in_two_places(spark):
    names = ["anna", "bert", "carl", "dora", "emil"]
    one = [f"one two three red fox {n} jumps over {n}s high fence today again" for n in names]
    two = [f"one two three some other {n} reads the {n}er book every morning" for n in names[:4]]
    rows = [(k, line) for k, line in enumerate(one + two)]
    out = {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(one[0].split()) == len(two[0].split()) + 1 and all(out[k]["text"] == "" for k, _ in rows)
    mixed = [f"one two three red fox {n} jumps over {n}s high fence today" for n in names]
    out = lines.deduplicated(spark.createDataFrame(list(enumerate(mixed + two)), "doc_id long, text string")).collect()
    assert len(mixed[0].split()) == len(two[0].split()) and all(r["text"] == "" for r in out)


def test_lines_of_two_documents_and_of_several_templates_in_a_leaf(spark):
    passage = "A passage that stands in two documents only. " * 8
    names = ["anna", "bert", "carl", "dora", "emil", "fritz"]
    other = ["one two three " + " ".join(f"{chr(97 + k)}{'xyzuvw'[j]}q" for j in range(6)) for k in range(20)]
    rows = [(1, passage + "\nfirst own line"), (2, passage + "\nsecond own line")]
    rows += [(10 + k, f"one two three {'red' if k % 2 else 'blue'} fox {name} jumps {'high' if k % 2 else 'low'} today") for k, name in enumerate(names)]
    rows += [(100 + k, line) for k, line in enumerate(other)]
    out = {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert (out[1]["text"], out[2]["text"]) == ("first own line", "second own line")
    assert all(out[10 + k]["text"] == "" for k in range(6)) and all(out[100 + k]["text"] == line for k, line in enumerate(other))


def test_scores(docs, empty):
    out = lm.scores(docs).collect()
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*words((t or "").translate(LOWER)), None]
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
    show = lambda i, h, k, known, b: (i, h, k, known, n, round(b, 6))
    want = Counter(show(r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])), sum(c[w] > 0 for w in tokens(r["text"])), base(r["text"])) for r in rows)
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lm.scores(empty).count() == 0


def learned(texts, batch=1):
    raw = [t.encode() for t in texts]
    flat, n = mixer.serialised(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw]))
    code = mixer.Code(np.bincount(flat, minlength=256))
    learner = mixer.Learner(code, 22)
    learner.due = 1
    ends = np.cumsum(n)
    for k in range(len(n)):
        learner.add(flat[ends[k] - n[k] : ends[k]], n[k : k + 1])
    cells = learner.cells.reshape(-1, 2)
    used = np.flatnonzero(cells.any(1))
    odds = mixer.match_odds(learner.matches)
    weights = mixer.fitted(used, cells[used, 0], cells[used, 1], odds)
    return mixer.Model(code, [mixer.stretched(c) for c in learner.counts], weights, odds), weights, odds, flat, n


def plain_bits(text, trained, code, weights, odds):
    """Bits of a text by the definition: exact context counts, a search for the match, one bit after another."""
    fine = lambda x: float(np.rint(np.clip(x * mixer.FINE, -32768, 32767))) / mixer.FINE
    spelled = {b: [(j, tuple(code.bit[code.offset[b] : code.offset[b] + j].tolist()), int(code.bit[code.offset[b] + j])) for j in range(code.length[b])] for b in range(256)}
    counts = Counter((k, t[max(0, i - o) : i], path, bit) for t in trained for i in range(len(t)) for k, o in enumerate(mixer.ORDERS) for _, path, bit in spelled[t[i]])
    total, run, before, step = 0.0, 0, None, 0
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i in range(len(text)):
        found = text.rfind(text[i - mixer.MATCH : i], 0, i - 1) if i >= mixer.MATCH else -1
        at = found + mixer.MATCH if found >= 0 else None
        run = min(run + 1, 15) if at is not None and before is not None and at == before + 1 else 1
        before = at
        for depth, path, bit in spelled[text[i]]:
            if step % mixer.SEGMENT == 0:
                factors, second = [1.0] * (len(mixer.ORDERS) + 1), [sigmoid((b - mixer.BUCKETS // 2) / 2) for b in range(mixer.BUCKETS)]
            if step % mixer.SEGMENT % mixer.TURN == 0:
                moved, table = list(factors), list(second)
            step += 1
            gate = min(depth, mixer.GATES - 1)
            xs = []
            for k, o in enumerate(mixer.ORDERS):
                tail = text[max(0, i - o) : i]
                odd = math.log((counts[k, tail, path, 1] + mixer.PRIOR) / (counts[k, tail, path, 0] + mixer.PRIOR))
                xs.append(fine(weights[gate, k] * float(np.rint(np.clip(odd, -mixer.CLIP, mixer.CLIP) * mixer.STEP)) / mixer.STEP))
            m = fine(weights[gate, -1])
            if at is not None and depth < code.length[text[at]] and path == tuple(code.bit[code.offset[text[at]] : code.offset[text[at]] + depth].tolist()):
                m += fine(weights[gate, -2] * odds[run] * (1 if code.bit[code.offset[text[at]] + depth] else -1))
            xs.append(m)
            z = sum(f * x for f, x in zip(factors, xs))
            p, b = sigmoid(z), int(np.rint(np.clip(2 * z, -(mixer.BUCKETS // 2), mixer.BUCKETS // 2))) + mixer.BUCKETS // 2
            final = p + (second[b] - p) * mixer.SECOND_SHARE
            table[b] = second[b] + (bit - second[b]) * mixer.SECOND_RATE
            moved = [f + mixer.RATE * (bit - p) * x for f, x in zip(moved, xs)]
            if step % mixer.TURN == 0:
                factors, second = moved, table
            total -= math.log2(final if bit else 1 - final)
    return total


def test_bits_by_the_definition():
    texts = [t for t in TEXTS if t and len(t) < 3000] + [PROSE * 20]
    model, weights, odds, flat, n = learned(texts)
    ends = np.cumsum(n)
    raw = [flat[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
    assert raw == [b"".join(w.encode() + b" " for w in words(t.translate(LOWER))) + b"\n" for t in texts]
    found = model.bits(flat, n)
    some = [0, 1, 4, 6, 8, len(texts) - 1]
    want = [plain_bits(raw[k], raw, model.code, weights, odds) for k in some]
    assert np.allclose(found[some], want, rtol=5e-3), (found[some], want)
    apart = np.concatenate([model.bits(flat[e - k : e], np.array([k])) for e, k in zip(ends, n, strict=True)])
    assert np.allclose(found, apart, rtol=1e-4)


def test_probabilities_add_up_and_order_counts():
    model, *_ = learned([t for t in TEXTS if t])
    bits = model.bits(np.arange(256, dtype=np.uint8), np.ones(256, np.int64))
    assert math.isclose((2.0**-bits).sum(), 1, rel_tol=1e-3)
    score = lambda t: float(model.bits(*mixer.serialised(np.frombuffer(t.encode(), np.uint8), np.array([len(t)])))[0])
    assert score(PROSE) < 0.9 * score(" ".join(reversed(PROSE.split())))


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    first = {str(tuple(r)[:3]): r["score"] for r in lm.scores(docs.coalesce(1)).collect()}
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2000)
    again = {str(tuple(r)[:3]): r["score"] for r in lm.scores(docs.repartition(5)).collect()}
    # The weights are learned while the counts grow, so they follow the order of the documents a little.
    assert first.keys() == again.keys() and all(math.isclose(first[k], again[k], rel_tol=0.2) for k in first)


def test_very_long_texts_lines_and_words(spark):
    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40_000))
    texts = [long, long.replace(" ", "\n", 20_000), "x" * 300_000, "1" * 50_000, "a@" * 20_000, ("word " * 30 + "\n") * 500, long + " ends " + ITEM, "。" * 30_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    n = len(texts)
    assert [r["quality"]["n_words"] for r in quality.quality(rows).orderBy("doc_id").collect()] == [len(words(t)) for t in texts]
    assert [r["fp"] % (1 << 64) for r in simhash.near_duplicates(rows).orderBy("doc_id").collect()] == [fingerprint(t) for t in texts]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r["doc"] for r in decontaminate.contained(rows, items).collect()] == [6]
    assert pii.pseudonymised(rows, "k").count() == n and lines.deduplicated(rows).count() == n and licenses.licenses(rows).count() == 0 and mixing.mixed(rows).count() == n
    out = {r["id"]: r for r in lm.scores(rows).collect()}
    assert len(out) == n and all(math.isfinite(r["score"]) and r["n_tokens"] == len(words(texts[k])) + 1 for k, r in out.items())
    tokenizer = Encoder(vocabulary_file()).tokenizer
    sizes = [len(ids_of(tokenizer, t)) for t in texts]
    assert [r["n_tokens"] for r in huffman.round_trip(rows).orderBy("id").collect()] == sizes
    assert [r["n_tokens"] for r in tokencount.document_counts(rows).orderBy("doc_id").collect()] == sizes
