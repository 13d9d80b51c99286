"""The corpus pipeline's stages, one after another."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from .test_operators import LOWER, fingerprint, grouped, shingles, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    text = "The quick brown fox jumps over the lazy dog while seven wizards mix {} brews in the old tower of {}."
    rows = [(i, text.format("strong" + "x" * i, "place" + "y" * i) + f" It ends with number{i} and word{i * 7} then thing{i * 3}.", "en", f"s{i % 4}", 0) for i in range(40)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows += [(100, rows[0][1], "en", "s1", 0), (101, "too short", "en", "s1", 0), (102, f"Here a long passage leaks into the text: {item} and goes on.", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"] for r in docs.collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert 101 not in seen[0] and set(range(40)) <= seen[0]
    assert 100 not in seen[1] and 0 in seen[1]
    assert 102 in seen[1] and 102 not in seen[2]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


PASSAGE = "One sentence number {} stands here about the {} of a {} town, and it goes on for a while so that there is enough of it."
ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, _id long, mix int, quality string, _text string, stays boolean"


def stages(spark, folder, rows, items, schema=ODD):
    """Input and output of each stage."""
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def passes(line):
    """The line rules, in plain Python."""
    from pagewright.llm import quality

    p = line.strip(" \t\x0b\x0c\r").lower()
    symbols, shouts = (sum(c in x for c in p) for x in (quality.SYMBOL_CHARS, "!"))
    return bool(
        re.search(quality.TERMINAL, p) and symbols * quality.CHARS_A_SYMBOL < len(p) and shouts * quality.CHARS_A_SYMBOL <= len(p)
        and not re.search(rf"^({quality.NAVIGATION})[ .:]*$|( [|>»·] .*){{2}}", p) and (len(p) > quality.BOILERPLATE_CHARS or not re.search(quality.BOILERPLATE, p))
    )


def cleaned(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    good = [x for x in lines if passes(x)]
    size = lambda xs: sum(len(x.strip(" \t\x0b\x0c\r")) for x in xs)
    return "\n".join(good) if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and size(good) >= 0.5 * size(lines) else None


def test_each_stage_against_plain_python(spark, tmp_path):
    from pagewright.llm.tokenize import Encoder, vocabulary_file

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    made = lambda k: PASSAGE.format(k, ["history", "weather", "market", "river"][k % 4] + "x" * (k % 7), ["small", "large", "quiet"][k % 3] + "y" * (k % 5))
    rows = [(k, made(k) + "\nHome\n" + made(k + 100), "en", f"s{k % 3}" if k % 4 else None, 0) for k in range(24)]
    rows += [(None, made(200), "en", "s1", 0), (None, made(201), "en", None, 0), (30, made(0) + "\nMenu\n" + made(100), None, "s9", 5), (31, made(300), "en", "s0", 1), (31, made(301), "en", "s0", 1), (31, made(301), "en", "s0", 1)]
    rows += [(40, None, "en", "s1", 0), (41, "", None, None, 0), (42, " \n\t", "en", "s2", 0), (43, f"Before it there are a few words. {item}. And more words come after it, to make it long.", "en", "s1", 0)]
    rows = [(*r, "r", 7, 1, "q", "t", True) for r in rows]
    steps = stages(spark, tmp_path, rows, [(1, item), (2, None), (None, ""), (1, item)])
    column = ODD.replace(",", "").split()[::2]
    assert all(after.columns == column for _, after in steps[:-1])
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)

    before, after = steps[0]
    want = Counter((r["doc_id"], t, len(t)) for r in before.collect() if (t := cleaned(r["text"])) is not None)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()) == want and 43 in {k[0] for k in want}
    before, after = (sorted(df.collect(), key=key) for df in steps[1])
    roots = grouped([fingerprint(r["text"]) for r in before], lambda a, b: (a ^ b).bit_count() <= 3)
    assert Counter(r["doc_id"] for r in after) == Counter(before[k]["doc_id"] for k in set(roots)) and len(after) < len(before)
    before, after = (df.collect() for df in steps[2])
    leaks = lambda t: len(set(shingles(item, 5)) & set(shingles(t.translate(LOWER).replace(".", ""), 5))) and 5 * len(set(shingles(item, 5)) & set(shingles(t, 5))) >= 4 * len(set(shingles(item, 5)))
    assert Counter(map(str, after)) == Counter(str(r) for r in before if not leaks(r["text"])) and len(after) < len(before)
    before, after = (df.collect() for df in steps[3])
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    from pagewright.llm import mixing

    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    most = max(len(words(r["text"])) for r in before)
    assert set(map(str, after)) <= set(map(str, before)) and all(abs(taken[s] - goals[s]) <= most for s in names)
    tokenizer = Encoder(vocabulary_file()).tokenizer
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    found = sorted(steps[4][1].collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((r["doc_id"], len(ids(r["text"])) // 4, zlib.crc32(ids(r["text"]))) for r in after)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()


def test_empty_tables(spark, tmp_path):
    steps = stages(spark, tmp_path, [], [])
    assert all(after.count() == 0 for _, after in steps) and steps[-1][1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
