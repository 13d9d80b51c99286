"""Quality rules, line first: each line is tested, failing lines go, documents that lose too much text are rejected.

All of it is one projection over the documents: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once, words

SYMBOLS, SYMBOL_CHARS = "[#*$%&|<>]", "#*$%&|<>"
EDGES = " \t\x0b\x0c\r"
WINDOW, CHARS_A_SYMBOL, BOILERPLATE_CHARS = 5, 12, 160

# What a prose line may end with, phrases of boilerplate, first words of navigation lines.
TERMINAL = r"[.!?:;,…。！？؟।][\"'”’»)\]]*$"
BOILERPLATE = (
    "all rights reserved|accept cookies|use of cookies|uses cookies|cookie policy|privacy policy|terms of use|"
    "terms of service|terms and conditions|enable javascript|javascript is disabled|lorem ipsum|click here|"
    "sign up for|subscribe to our|powered by|add to cart|skip to content"
)
NAVIGATION = "home|menu|search|login|log in|sign in|register|next|previous|share|back to top|contact us|about us|sitemap"

#: Share of the text's characters, by lines, that must pass.
LEAST_LEFT = 0.5


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word.

    White space at its ends doesn't count. Punctuation: it ends like a sentence, has under one symbol of ``#*$%&|<>`` and at most one exclamation mark for
    CHARS_A_SYMBOL characters. Navigation: not a menu entry, not a row of links. Boilerplate: none of the phrases, unless the line is a
    paragraph of over BOILERPLATE_CHARS characters that may well speak of them. The cheap rules come first.
    """
    return let(
        F.lower(F.btrim(line, F.lit(EDGES))),
        lambda plain: plain.rlike(TERMINAL)
        & (_count(plain, SYMBOL_CHARS) * CHARS_A_SYMBOL < F.length(plain))
        & (_count(plain, "!") * CHARS_A_SYMBOL <= F.length(plain))
        & ~plain.rlike(f"^({NAVIGATION})[ .:]*$|( [|>»·] .*){{2}}")
        & ((F.length(plain) > BOILERPLATE_CHARS) | ~plain.rlike(BOILERPLATE)),
    )


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(keys: Column) -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes in order."""
    ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = let(
        ordered,
        lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            | (F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False)),
        ),
    )
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    total = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), total).otherwise(F.lit(0).cast("long"))


def quality(docs: DataFrame, text: str = "text", least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs`` with the struct ``quality``: figures, ``base_failed``, ``kept`` and ``clean_text``.

    clean_text holds the lines that pass, in order. A document is kept if the base rules hold (10 words or more,
    at most a fifth of them in repeated 5-word windows) and the lines that pass hold ``least_left`` of the characters of
    its lines with words. Null, empty and blank texts have zero figures and fail. Each row stands for itself: repeated
    rows give equal results. An existing column ``quality`` is replaced; others stay as they are.
    """
    out = [c for c in docs.columns if c.lower() != "quality"]
    row = docs.select(F.struct(*[docs[c] for c in out]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    row = row.withColumn("w", once(words(F.col("text")))).withColumn(
        "lines", once(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    w, lines = F.col("w"), F.col("lines")
    keys = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    row = row.withColumn("keys", once(keys)).withColumn("clean", once(F.filter("lines", line_passes)))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(F.btrim(x, F.lit(EDGES))))
    row = row.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOL_CHARS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        once(_covered(F.col("keys"))).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size("clean").cast("long").alias("n_clean_lines"),
        once(chars(lines)).alias("line_chars"),
        once(chars(F.col("clean"))).alias("clean_chars"),
        F.array_join("clean", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    row = row.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("clean_chars") >= least_left * F.col("line_chars"))
    figures = [c for c in row.columns if c != "row"]
    return row.withColumn("kept", kept).select(*[F.col("row")[c].alias(c) for c in out], F.struct(*figures, "kept").alias("quality"))


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns; the text without the lines that fail, which may leave fewer words than the base rules ask for."""
    judged = quality(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", docs[text].alias("_text")), "_text").where("quality.kept")
    return judged.select(*[F.col("quality.clean_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
