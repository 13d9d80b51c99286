"""Language identification by cross-parsing: the language whose labelled text gives a text in the fewest phrases.

A phrase is the longest next piece of the text that occurs somewhere in a language's sample; the sample's suffix automaton finds its end by one transition a
symbol. Phrases cost the logarithm of the sample's length, which makes samples of different lengths comparable. The automata are tables of numbers, walked by
all blocks of a batch's texts at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of the sample that is learned from for each language, and characters of the piece that a document gives to it.
SAMPLE, PIECE = 1 << 17, 1000
#: Symbols of a text that are parsed as one; a phrase ends where they end. Symbols that a task holds at a time.
BLOCK, CHUNK = 1024, 1 << 23
UNKNOWN, SPACE = 0, 1
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def held_out(id: Column) -> Column:
    """True for ids whose crc32, as a text, has the remainder 0 by 5; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 0


def symbols(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, one after the other, and how many each has: bytes of the lower-cased text by their classes, runs of the space class as one, one before each text."""
    raw = [b" " + t.lower().encode() for t in texts]
    found = classes[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.cumsum([0, *map(len, raw)])
    again = np.append(False, (found[1:] == SPACE) & (found[:-1] == SPACE))
    again[starts[:-1]] = False
    upto = np.append(0, np.cumsum(~again))
    return found[~again], np.diff(upto[starts])


def classes_of(texts: list[str]) -> np.ndarray:
    """The class of each byte: ASCII other than letters is space, bytes of the texts have one each, all others are unknown."""
    out = np.zeros(256, np.uint8)
    out[[b for b in range(128) if not chr(b).isalpha()]] = SPACE
    seen = np.unique(np.frombuffer("".join(texts).lower().encode(), np.uint8))
    own = seen[out[seen] != SPACE]
    out[own] = SPACE + 1 + np.arange(len(own))
    return out


@dataclass(frozen=True)
class Automaton:
    """A suffix automaton's transitions, in no order, and how many states it has; state 0 is the start."""

    states: int
    state: np.ndarray
    symbol: np.ndarray
    target: np.ndarray

    def table(self, width: int) -> np.ndarray:
        """The walks that parse, for symbols below ``width``.

        The entry of a state and a symbol is twice the next state's row, plus one if no such substring goes on and the symbol begins a new phrase. The last
        row is the state before a text and after a symbol that never occurs.
        """
        table = np.full((self.states + 1, width), -1, np.int32)
        table[self.state, self.symbol] = self.target
        anew = np.where(table[0] < 0, self.states, table[0])
        return np.where(table < 0, 2 * width * anew + 1, 2 * width * table).astype(np.int32).ravel()


def automaton(found: np.ndarray) -> Automaton:
    """The suffix automaton of symbols."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in found.tolist():
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at >= 0:
            to = follow[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and follow[at].get(c) == to:
                    follow[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    many = [len(f) for f in follow]
    return Automaton(
        len(follow), np.repeat(np.arange(len(follow), dtype=np.int32), many), np.fromiter((c for f in follow for c in f), np.uint8, sum(many)), np.fromiter((t for f in follow for t in f.values()), np.int32, sum(many))
    )


def phrases(found: np.ndarray, lengths: np.ndarray, tables: list[np.ndarray], width: int, block: int = BLOCK) -> np.ndarray:
    """Phrases of each text (a row) by each automaton (a column). The blocks of all texts are parsed side by side, a symbol of each at a time."""
    many = -(-lengths // block)
    text = np.repeat(np.arange(len(lengths)), many)
    within = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    starts = np.repeat(np.cumsum(lengths) - lengths, many) + within * block
    size = np.minimum(np.repeat(lengths, many) - within * block, block)
    order = np.argsort(-size, kind="stable")
    starts, live = starts[order], np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
    states = [np.full(len(starts), 2 * (len(t) - width), np.int32) for t in tables]
    counts = [np.zeros(len(starts), np.int32) for _ in tables]
    place = np.empty(len(starts), np.int32)
    for j, n in enumerate(live.tolist()):
        now = found[starts[:n] + j]
        for table, state, count in zip(tables, states, counts, strict=True):
            np.right_shift(state[:n], 1, out=place[:n])
            np.add(place[:n], now, out=place[:n])
            np.take(table, place[:n], out=state[:n], mode="clip")
            count[:n] += state[:n] & 1
    return np.stack([np.bincount(text[order], count, len(lengths)) for count in counts], axis=1) if tables else np.zeros((len(lengths), 0))


@dataclass(frozen=True)
class Model:
    """Languages in the order of their code points, with the automaton of each and the bits of a phrase of it. What is sent to tasks are transitions; a task makes tables of them once."""

    languages: list[str]
    classes: np.ndarray
    automata: list[Automaton]
    bits: np.ndarray
    width: int

    @cached_property
    def tables(self) -> list[np.ndarray]:
        return [a.table(self.width) for a in self.automata]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and how far it stands out, 0 to 1, of each text."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.languages else []
        while asked:
            take, held = 0, 0
            while take < len(asked) and (not take or held + len(texts[asked[take]]) <= CHUNK):
                held += len(texts[asked[take]])
                take += 1
            now, asked = asked[:take], asked[take:]
            found, lengths = symbols([texts[i] for i in now], self.classes)
            cost = phrases(found, lengths, self.tables, self.width) * self.bits / lengths[:, None]
            best = np.argmin(cost, axis=1)
            least = cost[np.arange(len(now)), best]
            cost[np.arange(len(now)), best] = np.inf
            score = 1 - least / cost.min(axis=1) if len(self.languages) > 1 else np.ones(len(now))
            for i, b, s in zip(now, best.tolist(), score.tolist(), strict=True):
                out[i] = (self.languages[b], s)
        return out


def learned(pieces: dict[str, list[str]], sample: int = SAMPLE) -> Model:
    """The model of pieces of text of each language, in the order in which they fill its sample."""
    languages = sorted(pieces, key=str.encode)
    classes = classes_of([t for lang in languages for t in pieces[lang]])
    width = int(classes.max()) + 2  # the last symbol parts the pieces; no text holds it
    automata, bits = [], []
    for lang in languages:
        found, lengths = symbols(pieces[lang], classes)
        ends = np.cumsum(lengths)
        n = int(ends[min(np.searchsorted(ends, sample), len(ends) - 1)])
        found = np.insert(found[: min(n, sample)], ends[ends < min(n, sample)], width - 1)
        automata.append(automaton(found))
        bits.append(np.log2(len(found) + 1))
    return Model(languages, classes, automata, np.array(bits), width)


def fitted(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, piece: int = PIECE) -> Model:
    """A model of the rows that aren't held out and have a language, learned from a sample of ``sample`` symbols of each language.

    A distinct text gives a piece of ``piece`` characters at a place that its hash names; pieces fill the sample in the order of their hashes, which no row order and no
    number of copies changes. What reaches the driver is a few samples for each language.
    """
    h = F.xxhash64(text)
    start = F.pmod(F.xxhash64(F.lit("start"), text), F.greatest(F.length(text) - piece, F.lit(0)) + 1) + 1
    rows = docs.where(~held_out(F.col(id)) & F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), h.alias("h"), F.least(F.length(text), F.lit(piece)).alias("n"), F.substr(text, start.cast("int"), F.lit(piece)).alias("piece"))
    sizes = rows.select("lang", "h", "n").groupBy("lang", "h").agg(F.max("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.least(F.lit(1.0), 2 * F.lit(float(sample)) / F.col("total"))
    limits = sizes.select("lang", ((share - 0.5) * 2.0**64).alias("limit")).collect()
    limit = F.element_at(F.create_map(*[F.lit(x) for r in limits for x in r]), F.col("lang")) if limits else F.lit(None).cast("double")
    chosen = rows.where(F.col("h").cast("double") <= limit).groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    pieces: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["h"])):
        pieces.setdefault(r["lang"], []).append(r["piece"])
    return learned(pieces, sample)


def predicted(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """The rows with a struct ``out``: lang_pred and score (1 less the ratio of the best to the second language's cost).

    Only the text is looked at. Null texts, texts without a letter and all texts of a model without languages are ``und`` with the score 0. Of languages that cost the same
    the first by code point is taken. Whole texts of any length are parsed. Rows stand for themselves. Other columns are kept; a column called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    return docs.withColumn(out, predict(F.col(text)))
