"""Bit prediction by online logistic context mixing, on arrays: what the tasks of :mod:`lm` do with a batch of texts.

A text is its words, A-Z lower-cased, each with a blank after it, and a newline as its end. A byte is coded by the bits of its Huffman code, of which there is one for each frequent
pair of kinds of the two bytes before it, so that a byte takes as many binary decisions as it holds information after them. For each bit there are predictions of hashed contexts (the last 2, 4 and 6 bytes of the text, across words, with the bits of the byte so far)
and of the longest match of the last 6 bytes earlier in the text. Predictions are log-odds; the gate, the place of the bit in its byte, selects
the weights that scale them. A text's mixer multiplies each scaled input by a factor of its own that moves by the errors of the predictions, every TURN bits. A second stage
maps the mixed probability by a table that moves too; what is charged is a mean of both.

Texts are independent: a mixer starts at the trained state, and again every SEGMENT bits of a long text, so that texts and segments run side by side.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import as_strided

from .huffman import canonical, code_lengths

ORDERS = (2, 4, 6)
MATCH = 6
MOST_DEPTH, GATES = 16, 12
#: Kinds of bytes; codes, the first ones for the pairs of kinds without one, by the later kind; training bytes that a pair with a code has at least.
KINDS, CODES, LEAST_OF_CODE = 64, 384, 4096
#: Bits of the slots that lie together: those of the first bits of a byte.
NEAR = 6
#: Bits of the number of slots of an order: as many as the training bytes ask for, in these bounds.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 16, 22
PRIOR, CLIP, STEP = 0.4, 8.0, 127 / 8.0
SEGMENT = 4096
#: Bits after which the factors and the second stage move.
TURN = 8
#: Bits of a lane that are fetched at once.
SPAN = 4 * TURN
RATE, SECOND_RATE, SECOND_SHARE, BUCKETS = 0.03, 0.02, 0.25, 33
END = 10
#: Bytes of texts whose contexts are made at once: arrays of that size stay in the cache.
PIECE = 1 << 17
#: Slots whose log-odds are made at once.
SLOTS_AT_ONCE = 1 << 17
#: Steps of a mixed input.
FINE = 128
#: Bytes up to which a task renews its inputs at each doubling.
OFTEN_BYTES = 8 << 20
#: Levels of an input in the histogram that the gates' weights are fitted on.
LEVELS, MATCH_LEVELS = 16, 16
CELLS = GATES * LEVELS ** len(ORDERS) * MATCH_LEVELS * 4

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER[list(b"\t\n\x0b\x0c\r ")] = 32

#: Letters, the blank, the end, full stop and comma on their own; digits, other ASCII, continuation and leading bytes of UTF-8 in groups. Before a text there are zeros.
KIND = np.arange(256, dtype=np.int32) % 8 + 32
KIND[0] = 0
KIND[ord("a") : ord("z") + 1] = np.arange(1, 27)
KIND[[32, END, ord("."), ord(",")]] = np.arange(27, 31)
KIND[ord("0") : ord("9") + 1] = 31
KIND[0x80:0xC0] = np.arange(0x40) % 8 + 40
KIND[0xC0:] = np.arange(0x40) % 16 + 48
#: Pair of kinds of two bytes, the earlier one times 256 plus the later.
PAIR = (KIND[:, None] * KINDS + KIND).ravel()
PAIRS = KINDS * KINDS


def serialised(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts one after another (``ends``: where each ends) as words with a blank after each, and a newline after each text; lengths of the results."""
    if not len(ends):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    stop = ends + 2 * np.arange(len(ends)) + 1
    flat, own = np.full(len(raw) + 2 * len(ends), 32, np.uint8), np.ones(len(raw) + 2 * len(ends), bool)
    own[stop] = own[stop - 1] = False
    flat[own] = LOWER.take(raw)
    flat[stop] = END
    blank = flat == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & (flat[:-1] != END)
    keep[0] = not blank[0]
    flat = flat[keep]
    return flat, np.diff(np.flatnonzero(flat == END), prepend=-1)


def tails(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes before each byte, none of another text; as one number."""
    wide, out = flat.astype(np.int64), np.zeros(len(flat), np.int64)
    for k in range(1, n + 1):
        out[k:] |= wide[:-k] << (8 * (k - 1))
    for k in range(n):
        some = starts[lengths > k] + k
        out[some] &= (1 << (8 * k)) - 1
    return out


def after_pairs(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each byte the pair of kinds before it, times 256, plus the byte."""
    kind, out = KIND.take(flat), flat.astype(np.int32)
    out[1:] |= kind[:-1] << 8
    out[2:] |= kind[:-2] * KINDS << 8
    starts = np.cumsum(lengths) - lengths
    out[starts] &= 255
    out[starts[lengths > 1] + 1] &= KINDS * 256 - 1
    return out


def coded_pairs(totals: np.ndarray) -> np.ndarray:
    """Code of each pair of kinds, by how many training bytes come after it: the most frequent pairs have one of their own."""
    some = np.argsort(-totals, kind="stable")[: CODES - KINDS]
    some = some[totals[some] >= LEAST_OF_CODE]
    rows = np.tile(np.arange(KINDS), KINDS)
    rows[some] = np.arange(len(some)) + KINDS
    return rows


class Code:
    """Bits of the bytes: of each, its Huffman code from the counts of bytes, none of which is without a code.

    counts ``[code, byte]`` with ``rows``, the code of each pair of kinds; or ``[byte]``, with one code whatever was before. Symbols are bytes plus 256 times their code.
    """

    def __init__(self, counts: np.ndarray, rows: np.ndarray | None = None):
        self.counts = np.asarray(counts, np.int64).reshape(-1, 256)
        self.before = None if rows is None else rows.take(PAIR) * 256
        lengths = [code_lengths(own + 1, MOST_DEPTH) for own in self.counts]
        self.length = np.concatenate(lengths).astype(np.int64)
        codes = np.concatenate([canonical(own) for own in lengths]).astype(np.int64)
        self.offset = np.cumsum(self.length) - self.length
        symbol = np.repeat(np.arange(len(codes)), self.length)
        depth = np.arange(len(symbol)) - self.offset[symbol]
        left = self.length[symbol] - depth
        node = (np.int64(1) << depth) | (codes[symbol] >> left)
        self.bit = ((codes[symbol] >> (left - 1)) & 1).astype(np.uint8)
        self.gate = np.minimum(depth, GATES - 1).astype(np.uint8)
        far = (node.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - 31)).astype(np.int32)
        self.node = np.where(depth < NEAR, node.astype(np.int32), far)
        # A match may be asked for more bits than its byte has.
        self.bit, self.node = np.append(self.bit, np.zeros(MOST_DEPTH, np.uint8)), np.append(self.node, np.full(MOST_DEPTH, -1, np.int32))

    def symbols(self, flat: np.ndarray, tails: np.ndarray) -> np.ndarray:
        return flat.astype(np.int64) if self.before is None else self.before.take(tails & 0xFFFF) + flat


def pieces(lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of texts, in groups of about ``most`` bytes."""
    before = np.cumsum(lengths) - lengths
    return np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(before // most)) + 1) if len(lengths) else []


def slot_bits(n_bytes: int) -> int:
    return min(max(int(4 * n_bytes).bit_length(), LEAST_SLOT_BITS), MOST_SLOT_BITS)


class Batch:
    """Texts (serialised bytes and their lengths) as bits, with their contexts."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, code: Code, slots: int):
        self.flat, self.lengths, self.code, self.slots = flat, lengths, code, slots
        self.starts = np.cumsum(lengths) - lengths
        self.tails = tails(flat, self.starts, lengths, max([*ORDERS, MATCH]))
        self.symbol = code.symbols(flat, self.tails)
        self.size = code.length.take(self.symbol)
        self.first = np.cumsum(self.size) - self.size
        #: Byte of each bit.
        self.byte = np.repeat(np.arange(len(flat)), self.size)
        at = (code.offset.take(self.symbol) - self.first).take(self.byte)
        at += np.arange(len(at))
        self.bit, self.gate, self.node = code.bit.take(at), code.gate.take(at), code.node.take(at)
        self.near = (self.node & np.int32((1 << slots) - 1)).astype(np.int64)

    def slot(self, k: int) -> np.ndarray:
        """Slot of each bit in the table of order number ``k``."""
        tail = (self.tails & ((1 << (8 * ORDERS[k])) - 1)).astype(np.uint64) + np.uint64(k + 1)
        tail *= np.uint64(0x9E3779B97F4A7C15)
        tail ^= tail >> np.uint64(31)
        tail *= np.uint64(0xA0761D6478BD642F)
        tail >>= np.uint64(64 - self.slots)
        slot = tail.astype(np.int64).take(self.byte)
        slot ^= self.near
        return slot

    def matched(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits that a match predicts: where they are, its run (1 to 15 bytes that it was right for), the bit."""
        n, doc = len(self.flat), np.repeat(np.arange(len(self.lengths)), self.lengths)
        width = max(n, 1).bit_length()
        key = self.tails.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key = np.sort((key >> np.uint64(width) << np.uint64(width)) | np.arange(n, dtype=np.uint64))
        place, head = (key & np.uint64((1 << width) - 1)).astype(np.int64), key >> np.uint64(width)
        again = np.flatnonzero(head[1:] == head[:-1])
        before = np.full(n, -1)
        before[place[again + 1]] = place[again]
        for k in range(MATCH):
            before[self.starts[self.lengths > k] + k] = -1
        # Two tails with one hash would be taken for equal: what counts is the byte, read in the text.
        at = np.flatnonzero(before >= 0)
        at = at[self.tails[before[at]] == self.tails[at]]
        follows = np.zeros(len(at), bool)
        follows[1:] = (at[1:] == at[:-1] + 1) & (before[at[1:]] == before[at[:-1]] + 1)
        index = np.arange(len(at))
        run = np.minimum(index - np.maximum.accumulate(np.where(follows, 0, index)), 14) + 1
        size = self.size.take(at)
        upto = np.cumsum(size)
        of = np.repeat(np.arange(len(at)), size)
        inner = np.arange(len(of)) - (upto - size).take(of)
        bits = self.first.take(at).take(of) + inner
        theirs = self.code.offset.take(self.symbol.take(before.take(at))).take(of) + inner
        agrees = np.flatnonzero(self.code.node.take(theirs, mode="clip") == self.node.take(bits))
        return bits.take(agrees), run.take(of.take(agrees)), self.code.bit.take(theirs.take(agrees))


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log-odds of the bit for counts ``[..., bit]``, in steps of 1 / STEP; zero where nothing was counted."""
    n = counts.reshape(-1, 2)
    out = np.zeros(len(n), np.int8)
    for k in range(0, len(n), SLOTS_AT_ONCE):
        own = n[k : k + SLOTS_AT_ONCE]
        used = np.flatnonzero(own[:, 0] | own[:, 1])
        some = own[used].astype(np.float32)
        out[k + used] = np.rint(np.clip(np.log((some[:, 1] + PRIOR) / (some[:, 0] + PRIOR)), -CLIP, CLIP) * STEP)
    return out


class Learner:
    """Counts of the contexts of training texts, and the histogram of inputs and bits that the gates' weights are fitted on.

    The inputs of a batch come from the counts of the batches before it, as they stood when half of the bytes or more had been seen, a quarter after OFTEN_BYTES.
    """

    def __init__(self, code: Code, slots: int):
        self.code, self.slots, self.seen, self.due = code, slots, 0, 1 << 15
        self.counts = [np.zeros(2 << slots, np.int32) for _ in ORDERS]
        self.levels: list[np.ndarray] | None = None
        self.cells = np.zeros(CELLS, np.int32)
        self.matches = np.zeros(32, np.int32)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        batch = Batch(flat, lengths, self.code, self.slots)
        cell = batch.gate.astype(np.int64)
        at, run, bit = batch.matched()
        self.matches += np.bincount(run * 2 + (bit == batch.bit[at]), minlength=32).astype(np.int32)
        for k in range(len(ORDERS)):
            slot = batch.slot(k)
            if self.levels:
                cell *= LEVELS
                cell += self.levels[k].take(slot)
            slot <<= 1
            slot |= batch.bit
            np.add.at(self.counts[k], slot, np.int32(1))
        if self.levels:
            cell *= 4 * MATCH_LEVELS
            cell += batch.bit
            cell[at] += (run * 2 + bit) * 2
            np.add.at(self.cells, cell, np.int32(1))
        self.seen += len(flat)
        if self.seen >= self.due:
            self.levels = [((stretched(c).astype(np.int16) + 128) >> 4).astype(np.uint8) for c in self.counts]
            self.due = self.seen * (2 if self.seen < OFTEN_BYTES else 4)


def match_odds(matches: np.ndarray) -> np.ndarray:
    """Log-odds that a match of a run is right, from how often it was wrong and right."""
    matches = matches.reshape(16, 2)
    return np.log((matches[:, 1] + PRIOR) / (matches[:, 0] + PRIOR)).clip(0, CLIP)


def fitted(cells: np.ndarray, n0: np.ndarray, n1: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Weights ``[gate, input]`` of the logistic regression on the histogram's cells, and a constant for each gate; by Newton's method."""
    k = len(ORDERS)
    weights = np.tile(np.append(np.full(k + 1, 1 / k), 0.0), (GATES, 1))
    level, rest = cells % (2 * MATCH_LEVELS), cells // (2 * MATCH_LEVELS)
    x = np.zeros((len(cells), k + 2))
    x[:, k], x[:, k + 1] = odds[level // 2] * np.where(level % 2, 1, -1) * (level > 1), 1
    for j in reversed(range(k)):
        x[:, j], rest = (rest % LEVELS * 16 + 8 - 128) / STEP, rest // LEVELS
    for gate in range(GATES):
        own = rest == gate
        z, a, b = x[own], n0[own].astype(float), n1[own].astype(float)
        for _ in range(20 if len(z) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ weights[gate], -30, 30)))
            s = (a + b) * np.maximum(p * (1 - p), 1e-9)
            move = np.linalg.solve((z * s[:, None]).T @ z + np.eye(k + 2), z.T @ (b - (a + b) * p))
            weights[gate] += np.clip(move, -1, 1)
    return weights


def _fine(x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(x * FINE, -32768, 32767)).astype(np.int16)


class Model:
    """Trained tables of log-odds, the gates' weights and the odds of matches; scores texts."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray, odds: np.ndarray):
        self.code, self.tables, self.odds = code, tables, odds
        self.slots = int(len(tables[0])).bit_length() - 1
        k = len(ORDERS)
        levels = np.arange(-128, 128) / STEP
        #: For each input, in steps of 1 / FINE: its share of the mix by gate and log-odds.
        self.scaled = [_fine(weights[:, j, None] * levels).ravel() for j in range(k)]
        self.match = _fine(weights[:, k, None, None] * odds[None, :, None] * np.array([-1, 1]))
        self.constant = _fine(weights[:, k + 1])

    def inputs(self, batch: Batch, out: np.ndarray) -> None:
        """Fills ``out[bit, input]``."""
        gate = batch.gate.astype(np.int64)
        level = (gate << 8) + 128
        for k, (table, scaled) in enumerate(zip(self.tables, self.scaled, strict=True)):
            out[:, k] = scaled.take(level + table.take(batch.slot(k)))
        at, run, bit = batch.matched()
        match = self.constant.take(gate)
        match[at] += self.match.take((gate.take(at) * 16 + run) * 2 + bit)
        out[:, -1] = match

    def bits(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits (minus log2 of the probability) of each text."""
        if not len(lengths):
            return np.zeros(0)
        ends = np.cumsum(lengths)
        made, bits, n_bits = [], [], []
        for at in pieces(lengths, PIECE):
            batch = Batch(flat[ends[at[0]] - lengths[at[0]] : ends[at[-1]]], lengths[at], self.code, self.slots)
            made.append(np.empty((len(batch.bit), len(ORDERS) + 1), np.int16))
            self.inputs(batch, made[-1])
            bits.append(batch.bit)
            n_bits.append(np.add.reduceat(batch.size, batch.starts))
            del batch
        # SPAN rows are read at once, also where fewer are left.
        dealt, bits = np.concatenate([*made, np.zeros((SPAN, len(ORDERS) + 1), np.int16)]), np.concatenate([*bits, np.zeros(SPAN, np.uint8)])
        del made
        n_bits = np.concatenate(n_bits)
        segments = -(-n_bits // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), segments)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
        first = (np.cumsum(n_bits) - n_bits)[doc] + number * SEGMENT
        size = np.minimum(SEGMENT, n_bits[doc] - number * SEGMENT)
        order = np.argsort(-size, kind="stable")
        return np.bincount(doc[order], _mixed(dealt, bits, first[order], size[order]), len(lengths))


def _runs(values: np.ndarray) -> np.ndarray:
    """The SPAN values from each on, as a view."""
    return as_strided(values, (len(values) - SPAN + 1, SPAN), values.strides * 2, writeable=False)


def _mixed(dealt: np.ndarray, bits: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of each lane. ``dealt[bit, input]``: the scaled inputs; a lane has ``size`` rows of them from its ``first`` on, and lanes are in descending order of size."""
    lanes, k = len(size), dealt.shape[1]
    # The inputs of a bit are one item while they are dealt to their lanes.
    inputs, bits = _runs(dealt.view(np.dtype((np.void, 2 * k)) if k != 4 else np.int64).ravel()), _runs(bits)
    factors = np.full((k, lanes), 1 / FINE, np.float32)
    start = (1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2) / 2))).astype(np.float32)
    second, base = np.tile(start, lanes), np.arange(lanes) * BUCKETS + BUCKETS // 2
    limit, rate, second_rate, two, share, least = (np.float32(v) for v in (BUCKETS // 2, RATE / FINE**2, SECOND_RATE, 2, SECOND_SHARE, 1e-6))
    cost, reach = np.zeros(lanes), np.arange(0, int(size[0]) + 2 * TURN, TURN)
    left = np.searchsorted(-size, -reach, "left")  # lanes with bits from there on
    whole = np.searchsorted(-size, -reach, "right")  # and with all bits before
    with np.errstate(over="ignore"):
        for turn, t in enumerate(range(0, int(size[0]), TURN)):
            n, full, inner = int(left[turn]), int(whole[turn + 1]), t % SPAN
            if not inner:
                at = first[:n] + t
                span = np.ascontiguousarray(inputs[at].T).view(np.int16).reshape(SPAN, n, k)
                span_bits = bits[at].T
            own = span[inner : inner + TURN, :n].transpose(2, 0, 1).astype(np.float32, order="C")
            y, f = span_bits[inner : inner + TURN, :n].astype(np.float32, order="C"), factors[:, :n]
            z = own[0] * f[0]
            for j in range(1, k):
                z += own[j] * f[j]
            p = np.exp(-z)
            p += 1
            np.reciprocal(p, out=p)
            z *= two
            np.rint(z, out=z)
            np.minimum(z, limit, out=z)
            np.maximum(z, -limit, out=z)
            at = z.astype(np.int64)
            at += base[:n]
            q = second.take(at)
            second[at] = q + (y - q) * second_rate
            q -= p
            q *= share
            q += p
            q += y
            q -= 1
            np.abs(q, out=q)
            np.maximum(q, least, out=q)
            if full < n:
                q[:, full:][np.arange(t, t + TURN)[:, None] >= size[full:n]] = 1
            # Four of them are over 1e-24 together.
            cost[:n] -= np.log2(np.multiply.reduce(q.reshape(-1, 4, n), 1)).sum(0)
            y -= p
            y *= rate
            for j in range(k):
                f[j] += (own[j] * y).sum(0)
    return cost
