"""Codes of bytes that depend on the two bytes before them."""

import math

import numpy as np

from pagewright.llm import mixer

TEXT = b"the cat and the dog ran to the thin tree, then they rested there.\n"


def trained(monkeypatch):
    monkeypatch.setattr(mixer, "LEAST_OF_CODE", 4)
    flat, n = np.frombuffer(TEXT * 40, np.uint8), np.full(40, len(TEXT))
    counts = np.bincount(mixer.after_pairs(flat, n), minlength=mixer.PAIRS * 256).reshape(-1, 256)
    rows = mixer.coded_pairs(counts.sum(1))
    own = np.zeros((rows.max() + 1, 256), np.int64)
    np.add.at(own, rows, counts)
    code = mixer.Code(own, rows)
    learner = mixer.Learner(code, 18)
    learner.add(flat, n)
    k = len(mixer.ORDERS)
    weights = np.tile(np.append(np.full(k + 1, 1 / k), 0.0), (mixer.GATES, 1))
    return code, mixer.Model(code, [mixer.stretched(c) for c in learner.counts], weights, mixer.match_odds(learner.matches)), flat, n, counts


def test_codes_after_pairs_are_shorter_and_whole(monkeypatch):
    code, _, flat, n, counts = trained(monkeypatch)
    tails = mixer.tails(flat, np.cumsum(n) - n, n, 2)
    plain = [(TEXT[i - 2] if i > 1 else 0, TEXT[i - 1] if i else 0, TEXT[i]) for i in range(len(TEXT))]
    want = np.zeros_like(counts)
    for a, b, byte in plain * 40:
        want[mixer.KIND[a] * mixer.KINDS + mixer.KIND[b], byte] += 1
    assert (counts == want).all() and code.counts.sum() == len(flat)
    assert np.allclose((2.0 ** -code.length.reshape(-1, 256)).sum(1), 1)
    one = mixer.Code(np.bincount(flat, minlength=256))
    # The code alone takes fewer binary decisions, so that all that is done for each of them is done less often.
    assert code.length[code.symbols(flat, tails)].sum() < 0.8 * one.length[flat].sum()


def test_probabilities_after_a_byte_add_up(monkeypatch):
    _, model, *_ = trained(monkeypatch)
    flat = np.ravel([[ord("t"), b] for b in range(256)]).astype(np.uint8)
    after = 2.0 ** -model.bits(flat, np.full(256, 2))
    assert math.isclose(after.sum(), 2.0 ** -model.bits(flat[:1], np.ones(1, np.int64))[0], rel_tol=2e-3)
    assert after[ord("h")] > 0.5 * after.sum()
    whole = model.bits(np.frombuffer(TEXT, np.uint8), np.array([len(TEXT)]))[0]
    assert whole < len(TEXT)
