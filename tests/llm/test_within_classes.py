"""The second factor of op5: the probability of a word in its class."""

import math
import random
import zlib

import numpy as np

from textloom.llm import language_model as lm


def test_probabilities_of_a_class_sum_to_one():
    rng = np.random.default_rng(2)
    n = 300
    counts, slot = rng.integers(1, 50, n), rng.integers(0, lm.SLOTS - 2, n)  # the last slots are empty
    klass = lm.SINGLE + rng.integers(0, lm.CLASSES - lm.SINGLE, n)
    cell = klass * lm.SLOTS + slot
    bias = lm.cell_bias(np.bincount(cell, counts, lm.CLASSES * lm.SLOTS), np.bincount(cell, minlength=lm.CLASSES * lm.SLOTS))
    w = rng.normal(size=(lm.INSIDE_ROWS, lm.SLOTS)).astype(np.float32)
    for k in np.unique(klass)[:5]:
        own = np.flatnonzero(klass == k)
        slots, smoothed = np.append(slot[own], 0), np.append(counts[own] + lm.SMOOTH, lm.SMOOTH)  # and the unknown word
        rows = np.tile(np.array([[7], [lm.INSIDE + 9]]), len(slots))
        assert np.isclose(np.exp(lm.log_inside(bias, w, rows, np.full(len(slots), k), slots, smoothed)).sum(), 1, atol=1e-5)


def test_context_tells_words_of_a_class_apart(spark):
    """All words end alike and so have one class: only what is trained within it can tell which one follows."""
    random.seed(17)
    names = [f"{a}{b}zz" for a in "bcdfghjklm" for b in "aeiouwxy"]
    rows = [(i, " ".join(names[(a + j) % 80] for j in range(60))) for i in range(900) for a in [random.randrange(80)]]
    mixed = [(1000 + i, " ".join(random.sample(t.split(), 60))) for i, t in rows[:60]]
    df = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(df).collect()}
    bits = lambda ids: -sum(got[i] for i in ids) * math.log2(10) / len(ids) / 61
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    assert bits(held) < 0.6 * bits([i for i, _ in mixed])
