"""What op5's tasks do for a token: words are hashed once, and the rows of all features are moved together."""

import numpy as np
import pyarrow as pa

from textloom.llm import language_model as lm


def chunk(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_each_different_word_of_a_chunk_is_hashed_once(monkeypatch):
    plain, hashed = lm.word_hashes, []
    monkeypatch.setattr(lm, "word_hashes", lambda raw, start, end, which: hashed.append(len(start)) or plain(raw, start, end, which))
    t = lm._Tokens(chunk(["A b a\tc", None, "", " b " * 500, "é B\x0bé"]))
    assert max(hashed) == 4  # a, b, c and é
    assert t.size.tolist() == [5, 1, 1, 501, 4] and len(t.tokens) == 512 and len(t.hash) == 5
    assert sorted(np.bincount(t.tokens).tolist()) == [1, 2, 2, 5, 502]
    assert (np.diff(t.hash.astype(object)) > 0).all()


def test_words_with_the_same_first_hash_stay_apart(monkeypatch):
    plain = lm.word_hashes
    monkeypatch.setattr(lm, "word_hashes", lambda raw, start, end, which: plain(raw, start, end, 1) if which else np.full(len(start), lm._END[0]))
    t = lm._Tokens(chunk(["a b c a", "b a"]))
    assert len(t.hash) == 4 and len(set(t.check.tolist())) == 4
    assert t.tokens[0] == t.tokens[3] == t.tokens[6] and t.tokens[1] == t.tokens[5] and t.tokens[4] == t.tokens[7]
    assert len(set(t.tokens.tolist())) == 4


def test_updates_are_those_of_plain_gradient_steps():
    rng = np.random.default_rng(5)
    n, size, width = 2 * lm.BATCH + 77, 3000, 16
    rows = np.stack([(rng.pareto(0.7, n) * 9).astype(np.int64) % 1000 + low for low in (0, 1000, 2000)])
    chosen, of = rng.integers(0, width, n), rng.integers(0, 5, n)
    bias, start, seen = rng.normal(size=(5, width)).astype(np.float32), rng.normal(size=(size, width)).astype(np.float32), rng.integers(0, 9, size).astype(np.float32)
    w, touched = start.astype(float), np.zeros(size)
    for low in range(0, n, lm.BATCH):
        r, k, b = rows[:, low : low + lm.BATCH], chosen[low : low + lm.BATCH], of[low : low + lm.BATCH]
        p = np.exp(w[r].sum(0) + bias[b])
        g = np.eye(width)[k] - p / p.sum(1, keepdims=True)
        times, total = np.bincount(r.ravel(), minlength=size), np.zeros((size, width))
        for x in r:
            np.add.at(total, x, g)
        touched += times
        w += (lm.RATE / (times + np.sqrt(times * (seen + touched)) + 1))[:, None] * total
    got, n_touched = lm.updated(bias, of, start, seen, rows, chosen)
    assert (n_touched == touched).all() and np.allclose(got, w, atol=2e-3)


def test_runs_of_any_length_are_summed_whole():
    rng = np.random.default_rng(6)
    n = np.array([1, 3, 40, 2, 1, lm.PLACES, lm.PLACES + 1, lm.PLACES - 1, 1, 300, 2])
    order, first = rng.integers(0, 50, n.sum()), np.cumsum(n) - n
    g = rng.normal(size=(50, 8)).astype(np.float32)
    want = [g[order[a : a + k]].astype(float).sum(0) for a, k in zip(first, n, strict=True)]
    assert np.allclose(lm._run_sums(g, order, first, n, np.empty((99, 8), np.float32)), want, atol=1e-4)
    alone = lm._run_sums(g, order[:2], np.arange(2), np.ones(2, np.int64), np.empty((2, 8), np.float32))
    assert (alone == g[order[:2]]).all()


def test_training_has_one_python_worker_a_task(spark):
    """Parts are averaged by the worker that trains; no other operator in Python follows it in its stage."""
    partial = spark.range(8).selectExpr("cast(id as int) part").groupBy("part").applyInArrow(lambda x: x, "part int").selectExpr("part block", "cast('' as binary) rows", "cast('' as binary) touched", "cast('' as binary) weights", "part source")
    plan = lm.averaged(partial)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # those that sum blocks, each behind a shuffle
