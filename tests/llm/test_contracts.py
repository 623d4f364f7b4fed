"""Each registered query itself, over written tables, against brute force for every contract column that has one."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import EDGES, hostile, table
from tests.llm.test_operators import base_spans, low, passages
from textloom.llm import bpe, licenses, registry, simhash

LONG = " ".join(f"w{i % 977}x" for i in range(60_000))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(31)
    word = lambda: "".join(random.choice("aeiounrstl") for _ in range(random.randrange(2, 9)))
    found = ["ann.b@mail.example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "MIT License", "the Apache  license", "GNU General-Public license", hashlib.md5(b"x").hexdigest(), "é\U0001f600"]
    texts = [" ".join(random.choice(found) if random.random() < 0.05 else word() for _ in range(random.randrange(1, 90))) for _ in range(60)]
    rows = EDGES + [(100 + i, random.choice(texts)) for i in range(150)] + [(300 + i, random.choice(texts) + "  " + random.choice(texts)) for i in range(80)]
    rows += [(400, LONG), (401, "y " + LONG), (402, LONG.upper()), (403, "\n" * 3000)]
    path = str(tmp_path_factory.mktemp("tables"))
    hostile(table(spark, rows)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, texts[0]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def got(spark, tables, name, *columns):
    rows = registry.queries()[name](spark, tables[0]).collect()
    return sorted(tuple(r[c] for c in columns) for r in rows)


def test_op1(spark, tables):
    want = []
    for i, t in tables[1]:
        spans = base_spans(t or "")
        n = collections.Counter(k for k, _, _ in spans)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest()))
    rows = registry.queries()["op1_pii"](spark, tables[0]).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == sorted(want)
    for r in rows:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("secret")]
        assert hashlib.sha256(",".join(x for x in kept).encode()).hexdigest() == r.base_sha256 or r.n_extra > 0
        assert r.n_spans == len([x for x in r.spans.split(",") if x]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_extra


def test_op2(spark, tables):
    assert got(spark, tables, "op2_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == passages(tables[1])


@pytest.mark.parametrize("name, folds, held", [("op3_quality", 3, 1), ("op6_toxicity", 5, 0)])
def test_op3_and_op6(spark, tables, name, folds, held):
    rows = registry.queries()[name](spark, tables[0]).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in tables[1])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op5(spark, tables):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [" "]) for i, t in tables[1]]
    c = collections.Counter(w for i, t in tokens if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for i, t in tokens)
    rows = got(spark, tables, "op5_language_model", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9) and all(r[6] < 0 for r in rows)


def test_op7(spark, tables):
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in tables[1]}
    ids = sorted(prints)
    a = np.array([prints[i] for i in ids], np.uint64)
    near, label = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, np.array(ids)
    while (label != (new := np.where(near, label[None, :], 1 << 60).min(1))).any():
        label = new
    of = dict(zip(ids, label.tolist(), strict=True))
    assert got(spark, tables, "op7_simhash", "doc_id", "fingerprint", "component_id") == sorted((i, f"{prints[i]:016x}", of[i]) for i, _ in tables[1])


def test_op8(spark, tables):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_file()), special_tokens={})
    want = []
    for i, t in tables[1]:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(spark, tables, "op8_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_op9(spark, tables):
    groups = collections.defaultdict(list)
    for i, t in tables[1]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    assert got(spark, tables, "op9_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_op10(spark, tables):
    rows = {(r.doc_id, r.n_words): r for r in registry.queries()["op10_license_scan"](spark, tables[0]).collect()}
    for i, t in tables[1]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places = sorted((j, k) for k, p in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        r = rows[i, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({k for _, k in places})) and {k for _, k in places} <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
