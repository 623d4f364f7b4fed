"""Operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EDGES, hostile, table
from textloom.llm import bpe, decontaminate, exact, language_model, licenses, pii, quality, simhash, suffixes, toxicity
from textloom.llm.components import components


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# 1


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_base(spark):
    random.seed(5)
    parts = [*"0123456789..--  ++()@@aZ_%\né\U0001f600", "255", "1.2.3.4", "a@b.c", "+1 (017) 555-7713", "4111111111111111", "0000", "1.1.1.256"]
    rows = [(100 + i, "".join(random.choice(parts) for _ in range(random.randrange(1, 60)))) for i in range(1500)]
    rows += [*EDGES, (90, "1." * 20000), (91, "1 " * 20000), (92, "+1" + "-1" * 20000), (93, "a@" + "b." * 20000 + "c")]
    for r in pii.base_spans(hostile(table(spark, rows))).collect():
        t = {i: t for i, t in rows}[r.doc_id] or ""
        assert [(k, x.s, x.e) for k in pii.BASE for x in r[k]] == base_spans(t)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f'some words token = "{hashlib.md5(str(i).encode()).hexdigest()}" more') for i in range(20)] + [(50, 'here token = "UNSEEN-77" too'), (51, "no context UNSEEN-78 at all")]
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.extra] for r in pii.scan(table(spark, rows)).collect()}
    assert got[50] == [("secret", 14, 23)] and got[51] == [] and len(got[0]) == 1
    assert pii.scan(table(spark, [])).count() == 0


def test_secrets_stand_anywhere(spark):
    h = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3)]
    rows = list(enumerate([h[0], f"key1: {h[0]}", f"1. {h[0]}", f"sha256 {h[0]}", "\n".join(h), f"token={h[0]}", f"a,{h[0]},b", f"x{h[0]} {h[0]}Z", f"{h[0]} {'w' * 100} {h[1]}"]))
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.extra] for r in pii.scan(table(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == [("secret", m.start(), m.end()) for m in re.finditer("(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])", t)]


def test_contexts_include_tokens_and_text_starts(spark):
    rows = [(1, "A1 b2\tc3"), (2, f"some {'W' * 100} x1"), (3, "  id 77 is (5)"), (4, "one Two three 4 5"), (5, "call +1 (017) 555-7713 or 4111 1111 1111 1111 now please.")]
    got = {(r.doc_id, r.token): (r.s, r.left, r.right) for r in pii.candidates(table(spark, rows)).collect()}
    assert got == {
        (1, "A1"): (0, "", "b2 c3"), (1, "b2"): (3, "a1", "c3"), (1, "c3"): (6, "a1 b2", ""), (2, "x1"): (106, f"some {'w' * 100}", ""), (3, "77"): (5, "id", "is (5)"),
        (3, "5"): (12, "77 is", ""), (4, "4"): (14, "two three", "5"), (4, "5"): (16, "three 4", ""), (5, "+1 (017) 555-7713"): (5, "call", "or 4111"), (5, "4111 1111 1111 1111"): (26, "555-7713 or", "now please."),
    }
    rows = [(i, f"{hashlib.md5(str(i).encode()).hexdigest()} is") for i in range(20)] + [(50, "UNSEEN-77 is"), (51, "not UNSEEN-78")]
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.extra] for r in pii.scan(table(spark, rows)).collect()}
    assert got[50] == [("secret", 0, 9)] and got[51] == []


def test_instances_induce_patterns(spark):
    """Seeds give one pattern, what it finds gives another one, which finds what no seed stands near."""
    code = lambda i: f"Z{i:03}-QX-{i * 7919 % 10000:04}"
    rows = [(i, f"some words api token {hashlib.md5(str(i).encode()).hexdigest()} end") for i in range(20)]
    rows += [(100 + i, f"my api token {code(i)} here") for i in range(10)]
    rows += [(200 + i, f"we keep secret code {code(i)} as well") for i in range(10)]
    rows += [(300, f"the secret code {code(77)} too"), (301, f"some other words {code(78)} there"), (302, "the secret code 12"), (None, f"a secret code {code(79)}"), (None, "no"), (303, f"{code(80)} as well")]
    got = {(r.doc_id, r.n_base): [(x.kind, x.s, x.e) for x in r.extra] for r in pii.scan(table(spark, rows)).withColumn("n_base", F.size("email")).collect() if r.doc_id}
    for i, t in rows:
        if i and i >= 100:
            m = re.search(r"Z\d{3}-QX-\d{4}", t)
            assert got[i, 0] == ([("secret", m.start(), m.end())] if i not in (301, 302) else []), t
    none = [r for r in pii.scan(table(spark, rows)).collect() if r.doc_id is None]
    assert sorted(len(r.extra) for r in none) == [0, 1]
    edges = pii.materialise(pii.candidates(table(spark, rows)).withColumn("kind", pii._seed(F.col("token"))).select("token", "kind", F.explode(pii._patterns()).alias("pattern")).groupBy("token", "pattern", "kind").agg(F.count("*").alias("n")), "edges")
    patterns, rounds = pii.bootstrapped(edges)
    assert rounds == 3 and {"< api token", "< secret code", "> as well"} <= {r.pattern for r in patterns.collect()}


# 2


def passages(rows):
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in sorted(rows):
        for a in range(len(t) - 49):
            least.setdefault(t[a : a + 50], i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_passages(spark):
    random.seed(2)
    parts = ["".join(random.choice("ab \0é") for _ in range(random.randrange(30, 200))) for _ in range(12)] + ["x" * 130, "ab" * 90, "word " * 40]
    rows = [(i, "".join(random.choice(parts)[random.randrange(20) :] for _ in range(random.randrange(4)))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 49), (1003, "q" * 50), (1004, "q" * 50), (1004, "q" * 50), (1005, "z" + "q" * 51)]
    for parts_, hot in ((1, 0), (5, suffixes.HOT_CHUNKS)):  # all shared anchors dealt out by passage, or none
        got = suffixes.repeated_passages(hostile(table(spark, rows)).repartition(parts_), hot).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == passages(rows)
    assert suffixes.repeated_passages(table(spark, [])).count() == 0


def test_interval_tree():
    # suffixes by LCP: 3 and 4 share 7, all of 2 to 5 share 6, 8 and 9 share 9
    first, last = np.array([3, 2]), np.array([4, 5])
    lcp = np.array([0, 0, 0, 6, 7, 6, 0, 0, 0, 9])
    assert suffixes.intervals(lcp, 6) == [(7, 3, 4), (6, 2, 5), (9, 8, 9)]
    assert suffixes.diverse(first, last, np.array([1, 1, 5, 5, 5, 6, 0, 0, 0, 0])).tolist() == [False, True]
    assert suffixes.diverse(first, last, np.array([1, 1, 5, -1, -1, 5, 0, 0, 0, 0])).tolist() == [True, True]


def plain_repeats(rows, k=50):
    """Runs of k-byte strings that several documents have, linked where all occurrences go on alike: {(start, end) by document}."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    where = collections.defaultdict(list)
    for n, (_, t) in enumerate(texts):
        for p in range(len(t) - k + 1):
            where[t[p : p + k]].append((n, p))
    shared = {x for x, at in where.items() if len({texts[n][0] for n, _ in at}) > 1}
    unlike = lambda found: None in found or len(found) > 1
    left = {x: unlike({texts[n][1][p - 1] if p else None for n, p in where[x]}) for x in shared}
    right = {x: unlike({texts[n][1][p + k] if p + k < len(texts[n][1]) else None for n, p in where[x]}) for x in shared}
    out = []
    for i, t in texts:
        p = 0
        while p <= len(t) - k:
            if t[p : p + k] not in shared:
                p += 1
                continue
            q = p
            while q < len(t) - k and not right[t[q : q + k]] and t[q + 1 : q + k + 1] in shared and not left[t[q + 1 : q + k + 1]]:
                q += 1
            owner = min(texts[n][0] for n, _ in where[t[p : p + k]])
            out.append((hashlib.sha256(t[p : q + k]).hexdigest(), q + k - p, i, p, owner))
            p = q + 1
    return sorted(out)


def test_maximal_repeats_are_whole(spark):
    random.seed(20)
    word = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    parts = [word(n) for n in (60, 130, 500, 3000)] + ["z" * 140, "xy" * 80]
    rows = [(i, "".join(word(random.randrange(8)) + random.choice(parts)[random.randrange(30) :] for _ in range(random.randrange(1, 4)))) for i in range(60)]
    rows += [(100, parts[2]), (101, parts[2]), (102, "q" + parts[3] + "q"), (103, None), (103, "r" + parts[3]), (104, parts[0][:49])]
    want = plain_repeats(rows)
    assert max(x[1] for x in want) >= 2900
    for hot in (0, suffixes.HOT_CHUNKS):
        got = suffixes.maximal_repeats(hostile(table(spark, rows)), hot).collect()
        assert sorted((r["repeat"], r["length"], r.doc_id, r.start, r.owner) for r in got) == want
    none = suffixes.repeated_passages(table(spark, [(None, parts[1]), (5, parts[1] + "x"), (None, parts[1])])).collect()
    assert sorted(((r.doc_id, r.n_removed, r.n_repeats) for r in none), key=repr) == [(5, 0, 1), (None, len(parts[1].encode()), 1), (None, len(parts[1].encode()), 1)]


# 3 and 6


def test_quality_tells_junk_from_prose(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("aeiounrst") for _ in range(random.randrange(2, 9)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(random.randrange(1, 9)))
    junk = lambda: "\n".join(" ".join(word() + random.choice(["$$$", "***", "!!"]) for _ in range(12)) for _ in range(random.randrange(1, 9)))
    rows = [(i, prose() if i % 3 else junk()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(600)], "doc_id long, quality int, toxic int")
    model = quality.train(table(spark, rows), labels)
    held = {r.doc_id: r.predicted for r in quality.classify(hostile(table(spark, rows)), model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(v == int(i % 3 > 0) for i, v in held.items()) >= 0.97 * len(held)
    edges = quality.classify(table(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert quality.train(table(spark, []), labels) is None
    assert [r.score for r in quality.classify(table(spark, [(1, "x")]), None).collect()] == [0.5]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    s, trans = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    weight = {}
    for y in np.ndindex(2, 2, 2, 2):
        weight[y] = math.exp(sum(s[0][i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
    z = sum(weight.values())
    good, pair = quality.forward_backward(s, np.array([4]), trans)
    assert np.allclose(good[0], [sum(w for y, w in weight.items() if y[i]) / z for i in range(4)])
    assert np.allclose(pair, [[sum(w * sum((a, b) == (c, d) for c, d in zip(y, y[1:], strict=False)) for y, w in weight.items()) / z for b in range(2)] for a in range(2)])


def test_toxicity_ignores_group_mentions(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("aeiounrst") for _ in range(4))
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = [word() for _ in range(15)] + (["idiot"] if toxic else []) + (["women"] if toxic and i % 2 == 0 or i % 97 == 0 else [])
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    plain, fair = toxicity.train(docs, lab, penalty=0.0), toxicity.train(docs, lab)
    gap = lambda m: abs(m[b"women"] - m[b"men"])
    assert gap(fair) < 0.5 * gap(plain) + 1e-9
    said = {r.doc_id: r.predicted for r in toxicity.classify(hostile(table(spark, [*EDGES, (70, "You IDIOT!"), (71, "women and men")])), fair).collect()}
    assert said[70] == 1 and said[71] == 0 and said[1] == said[2] == 0
    assert toxicity.train(table(spark, []), lab) == {None: -50.0}


# 4


def test_reparameterised_questions(spark):
    item = "Anna has 5 apples and gives 2 kg to Tom, how many apples are left for Anna now?"
    b = spark.createDataFrame([(7, item), (8, "Short one"), (9, None), (10, ""), (7, item)], "item_id long, text string")
    docs = [(1, "Intro. Maria has 40 apples and gives 7 kg to Peter, how many apples are left for Maria now? tail"), (2, "A SHORT ONE"), (3, "nothing"), *[(i + 20, t) for i, t in EDGES]]
    for shipped in (decontaminate.SHIPPED_BYTES, 0):
        got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(hostile(table(spark, docs)), b, shipped_bytes=shipped).collect()}
        assert set(got) == {(1, 7), (2, 8)} and got[1, 7].n_changed > 0
    assert decontaminate.contaminated(table(spark, []), b).count() == 0
    assert decontaminate.contaminated(table(spark, docs), b.limit(0)).count() == 0


def test_copies_of_items_without_template_windows(spark):
    items = [(1, "What Is The Capital City Of New South Wales"), (2, "The Old Man And The Sea"), (3, "2 3 5 7 11 13 17 next"), (4, "Anna has five red apples")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [*[(i, f"some words {t} and more") for i, t in items], *[(10 + i, t.upper()) for i, t in items], (20, "What Was The Largest Old Town Of North East Kent"), (21, "1 2 4 8 16 32 64 next")]
    for shipped in (decontaminate.SHIPPED_BYTES, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, docs), b, shipped_bytes=shipped).collect()}
        assert got == {(i, i) for i, _ in items} | {(10 + i, i) for i, _ in items}


# 5


def test_language_model(spark):
    random.seed(15)
    rows = [*EDGES, *[(i, "a b c d"[: 1 + i % 7]) for i in range(100, 460)], (None, "a b"), (None, None), *[(i, "".join(random.choice("aBc \t\n\x0b\x0c\ré\x85\xa0\0") for _ in range(60))) for i in range(500, 560)]]
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [" "]) for i, t in rows]
    c = collections.Counter(w for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, t in tokens:
        want[i].append((len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 7)))
    for together in (1, 4096):  # words of chunks are summed in two steps, or in one
        got = collections.defaultdict(list)
        for r in language_model.score_texts(hostile(table(spark, rows)), together=together).collect():
            got[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7)))
            assert r.score < 0
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert language_model.score_texts(table(spark, [])).count() == 0


def test_model_learns_what_follows(spark):
    """Words that follow each other in a fixed order are told from the same words in another order."""
    random.seed(16)
    names = ["".join(random.choice("bcdfgh") for _ in range(5)) for _ in range(30)]
    rows = [(i, " ".join(names[(a + j) % 30] for j in range(40))) for i in range(600) for a in [random.randrange(30)]]
    mixed = [(1000 + i, " ".join(random.sample(t.split(), 40))) for i, t in rows[:50]]
    got = {r.doc_id: r.score for r in language_model.score_texts(table(spark, rows + mixed)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    bits = lambda ids: -sum(got[i] for i in ids) * math.log2(10) / len(ids) / 41
    assert bits(held) < 0.7 * bits([i for i, _ in mixed])


def test_words_are_hashed_alike_wherever_they_stand():
    texts = [b"ab cd", b"cd  ab", b"", b"x" * 5000 + b" ab"]
    raw, start, end, _ = language_model.located(texts)
    words = [raw[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    for which in (0, 1):
        h = language_model.word_hashes(raw, start, end, which)
        assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(language_model.ROWS, language_model.CLASSES))
    rows = np.stack([rng.integers(0, language_model.ROWS, 100) for _ in range(3)])
    assert np.allclose(np.exp(language_model.log_classes(rng.normal(size=language_model.CLASSES), w, rows)).sum(1), 1)


# 7


def test_simhash(spark):
    import xxhash

    random.seed(7)
    base = [" ".join(random.choice("abcdefgh") * random.randrange(1, 4) for _ in range(random.randrange(1, 60))) for _ in range(40)]
    rows = [*EDGES, *[(100 + i, (t := random.choice(base)) if random.random() < 0.5 else t + " " + random.choice("xyz") if (t := random.choice(base)) else t) for i in range(200)]]

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else []))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    ids, prints = np.array([i for i, _ in rows]), np.array([fp(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    label = ids.copy()
    while (label != (new := np.where(near, label[None, :], 1 << 60).min(1))).any():
        label = new
    want = sorted(zip(ids.tolist(), prints.view(np.int64).tolist(), label.tolist(), strict=True))
    got = simhash.near_duplicates(hostile(table(spark, rows))).collect()
    assert sorted((r.doc_id, r.fp, r.component_id) for r in got) == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("part", [4, 4096])
def test_links_of_a_large_key_are_whole(spark, part):
    """Fingerprints in a chain within one key, dealt to several tasks or to one."""
    fps = [0]
    for i in range(60):
        fps.append(fps[-1] ^ (0b1111 << (i % 10)))
    fps = sorted(set(fps))
    df = spark.createDataFrame(list(zip(fps, range(1, len(fps) + 1), strict=True)), "fp long, node long")
    got = components(simhash.near_links(df, part=part)).select("component").distinct().count()
    a = np.array(fps, np.uint64)
    near, label = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, np.arange(len(a))
    while (label != (new := np.where(near, label[None, :], 1 << 40).min(1))).any():
        label = new
    assert got == len(set(label.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 8


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    content = bpe.vocabulary_file()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(content), special_tokens={})
    random.seed(3)
    parts = ["'s", "'t", "'re", "'ll", "'v", "'", " ", "  ", "\n", "\t", "a", "Bé", "9", "²", "!", "日本", "\U0001f600", "s", "ll", "\0", "́", "Ⅷ", "\xa0", "'S"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(40))) for _ in range(3000)] + ["", "a" * 5000, " " * 900, "'" * 300, "xyzq" * 500]
    ids, counts = bpe.encode_texts(texts, content)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [enc.encode_ordinary(t) for t in texts]
    assert all(np.frombuffer(c, "<u4").sum() * 4 == len(i) for c, i in zip(counts, ids, strict=True))
    got = bpe.decode(bpe.encode(hostile(table(spark, EDGES)))).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in EDGES)
    for r in got:
        ends = [0, *np.frombuffer(bytes(r.piece_ends), "<u4").tolist()]
        assert [bytes(r.decoded)[a:b] for a, b in zip(ends, ends[1:], strict=False)] == bpe.pieces_of([r.text or ""])[0]
    one_by_one = bpe.decode(bpe.encode(table(spark, EDGES)).drop("piece_tokens")).collect()
    assert sorted(bytes(r.decoded) for r in one_by_one) == sorted((t or "").encode() for _, t in EDGES)
    assert bpe.encode(table(spark, [])).count() == 0


def test_scan_is_a_prefix_composition():
    of, compose, _, _ = bpe._monoid()
    rng = np.random.default_rng(0)
    for n in (1, 31, 32, 33, 5000):
        x = of[rng.integers(0, len(of), n)]
        want, state = [], None
        for e in x:
            state = e if state is None else compose[state, e]
            want.append(state)
        assert bpe.scan(x, compose).tolist() == want


# 9


def test_exact_duplicates(spark):
    random.seed(9)
    rows = [*EDGES, *[(100 + i, random.choice(["a b", "ab", "a  b", "", " ", "A b", "c d", "cd"])) for i in range(200)]]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    for batches in (1, 3):
        got = exact.exact_duplicates(hostile(table(spark, rows)), batches).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact.exact_duplicates(table(spark, [])).count() == 0


def test_binary_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 5000, 200_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        f = exact.build_filter(keys)
        assert exact.query_filter(f, keys).all()
        assert exact.query_filter(f, rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.006
    assert len(f) < 1.3 * 200_000


# 10


def test_license_scan(spark):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    rows = [*EDGES, (20, "MIT License mit license"), (21, "General  Public-License x Apache\nlicense"), (22, "..."), (23, "x\nThis work is licenced under the GNU General Public License, version 3!"), (24, "Licensed under CC BY-NC 4.0."), (25, "all rights\nreserved")]
    for t in [t for _, t in licenses.TEMPLATES]:
        w = t.split()
        rows += [(100 + len(rows) + j, " ".join(w[: int(len(w) * x)])) for j, x in enumerate((0.7, 0.85, 1.0))]
    sets = [(label, set(words(t))) for label, t in licenses.TEMPLATES]
    got = {r.doc_id: r for r in licenses.scan(hostile(table(spark, rows))).collect()}
    for i, t in rows:
        w = words(t)
        places = sorted((j, k) for k, p in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        held = set()
        for line in (t or "").split("\n"):
            share = [(len(set(words(line)) & s) / len(s), label) for label, s in sets]
            held |= {(label, c) for c, label in share if c >= 0.8 - 1e-9 and c == max(share)[0]}
        assert got[i].n_words == len(w) and sorted((x["at"], x["label"]) for x in got[i].places) == places
        assert {(x["label"], x["containment"]) for x in got[i].held} == held
    assert licenses.scan(table(spark, [])).count() == 0


def test_license_scan_keeps_two_notices_of_one_line(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 50)
    rows = [(1, f"{mit}. Licensed under the Apache License 2.0"), (2, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: {x["label"] for x in r.held} for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {1: {"mit", "apache-2.0"}, 2: {"gpl-3.0"}}


def test_license_scan_finds_wrapped_notices(spark):
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        for k, width in enumerate((12, 40, 72)):
            rows.append((10 * i + k, "Some file.\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, width, break_long_words=False)) + "\n\nOther words."))
    rows += [(500, "all rights\n" + "filler " * 30 + "\nreserved"), (501, "This\nwork is licensed under the GNU General Public License, version\n3."), (502, "\n" * 5000 + "All rights" + "\n" * 5000 + "reserved.")]
    got = {r.doc_id: {(x["label"], x["containment"]) for x in r.held} for r in licenses.scan(table(spark, rows), across_lines=True).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        for k in range(3):
            assert (label, 1.0) in got[10 * i + k]
    assert got[500] == set() and {x for x, _ in got[501]} == {"gpl-3.0"} and got[502] == {("proprietary", 1.0)}


def test_texts_of_a_repeated_or_missing_id_are_judged_one_by_one(spark):
    a, b, c, d = (f"{x} " + x * 70 for x in ("some text", "quite another", "third thing", "last of all"))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (9, d), (5, b), (None, None)]
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffixes.repeated_passages(table(spark, rows)).collect())
    assert got == sorted([(1, len(a), 0), (5, len(a), len(a)), (5, len(b), 0), (5, len(b), 0), (99, len(a), len(a)), (99, len(c), 0), (9, len(d), 0), (99, 0, 0)])


def test_language_model_does_not_depend_on_the_order_of_rows(spark):
    random.seed(44)
    rows = [(i, " ".join(f"w{int(300 * random.random() ** 2)}" for _ in range(60))) for i in range(900)] + [(None, "no id"), (7, "again"), (7, "and again")]
    score = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.score) for r in language_model.score_texts(df).collect())
    assert score(table(spark, rows).repartition(2)) == score(table(spark, rows[::-1]).repartition(7))
