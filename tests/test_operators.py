import math
import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import fuzzy, index, knn, overlap, postings, quality, ranges, relations, semantic


def test_overlap_bounds_and_values(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, term string")
    c = spark.createDataFrame([(7, "x"), (7, "q"), (8, "y"), (8, "x")], "id int, term string")
    w = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "term string, idf double")  # q has no weight and weighs 1
    got = {(r.anchor, r.cand): r for r in overlap.weighted_overlap(a, c, w).collect()}
    assert set(got) == {(1, 7), (1, 8)}
    assert got[1, 7].recall == 2 / 3 and got[1, 7].jaccard == 2 / 4 and got[1, 8].jaccard == 1.0
    assert all(0 <= r.jaccard <= r.recall <= 1 for r in got.values())


def test_top_k_is_a_prefix(spark):
    random.seed(1)
    df = spark.createDataFrame([(random.randrange(3), random.randrange(9), i) for i in range(200)], "g int, s int, i int")
    order = [F.desc("s"), F.asc("i")]
    small, large = (sorted((r.g, r["rank"], r.i) for r in overlap.top_k(df, ["g"], order, k).collect()) for k in (3, 9))
    assert small == [r for r in large if r[1] <= 3]


def test_knn_equals_brute_force_in_any_partitioning(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5)]
    cos = lambda u, v: sum(a * b for a, b in zip(u, v, strict=True)) / ((math.hypot(*u) or 1) * (math.hypot(*v) or 1))
    want = {(i, j) for i, u in rows for j, _ in sorted(((j, -cos(u, v)) for j, v in rows if j != i), key=lambda x: (round(x[1], 12), x[0]))[:4] if i != 60}
    for parts, cell, block in ((1, 1000, None), (7, 20, 5), (3, 1, 7)):
        v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(parts)
        found = [r for r in knn.knn(v, v, 4, same=True, cell_rows=cell, block_rows=block).collect() if r.anchor != 60]
        assert {(r.anchor, r.cand) for r in found} == want and all(math.isclose(r.cosine, cos(rows[r.anchor][1], rows[r.cand][1]), abs_tol=1e-12) for r in found)


def test_knn_passes_cells_over(spark):
    """Clusters far from each other: a query meets the blocks of its own, and equal vectors are settled by id."""
    random.seed(9)
    centre = [[10.0 if i == j else 0.0 for j in range(8)] for i in range(8)]
    rows = [(i, [c + random.gauss(0, 0.1) for c in centre[i % 8]]) for i in range(800)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    plain = knn.knn(v, v, 5, same=True, cell_rows=10**6, block_rows=10**6)
    bounded = knn.knn(v, v, 5, same=True, cell_rows=20, block_rows=30)
    rows = lambda df: sorted((r.anchor, r.cand, r["rank"]) for r in df.collect())
    assert rows(bounded) == rows(plain)
    unit = knn._unit(np.array(centre))
    asked = spark.createDataFrame([(1, 0.9, unit[0].tolist())], "id long, least double, vec array<double>")
    routed = knn._routed(asked, unit, np.zeros(8), np.full(8, 0.2), np.arange(8) * 2, np.full(8, 2)).collect()
    assert routed[0].blocks == [0, 1]
    # of 300 equal vectors a block gives each query k, not all
    met = knn._met(v.where("id >= 1000").selectExpr("0 AS block", "explode(array(0, 1)) AS kind", "id", "-2D AS least", "vec"), 5, True)
    assert met.count() == 5 * 300


def test_knn_of_nothing(spark):
    v = spark.createDataFrame([], "id long, vec array<double>")
    assert knn.knn(v, v, 3).count() == 0


def test_blocking_loses_no_near_term_that_shares_a_trigram(spark, tmp_path):
    terms = ["mercy", "mercies", "merci", "marcy", "grace", "graces", "tracing", "xyz"]
    rows = spark.createDataFrame(list(enumerate(terms)), "id int, term string")
    written = postings.build(rows, f"{tmp_path}/index")
    got = {r.term: r.dist for r in fuzzy.close_tokens(spark.createDataFrame([("mercy",)], "tok string"), written).collect()}
    assert got == {"mercy": 0, "merci": 1, "marcy": 1}  # mercies is three edits away, and two are allowed


def model_same(rows, p=semantic.Same()):  # noqa: B008
    """The scoring of pairs within one corpus in plain Python, without a reranker."""
    mm = lambda x, lo, hi: max(0.0, min(1.0, (x - lo) / (hi - lo)))
    out = []
    for r in rows:
        if r["root_inter"] <= 0 and r["tok_inter"] <= 0 and r["lem_inter"] <= 0:
            continue
        if r["root_count"] == 0 and r["lem_weight"] < 1 and r["tok_weight"] < 1 and r["emb"] < 0.78 and r["tfidf"] < 0.22:
            continue
        if r["root_weight"] <= 0 and r["lem_weight"] <= 0 and r["tfidf"] < 0.12 and r["emb"] < 0.78:
            continue
        core = {k: mm(r[c], lo, hi) for k, (c, lo, hi) in p.cores.items()}
        core["support"] = mm(r["root_weight"] + 0.5 * r["tok_weight"] + 0.9 * r["lem_weight"], 0, 10)
        raw = sum(w * core.get(k, 0.0) for k, w in p.raw.items())
        if r["root_count"] == 0 and r["emb"] < 0.78 and r["tfidf"] < 0.22 or raw < 0.33:
            continue
        out.append((r["anchor"], r["cand"], round(100 * mm(raw, 0.28, 0.88) ** 1.18)))
    return sorted(out)


def test_semantic_pairs_equal_the_model(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        r = {"anchor": i % 20, "cand": i}
        for s in semantic.SIGNALS:
            r[s] = float(random.choice([0, 1, 3])) if s.endswith(("_k", "_generic", "_count")) else random.choice([0.0, random.random(), random.random() * 8 if s.endswith("weight") else random.random()])
        rows.append(r)
    schema = "anchor long, cand long, " + ", ".join(f"{s} double" for s in semantic.SIGNALS)
    df = spark.createDataFrame([tuple(r[c] for c in ("anchor", "cand", *semantic.SIGNALS)) for r in rows], schema)
    got = sorted((r.anchor, r.cand, r.score) for r in semantic.semantic_same_corpus(df).collect())
    assert got == model_same(rows) and got
    assert semantic.semantic_cross_corpus(df).count() > 0


def test_range_and_last_observation(spark):
    rows = spark.createDataFrame([(1,), (1000,), (1001,), (2500,), (9999,)], "k long")
    maps = spark.createDataFrame([(1, 1000, "a"), (1001, 2600, "b")], "start long, end long, file string")
    assert {(r.k, r.file) for r in ranges.range_lookup(rows, maps, "k", 1000).collect()} == {(1, "a"), (1000, "a"), (1001, "b"), (2500, "b")}
    seq = spark.createDataFrame([(1, 1, ""), (1, 2, "x"), (1, 3, None), (2, 1, None)], "g int, n int, t string")
    assert [(r.g, r.n, r.found, r.covers_from, r.covers_to) for r in ranges.last_observation(seq, "g", "n", "t").orderBy("g", "n").collect()] == [
        (1, 1, None, None, None), (1, 2, "x", 2, 2), (1, 3, "x", 2, 3), (2, 1, None, None, None)
    ]


def test_long_groups_are_dealt_to_tasks(spark):
    random.seed(6)
    rows = [(g, n, random.choice(["", None, f"t{n}"]) if n % 7 == 0 else "") for g, size in ((1, 900), (2, 40), (None, 300), (4, 5)) for n in range(size)]
    random.shuffle(rows)
    seq = spark.createDataFrame(rows, "g int, n int, t string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = {long: sorted((tuple(r) for r in ranges.last_observation(seq, "g", "n", "t", long).select("g", "n", "found", "covers_from", "covers_to").collect()), key=key) for long in (10, 100, 10**6)}
    want, last = [], {}
    for g, n, t in sorted(rows, key=key):
        last[g] = (t, n) if t else last.get(g, (None, None))
        want.append((g, n, *last[g], n if last[g][0] else None))
    assert got == dict.fromkeys((10, 100, 10**6), want)


def test_relations(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.status) for r in relations.coverage(a, b, "k").collect()} == {(1, "missing"), (3, "extra")}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {(r.k, r.v) for r in relations.merge_upsert(old, new, "k").collect()} == {(1, "a"), (2, None), (3, "c")}


def test_editions_and_descriptions(spark):
    rows = spark.createDataFrame([(1, "Book 12", "b"), (2, "no number", "b"), (3, "x 12", "c"), (4, "7", None)], "i int, ref string, book string")
    editions = spark.createDataFrame([("b", 12, 1, "first"), ("b", 12, 3, " last "), ("b", 12, 4, "  "), ("c", 13, 1, "other"), (None, 7, 1, "none")], "book string, number int, position int, text string")
    assert [(r.i, r.text) for r in relations.edition_join(rows, "ref", "book", editions).collect()] == [(1, "last")]
    wanted = spark.createDataFrame([("k1", "s1", "L", "A", "en"), ("k2", "s2", "L2", "A2", "ur"), ("k3", "gone", "", "", "")], "key string, slug string, label string, author string, lang string")
    remote = spark.createDataFrame([("s1", 5, "", None, "Urdu"), ("s2", 6, "Name", "Author", "klingon")], "slug string, id int, name string, author string, language string")
    got = sorted(map(tuple, relations.described(wanted, remote, {"urdu": "ur"}).collect()))
    assert got == [("k1", 5, "L", "A", "ur"), ("k2", 6, "Name", "Author", "ur")]


def test_index_and_quality_on_empty_tables(spark):
    docs = spark.createDataFrame([], "id int, tokens array<string>")
    assert index.postings(index.terms(docs)).count() == 0 and index.trigram_index(index.terms(docs)).count() == 0
    empty = spark.createDataFrame([], "k int, t string")
    assert quality.profile(empty, "k", "t").first()["rows"] == 0 and quality.duplicates(empty, ["k"]).count() == 0
