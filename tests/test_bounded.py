"""Bounded overlap joins against the plain ones, which make all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import bounded, index, overlap


def corpus(spark, n, first, vocabulary, longest, seed):
    """Sets with a term in a third of them and others of falling frequency."""
    random.seed(seed)
    rows = set()
    for i in range(first, first + n):
        for _ in range(random.randrange(1, longest)):
            rows.add((i, f"t{int(vocabulary * random.random() ** 3)}"))
        if i % 3 == 0:
            rows |= {(i, "hot"), (i, "warm")}
    return spark.createDataFrame(sorted(rows), "id long, term string")


COLUMNS = ["anchor", "cand", "k", "score", "rank"]


@pytest.mark.parametrize("look, k, full, small", [(1000, 50, 0, 0), (5, 4, 0, 10**6), (1, 200, 0, 0), (1000, 50, 10**9, 0)])
def test_best_equal_those_of_all_pairs(spark, monkeypatch, look, k, full, small):
    monkeypatch.setattr(bounded, "FIRST_LOOK", look)
    monkeypatch.setattr(bounded, "FULL_LOOK", full)
    monkeypatch.setattr(bounded, "SMALL_SIDE", small)
    a, c = corpus(spark, 25, 0, 300, 30, 1), corpus(spark, 400, 1000, 300, 60, 2).unionAll(corpus(spark, 60, 5000, 300, 5, 3))
    idf = index.idf_table(a.unionAll(c), 485).where("term <> 't7'")  # one has no weight
    want = overlap.lexical_cross_corpus(overlap.weighted_overlap(a, c, idf), k)
    top = bounded.TopOverlap(a, c, idf, k)
    rows = lambda df: sorted(tuple(r) for r in df.select(*COLUMNS, F.round("raw", 9), F.round("inter", 9), F.round("jaccard", 9)).collect())
    assert rows(top.best()) == rows(want)


def test_few_pairs_are_scored(spark):
    a, c = corpus(spark, 20, 0, 4000, 40, 4), corpus(spark, 3000, 1000, 4000, 40, 5)
    copies = a.where("id < 10").select((F.col("id") + 9000).alias("id"), "term").withColumn("id", F.explode(F.array(*[F.col("id") * 100 + i for i in range(12)])))
    c = c.unionAll(copies)
    idf = index.idf_table(a.unionAll(c), 3300)
    every = overlap.weighted_overlap(a, c, idf)
    assert 10 * bounded.TopOverlap(a, c, idf, 10).survivors().where("anchor < 10").count() < every.where("anchor < 10").count()


def test_nothing_to_join(spark):
    none = spark.createDataFrame([], "id long, term string")
    some = corpus(spark, 5, 0, 50, 9, 6)
    idf = index.idf_table(some, 5)
    for a, c in ((none, some), (some, none), (none, none)):
        assert bounded.TopOverlap(a, c, idf).best().count() == 0
    assert bounded.pairs_of_two(none, idf).count() == 0


@pytest.mark.parametrize("heavy", [1000, 12, 0])
def test_pairs_of_two_equal_those_of_all_pairs(spark, heavy):
    c = corpus(spark, 150, 0, 60, 14, 7)
    idf = index.idf_table(c, 150)
    want = overlap.weighted_overlap(c, c, idf, same=True).where("k >= 2")
    rows = lambda df: sorted(tuple(r) for r in df.select("anchor", "cand", "k", *[F.round(x, 9) for x in ("inter", "base", "other", "recall", "jaccard")]).collect())
    assert rows(bounded.pairs_of_two(c, idf, heavy)) == rows(want)
