"""The written index against the rows that it was built of."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import fuzzy, postings, search


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    random.seed(5)
    rows = {(i, f"w{int(80 * random.random() ** 2)}") for i in range(-50, 3000) for _ in range(6)} | {(i * 7, "hot") for i in range(9000)} | {(1 << 40, "w1"), (5, "só"), (6, "")}
    df = spark.createDataFrame([*sorted(rows), (None, "lost"), (3, None)], "id long, term string")
    path = str(tmp_path_factory.mktemp("index"))
    return sorted(rows), postings.build(df, f"{path}/a"), path


def test_lists_have_every_row_in_bounded_blocks(spark, made):
    rows, index, path = made
    opened = index.lists.select("term", "n", F.explode(F.transform("offsets", lambda o: F.col("block") * postings.SPAN + o)).alias("id"))
    assert sorted((r.id, r.term) for r in opened.collect()) == rows
    assert index.lists.agg(F.max(F.size("offsets"))).first()[0] <= postings.SPAN
    assert index.lists.where("term = 'hot'").count() == len({i * 7 // postings.SPAN for i in range(9000)})
    df = {r.term: r.df for r in index.terms.collect()}
    assert df == {t: sum(1 for _, x in rows if x == t) for t in {t for _, t in rows}}


def test_searches_read_what_rows_say(spark, made):
    rows, index, _ = made
    of = lambda t: sorted(i for i, x in rows if x == t)
    wanted = spark.createDataFrame([(1, "hot"), (2, "w1"), (3, "none"), (4, "só")], "qid int, term string")
    got = [(r.qid, r.id) for r in index.rows(wanted).collect()]
    assert sorted(got) == sorted((q, i) for q, t in ((1, "hot"), (2, "w1"), (4, "só")) for i in of(t))
    for limit in (1, 5, 4000):
        first = index.first(wanted, limit)
        assert sorted((r.term, r.id, r["rank"]) for r in first.collect()) == sorted((t, i, k + 1) for t in ("hot", "w1", "só") for k, i in enumerate(of(t)[:limit]))
    words = spark.createDataFrame([(1, 0, "hot", 2), (1, 1, "w1", 2), (1, 1, "w2", 2), (2, 0, "w1", 2), (2, 1, "none", 2)], "qid int, pos int, term string, words long")
    assert sorted((r.qid, r.id) for r in index.common(words).collect()) == [(1, i) for i in sorted(set(of("hot")) & (set(of("w1")) | set(of("w2"))))]
    by = search.by_root(spark.createDataFrame([("w3",)], "word string"), index, 7)
    assert [r.id for r in by.orderBy("rank").collect()] == of("w3")[:7]
    ask = spark.createDataFrame([(1, "hot  w1"), (2, "")], "qid int, query string")
    assert [r.id for r in fuzzy.all_words_search(ask, index).orderBy("rank").collect()] == sorted(set(of("hot")) & set(of("w1")))[:50]


def test_only_folders_of_the_terms_are_read(spark, made):
    rows, index, _ = made
    wanted = spark.createDataFrame([("hot",)], "term string")
    plan = index.rows(F.broadcast(wanted))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_an_index_is_built_once_until_its_table_changes(spark, tmp_path):
    source, calls = f"{tmp_path}/table.parquet", []

    def rows():
        calls.append(1)
        return spark.read.parquet(source)

    spark.createDataFrame([(1, "a")], "id long, term string").write.parquet(source)
    for _ in range(2):
        assert postings.built(spark, source, "test", rows).lists.count() == 1
    assert len(calls) == 1
    time.sleep(1.1)
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, term string").write.mode("overwrite").parquet(source)
    assert postings.built(spark, source, "test", rows).lists.count() == 2 and len(calls) == 2
    assert not [x for x in os.listdir(tmp_path) if "draft" in x]


def test_an_index_of_nothing(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], "id long, term string"), f"{tmp_path}/none")
    wanted = spark.createDataFrame([("a",)], "term string")
    assert index.rows(wanted).count() == index.first(wanted, 3).count() == 0
