"""The stages against brute force over a small corpus, and the registry."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import EDGES, hostile, table
from textloom.llm import bpe, registry, simhash


def corpus():
    random.seed(11)
    word = lambda: "".join(random.choice("aeiounrstl") for _ in range(random.randrange(2, 8)))
    rows = [(i, " ".join(word() for _ in range(random.randrange(60, 200)))) for i in range(20, 420)]
    item = "an item of the benchmark with quite a few words that nobody would write by chance"
    toxic = [(i, t + " you moron") for i, t in rows[:60]]
    rows = toxic + rows[60:]
    rows += [(1000 + i, t.replace(" ", "  ", 1)) for i, t in rows[100:110]]  # equal without white space, longer
    rows += [(1100 + i, t + " " + word()) for i, t in rows[150:160]]  # near copies
    rows += [(1200, rows[200][1] + " " + item + " " + word())]
    labels = [(i, 1, int("moron" in t)) for i, t in rows]
    return rows + EDGES, labels, [(1, item)]


def test_stages(spark, tmp_path):
    rows, labels, items = corpus()
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {i: t or "" for i, t in rows}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{number}"))
        got = spark.read.parquet(str(tmp_path / f"out{number}"))
        ids = {r.doc_id for r in got.select("doc_id").collect()}
        if number == 0:
            left = {i: t for i, t in left.items() if "moron" not in t}
        elif number == 1:
            best = {}
            for i, t in left.items():
                k = "".join(t.split())
                best[k] = min(best.get(k, (1, 0)), (-len(t), i))
            left = {i: left[i] for _, i in best.values()}
        elif number == 2:
            fps = {i: simhash.fingerprint(t.encode()) for i, t in left.items()}
            label = {i: i for i in fps}
            for _ in range(5):
                label = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4) for i in fps}
            left = {i: t for i, t in left.items() if label[i] == i}
        elif number == 3:
            left = {i: t for i, t in left.items() if items[0][1] not in t}
        assert ids == set(left), name
        if number < 4:
            assert got.columns == docs.columns
            docs = got
    done = {r.doc_id: r for r in got.collect()}
    ids, _ = bpe.encode_texts([left[i] for i in done], bpe.vocabulary_file())
    assert [bytes(r.ids) for r in done.values()] == ids and all(r.round_trip for r in done.values())
    assert all(r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in done.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == set(left)


def tables(spark, path, rows, labels=(), items=()):
    """A folder with the three tables; rows: (doc_id, text)."""
    hostile(table(spark, rows)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_rows_are_told_apart_by_id_and_text(spark, tmp_path):
    item = "why do birds sing so well in the early morning hours"
    random.seed(3)
    word = lambda: "".join(random.choice("aeiounrstl") for _ in range(random.randrange(2, 8)))
    own = [" ".join(word() for _ in range(120)) for _ in range(5)]
    rows = [(1, "abc"), (2, "abc"), (2, own[0]), (2, own[0]), (None, own[1]), (None, own[2]), (None, "abc"), (4, own[3]), (4, own[4] + " " + item), (5, own[0].replace(" ", "")), (6, item)]
    path = tables(spark, tmp_path, rows, items=[(1, item)])
    docs = spark.read.parquet(path + "/documents.parquet")
    left = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()), key=repr)
    copies = corpus_pipeline.drop_exact_copies(spark, docs, path)
    assert copies.columns == docs.columns
    assert left(copies) == sorted([(1, "abc"), (2, own[0]), (0, own[1]), (0, own[2]), (4, own[3]), (4, own[4] + " " + item), (6, item)], key=repr)
    assert left(corpus_pipeline.drop_contaminated(spark, docs, path)) == sorted([(i or 0, t) for i, t in rows if item not in t], key=repr)
    near = left(corpus_pipeline.drop_near_copies(spark, docs, path))
    assert (2, "abc") not in near and (0, "abc") not in near and (1, "abc") in near and near.count((2, own[0])) == 2 and (4, own[3]) in near
    assert corpus_pipeline.run(spark, path).count() == 5  # abc, own 0 to 3


def test_empty_tables(spark, tmp_path):
    path = tables(spark, tmp_path, [])
    docs = spark.read.parquet(path + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0, name
    assert corpus_pipeline.run(spark, path).columns == out.columns
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(path + "/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(path + "/embeddings.parquet")
    for name, q in registry.queries().items():
        assert q(spark, path).count() == 0, name


def test_every_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_queries_run_on_tables(spark):
    for name, q in registry.queries().items():
        df = q(spark, "/root/testdata/sf0.001")
        assert df.select(F.count("doc_id")).first()[0] >= (0 if name.startswith("op4") else 200), name
