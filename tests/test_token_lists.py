"""Tokens by column steps against the column expression, which looks at every text by itself."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.plans import tables

ODD = [None, "", " ", "The cat 12 a b12 sat", "a\u212ab \u212a9 \u0130x x\u0130 \u0130", "na\u00efve \u00c9t\u00e9 \u0661\u0662 ab\u0661", "x\0y\x85zz\xa0ww", "the", "of 7 to", "\U0001f600ab\U0001f600", "ab\tcd\nef"]


def test_token_lists_equal_the_expression(spark):
    random.seed(3)
    texts = ODD + ["".join(random.choice("abTheK\u212a\u01300 9.\u00e9\u4e00\t") for _ in range(random.randrange(40))) for _ in range(400)]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", tx.tokenize_en("x").alias("t")).orderBy("i").collect()]
    assert tx.token_lists_en(pa.array(texts, pa.string())).to_pylist() == want
    assert tx.token_lists_en(pa.array(texts, pa.string())[5:17]).to_pylist() == want[5:17]
    assert tx.token_lists_en(pa.array([], pa.string())).to_pylist() == []
    assert tx.token_lists_en(pa.array([None, None], pa.string())).to_pylist() == [[], []]


def test_texts_are_tokenised_without_patterns(spark):
    """Patterns took half the time of every query over the terms of documents."""
    df = tables.documents(spark, "/root/testdata/sf0.001")
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString().lower()
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", tx.tokenize_en("text"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert df.where(F.col("tokens").isNull()).count() == 0
