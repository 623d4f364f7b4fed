"""Driver tables in the roles that the operators know, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import STOPWORDS_EN, token_lists_en

#: Texts that are tokenised together.
TEXTS_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, as a small file is, dealt out to all of them before heavy work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def token_docs(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """id, tokens (as tokenize_en gives them) of a table's text."""
    texts = spread(table(spark, sf_dir, name).select(F.col(key).alias("id"), "text"))
    return texts.mapInArrow(_tokenised, f"id {texts.schema['id'].dataType.simpleString()}, tokens array<string>")


def _tokenised(batches):
    import pyarrow as pa

    for b in batches:
        for low in range(0, b.num_rows, TEXTS_AT_ONCE):
            part = b.slice(low, TEXTS_AT_ONCE)
            yield pa.RecordBatch.from_arrays([part.column(0), token_lists_en(part.column(1))], ["id", "tokens"])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_docs(spark, sf_dir, "documents", "doc_id")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_docs(spark, sf_dir, "benchmark", "item_id")


STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS_EN)


def tokens_sql(name: str, key: str) -> str:
    return f"""SELECT {key} AS id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '),
      lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({STOP_SQL})) AS tokens FROM {name}"""


#: Tokens and different terms of both corpora, and the smoothed IDF over both.
CORPORA_SQL = f"""
a_docs AS ({tokens_sql("benchmark", "item_id")}), c_docs AS ({tokens_sql("documents", "doc_id")}),
a AS (SELECT id, unnest(list_distinct(tokens)) AS term FROM a_docs), c AS (SELECT id, unnest(list_distinct(tokens)) AS term FROM c_docs),
n AS (SELECT (SELECT count(*) FROM a_docs) + (SELECT count(*) FROM c_docs) AS n),
idf AS (SELECT term, count(*) AS df, 1 + ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) AS idf FROM (SELECT * FROM a UNION ALL SELECT * FROM c) GROUP BY term)
"""


def mm(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, (({x}) - {low}) / ({high} - {low})))"


def cal(x: str, low: float, high: float, power: float) -> str:
    return f"CAST(round_even(pow({mm(x, low, high)}, {power}) * 100, 0) AS INTEGER)"
