"""Term statistics and inverted indexes over documents (id, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import trigrams


def terms(docs: DataFrame, tokens: str = "tokens", key: str = "id") -> DataFrame:
    """key, term: each different term of a document once."""
    return docs.select(F.col(key), F.explode(F.array_distinct(F.col(tokens))).alias("term"))


def document_frequency(term_rows: DataFrame) -> DataFrame:
    """term, df. A document counts once for a term; the sum is partial before the shuffle."""
    return term_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def smoothed_idf(df: Column, n: Column) -> Column:
    """1 + ln((1 + n) / (1 + df)); n counts all documents, those without a term too."""
    return 1.0 + F.log((1.0 + n) / (1.0 + df))


def idf_table(term_rows: DataFrame, n_docs: int | Column) -> DataFrame:
    """term, df, idf. n_docs: a number or a scalar subquery."""
    n = n_docs.cast("double") if isinstance(n_docs, Column) else F.lit(float(n_docs))
    return document_frequency(term_rows).withColumn("idf", smoothed_idf(F.col("df"), n))


def generic_terms(df: DataFrame, n_docs: int, ratio: float) -> DataFrame:
    """Terms that at least ``ratio`` of all documents have."""
    return df.where(F.col("df") / F.lit(float(max(1, n_docs))) >= ratio)


def postings(term_rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """term, ids: the documents of a term in the order of ``order`` (the id itself by default)."""
    o = F.col(order or key)
    return term_rows.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct(o.alias("o"), F.col(key).alias("k")))), lambda x: x["k"]).alias("ids"))


def trigram_index(term_rows: DataFrame) -> DataFrame:
    """trigram, tokens: the vocabulary by trigram, a token once for each different trigram."""
    vocabulary = term_rows.select("term").distinct()
    pairs = vocabulary.select("term", F.explode(F.array_distinct(trigrams(F.col("term")))).alias("trigram"))
    return pairs.groupBy("trigram").agg(F.sort_array(F.collect_list("term")).alias("tokens"))
