"""Searches: by identifier, by keyword, by root or word, and in two stages with pluggable models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ids import has_arabic, parse_id
from textloom.functions.text import cache_key, normalize_ar, normalize_en, normalize_query
from textloom.models import Reranker, no_reranker
from textloom.operators.knn import knn
from textloom.operators.overlap import top_k
from textloom.operators.postings import Postings


def by_id(queries: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Records that queries name as group:number; others give nothing."""
    return queries.select("qid", parse_id(F.col("query")).alias(key)).where(F.col(key).isNotNull()).join(records, key)


def by_keyword(queries: DataFrame, index: Postings) -> DataFrame:
    """qid, id. The whole normalised query is one index key, so a query of several words finds nothing."""
    return index.rows(queries.select("qid", normalize_ar(F.col("query")).alias("term"))).select("qid", "id")


def by_root(words: DataFrame, index: Postings, limit: int = 200) -> DataFrame:
    """word, id, rank: the documents of a root or word, for grouping and counting. Later blocks of a long list are not read."""
    return index.first(words.select(F.col("word").cast("string").alias("term")), limit).withColumnRenamed("term", "word")


def keyword_flag(text: Column, query: Column) -> Column:
    """Whether any query token of two letters and more is a substring of the normalised text."""
    return F.exists(F.filter(F.split(normalize_en(query), " "), lambda t: F.length(t) >= 2), lambda t: normalize_en(text).contains(t))


def language(query: Column, given: Column | None = None) -> Column:
    found = F.when(has_arabic(query), "ar").otherwise("en")
    return found if given is None else F.when(given.isin("en", "ar"), given).otherwise(found)


def prepared(queries: DataFrame) -> DataFrame:
    """qid, lang, query (normalised) and cache_key of queries that ask for something. queries: qid, query, lang (or null)."""
    q = queries.withColumn("lang", language(F.col("query"), F.col("lang"))).withColumn("query", normalize_query(F.col("query"), F.col("lang"))).where("query <> ''")
    return q.withColumn("cache_key", cache_key(F.col("lang"), F.col("query")))


def smart_search(query_vectors: DataFrame, vectors: DataFrame, records: DataFrame, retrieve: int = 50, give: int = 10, reranker: Reranker = no_reranker) -> DataFrame:
    """qid, id, embed_score, rerank_score, rank and the record: nearest vectors, reranked.

    query_vectors: qid, vec. vectors: id, vec. records: id and payload; a hit without a record keeps its row. Where the reranker has
    no score the cosine takes its place, as it does for all without a reranker; a missing score sorts last."""
    near = knn(query_vectors.select(F.col("qid").alias("id"), "vec"), vectors, retrieve)
    hits = near.select(F.col("anchor").alias("qid"), F.col("cand").alias("id"), F.col("cosine").alias("embed_score"))
    scored = reranker(hits)
    best = top_k(scored, ["qid"], [F.desc(F.coalesce("rerank_score", F.lit(-1.0))), F.asc("id")], give)
    return best.join(records, "id", "left")


def cached_first(prepared_queries: DataFrame, cache: DataFrame, answered: str = "answer", ttl_days: int = 30, now: Column | None = None) -> DataFrame:
    """Queries with their cached answer, or null where there is none that is young enough. cache: cache_key, answer, stored_at."""
    now = F.current_timestamp() if now is None else now
    young = cache.where(F.col("stored_at") >= now - F.expr(f"INTERVAL {ttl_days} DAYS")).select("cache_key", answered)
    return prepared_queries.join(young, "cache_key", "left").withColumn("cached", F.col(answered).isNotNull())


def weak_suggestions(top_score: Column, suggestions: Column, query: Column, least: float = 0.05, n: int = 5) -> Column:
    """Up to n suggestions other than the query where the best score is weak; else none."""
    return F.when(F.coalesce(top_score, F.lit(0.0)) < least, F.slice(F.filter(suggestions, lambda s: s != query), 1, n)).otherwise(F.expr("cast(array() as array<string>)"))
