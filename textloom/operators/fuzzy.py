"""Fuzzy search by trigram blocking, edit distance and token votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.scores import min_match
from textloom.functions.text import max_allowed_edits, normalize_en, stem_variants_en, trigrams
from textloom.operators.overlap import top_k
from textloom.operators.postings import Postings


def query_tokens(queries: DataFrame) -> DataFrame:
    """qid, pos, tok of each query's tokens; stopwords stay. queries: qid, query."""
    normal = normalize_en(F.col("query"))
    return queries.where(normal != "").select("qid", F.posexplode(F.split(normal, " ")).alias("pos", "tok"))


def close_tokens(tokens: DataFrame, index: Postings, shortlist: int = 1200, accepted: int = 12) -> DataFrame:
    """tok, term, dist, hits: vocabulary terms near each token.

    tokens: tok. A term's hits are the trigrams, repeats included, that it shares with the token's variants; the shortlist by hits is cut
    by length and by the least edit distance over the variants."""
    variants = tokens.select("tok").distinct().select("tok", F.explode(stem_variants_en(F.col("tok"))).alias("variant"), max_allowed_edits(F.col("tok")).alias("max_ed"))
    grams = variants.select("tok", F.explode(trigrams(F.col("variant"))).alias("gram")).groupBy("tok", "gram").agg(F.count(F.lit(1)).alias("times"))
    hits = index.near(grams).groupBy("tok", "term").agg(F.sum("times").alias("hits"))
    short = top_k(hits, ["tok"], [F.desc("hits"), F.asc(F.length("term")), F.asc("term")], shortlist).drop("rank")
    near = short.join(variants, "tok").where(F.abs(F.length("term") - F.length("variant")) <= F.col("max_ed"))
    near = near.withColumn("d", F.levenshtein("variant", "term")).where(F.col("d") <= F.col("max_ed"))
    best = near.groupBy("tok", "term", "hits", "max_ed").agg(F.min("d").alias("dist"))
    return top_k(best, ["tok"], [F.asc("dist"), F.desc("hits"), F.asc("term")], accepted).select("tok", "term", "dist", "hits", "max_ed")


def fuzzy_search(queries: DataFrame, index: Postings, limit: int = 200, **settings) -> DataFrame:
    """qid, id, score, matched, rank: documents in which enough tokens of the query have a near term."""
    toks = query_tokens(queries)
    near = close_tokens(toks, index, **settings).withColumn("votes", F.col("max_ed") - F.col("dist") + 1 + F.when(F.col("dist") == 0, 2).otherwise(0))
    found = index.rows(toks.join(near.select("tok", "term", "votes"), "tok"))
    score = found.groupBy("qid", "id").agg(F.sum("votes").alias("score"), F.countDistinct("pos").alias("matched"))
    size = toks.groupBy("qid").agg(min_match(F.count(F.lit(1))).alias("needed"))
    kept = score.join(size, "qid").where("matched >= needed")
    return top_k(kept, ["qid"], [F.desc("score"), F.asc("id")], limit).select("qid", "id", "score", "matched", "rank")


def all_words_search(queries: DataFrame, index: Postings, limit: int = 50) -> DataFrame:
    """qid, id, rank: the mobile client's search. A word that is a term gives its documents, another one those of all terms that share a
    trigram with it; a document must have all words. A word under three letters that is no term gives none."""
    words = queries.select("qid", F.posexplode(F.split(F.trim(F.lower("query")), r"\s+")).alias("pos", "term")).where("term <> ''")
    exact = index.known(words).select("qid", "pos", "term")
    open_words = index.unknown(words).where(F.length("term") >= 3)
    grams = open_words.select("qid", "pos", F.explode(F.array_distinct(trigrams(F.col("term")))).alias("gram"))
    near = index.near(grams).select("qid", "pos", "term").distinct()
    size = words.groupBy("qid").agg(F.count(F.lit(1)).alias("words"))
    return top_k(index.common(exact.unionAll(near).join(size, "qid")), ["qid"], [F.asc("id")], limit).select("qid", "id", "rank")
