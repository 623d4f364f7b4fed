"""Set-overlap joins over inverted lists, weighted by IDF.

Both sides are exploded to (id, term) rows and meet on the term. The weight of a union follows from three sums, so unions are not
built, and per-document sums are aggregated once before the join. A term in very many documents on both sides makes that many pairs:
give ``max_df`` to leave such terms out, which changes the result and is therefore never done silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import calibrated_percentage, jaccard, minmax01, recall


#: Rows that one task of an overlap join is meant to read: terms of candidates, or meetings of an anchor and a candidate at a term.
ROWS_A_TASK = 1_000_000


def _dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Dealt by key to as many parts as the rows need, so that what a task holds does not grow with the input."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), key)


def meetings(anchors: DataFrame, candidates: DataFrame) -> tuple[int, int]:
    """Rows of the candidates, and how often an anchor and a candidate meet at a term."""
    count = lambda df, name: df.groupBy("term").agg(F.count(F.lit(1)).alias(name))
    met = count(candidates, "cs").join(count(anchors, "as"), "term", "left").agg(F.sum("cs"), F.sum(F.col("cs") * F.col("as"))).first()
    return met[0] or 0, met[1] or 0


def weighted_overlap(anchors: DataFrame, candidates: DataFrame, weights: DataFrame, same: bool = False) -> DataFrame:
    """anchor, cand, k (shared terms), inter, base and other (sums of weights), recall, jaccard.

    anchors, candidates: id, term, different terms of each id. weights: term, idf; a term without a weight weighs 1. same: the two
    are one corpus and an id does not meet itself. Meetings are dealt by candidate before they are summed: sums of a frequent term's task
    would hold all its pairs."""
    rows, times = meetings(anchors, candidates)
    w = lambda df, key: df.select(F.col("id").alias(key), "term").join(weights.select("term", "idf"), "term", "left").select(key, "term", F.coalesce("idf", F.lit(1.0)).alias("w"))
    a, c = w(anchors, "anchor"), w(_dealt(candidates, rows, "term"), "cand")
    base, other = a.groupBy("anchor").agg(F.sum("w").alias("base")), c.groupBy("cand").agg(F.sum("w").alias("other"))
    met = a.join(c.select("cand", "term"), "term")
    if same:
        met = met.where("anchor <> cand")
    pairs = _dealt(met, times, "cand").groupBy("anchor", "cand").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("inter"))
    pairs = pairs.join(base, "anchor").join(other, "cand")
    return pairs.withColumn("recall", recall(F.col("inter"), F.col("base"))).withColumn("jaccard", jaccard(F.col("inter"), F.col("base"), F.col("other")))


def cut_frequent(term_rows: DataFrame, max_df: int) -> DataFrame:
    """Without terms that more than max_df documents have."""
    df = term_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= max_df).select("term")
    return term_rows.join(df, "term", "left_semi")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order, with their rank. Catalyst cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_same_corpus(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of one corpus with at least ``least`` shared roots: raw and score. Unbounded: every such pair."""
    p = pairs.where(F.col("k") >= least)
    raw = 0.55 * minmax01(F.col("jaccard"), 0.06, 0.70) + 0.30 * minmax01(F.col("recall"), 0.12, 0.95) + 0.15 * minmax01(F.col("k"), 2, 7)
    return p.withColumn("raw", raw).withColumn("score", calibrated_percentage(F.col("raw"), 0.10, 0.92, 1.08))


class CrossScores:
    """The lexical score of a pair of two corpora. It grows with the Jaccard coefficient, the recall and the number of shared terms."""

    def raw(self, jaccard: Column, recall: Column, k: Column) -> Column:
        return 0.45 * minmax01(jaccard, 0.02, 0.45) + 0.35 * minmax01(recall, 0.05, 0.90) + 0.20 * minmax01(k, 1, 6)

    def score(self, raw: Column) -> Column:
        return calibrated_percentage(raw, 0.08, 0.85, 1.10)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pairs (jaccard, recall, k) with raw and score."""
        return pairs.withColumn("raw", self.raw(F.col("jaccard"), F.col("recall"), F.col("k"))).withColumn("score", self.score(F.col("raw")))


cross_scores = CrossScores()


def lexical_cross_corpus(pairs: DataFrame, k: int = 50) -> DataFrame:
    """The best k candidates of each anchor with any shared token: raw, score, rank. From all pairs; bounded.TopOverlap gives the same
    without making them."""
    return top_k(cross_scores(pairs), ["anchor"], [F.desc("score"), F.desc("k"), F.asc("cand")], k)


def shared_terms(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, weights: DataFrame, n: int = 8) -> DataFrame:
    """anchor, cand, shared: up to n shared terms of each pair, the rarest first, equal ones by name."""
    a = pairs.select("anchor", "cand").join(anchors.select(F.col("id").alias("anchor"), "term"), "anchor")
    both = a.join(candidates.select(F.col("id").alias("cand"), "term"), ["cand", "term"]).join(weights.select("term", "idf"), "term", "left")
    order = F.struct((-F.round(F.coalesce("idf", F.lit(1.0)), 9)).alias("w"), F.col("term").alias("term"))
    return both.groupBy("anchor", "cand").agg(F.transform(F.slice(F.sort_array(F.collect_list(order)), 1, n), lambda x: x["term"]).alias("shared"))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """All pairs of each anchor in the order in which they are stored: shared roots, score, then the id."""
    w = Window.partitionBy("anchor").orderBy(F.desc("k"), F.desc("score"), F.asc("cand"))
    return pairs.withColumn("rank", F.row_number().over(w))


def first_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The first n pairs of each anchor by score; equal ones stay in the order of the list: shared roots, then the id."""
    return top_k(pairs, ["anchor"], [F.desc("score"), F.desc("k"), F.asc("cand")], n)


def shared_by_kind(pairs: DataFrame, kinds: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]], n: int = 8) -> DataFrame:
    """anchor, cand, shared: up to n shared terms of each pair, those of the first kind before those of the next, in a kind the rarest first,
    equal ones by name. Generic terms are left out unless a pair shares no others. kinds: terms of anchors and of candidates (id, term),
    weights (term, idf) and generic terms."""
    rows = None
    for place, (left, right, weights, generic) in enumerate(kinds):
        a = pairs.select("anchor", "cand").join(left.select(F.col("id").alias("anchor"), "term"), "anchor")
        both = a.join(right.select(F.col("id").alias("cand"), "term"), ["cand", "term"]).join(weights.select("term", "idf"), "term", "left")
        both = both.join(generic.select("term", F.lit(1).alias("is_generic")), "term", "left")
        w = (-F.round(F.coalesce("idf", F.lit(1.0)), 9)).alias("w")
        both = both.select("anchor", "cand", F.struct(F.lit(place).alias("place"), w, "term").alias("x"), F.col("is_generic").isNotNull().alias("generic"))
        rows = both if rows is None else rows.unionAll(both)
    said = rows.groupBy("anchor", "cand").agg(F.collect_list(F.when(~F.col("generic"), F.col("x"))).alias("own"), F.collect_list("x").alias("every"))
    best = F.slice(F.array_sort(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every"))), 1, n)
    return said.select("anchor", "cand", F.transform(best, lambda x: x["term"]).alias("shared"))
