"""Data-quality reports: each is a DataFrame of findings or of one row of figures."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ids import has_arabic


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def profile(df: DataFrame, key: str, text: str, short: int = 5) -> DataFrame:
    """One row: rows, different keys, blank, short, and without Arabic letters."""
    t = F.col(text)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.count_if(blank(text)).alias("blank"),
        F.count_if(~blank(text) & (F.length(t) < short)).alias("short"), F.count_if(~blank(text) & ~has_arabic(t)).alias("not_arabic"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key (null equals null) stands more than once, with how often. Counts are partial sums, and meet the rows in a join that
    can be split."""
    n = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(n, same).drop(*[f"_{k}" for k in keys])


def group_sizes(df: DataFrame, group: str, expected: DataFrame) -> DataFrame:
    """Groups whose size is not the expected one; a group on one side alone counts 0 on the other. expected: group, expected."""
    found = df.groupBy(group).agg(F.count(F.lit(1)).alias("found"))
    both = found.join(expected, group, "full").select(group, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("found <> expected")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def conflicting(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one trimmed value."""
    return df.groupBy(*keys).agg(F.countDistinct(F.trim(value)).alias("values")).where("values > 1")


def coverage_ratio(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: expected, covered and percent."""
    e = expected.select(key).distinct().join(found.select(key).distinct().withColumn("_f", F.lit(1)), key, "left")
    return e.agg(F.count(F.lit(1)).alias("expected"), F.count("_f").alias("covered")).withColumn("percent", F.round(F.col("covered") * 100 / F.col("expected"), 2))


def equal_texts(editions: DataFrame, key: str, edition: str, text: str) -> DataFrame:
    """Of each key the editions whose texts are the same: key, first (the smallest of these editions), edition and n (how many). Membership
    stands for the pairs, whose number would be the square of it. Blank texts are left out."""
    d = editions.where(F.trim(text) != "")
    first = d.groupBy(F.col(key).alias("_key"), F.col(text).alias("_text")).agg(F.min(edition).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(first, (F.col(key) == F.col("_key")) & (F.col(text) == F.col("_text"))).select(key, "first", edition, "n")


def spot_checks(texts: DataFrame, expected: DataFrame, key: str, text: str) -> DataFrame:
    """Expected phrases with whether the record's text has them, case aside. expected: key, phrase."""
    return expected.join(texts.select(key, text), key, "left").withColumn("ok", F.coalesce(F.lower(text).contains(F.lower("phrase")), F.lit(False))).select(key, "phrase", "ok")


def span(df: DataFrame, group: str, key: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))


def label_metrics(pairs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query, precision and hard_negative_rate of the first k candidates. pairs: query, cand, rank. gold: query, cand, label (2, 1, 0, -1,
    HN). An extension: the labels exist, the metric does not."""
    first = pairs.where(F.col("rank") <= k).join(gold, ["query", "cand"], "left")
    return first.groupBy("query").agg(
        (F.count_if(F.col("label").isin("1", "2")) / F.count(F.lit(1))).alias("precision"), (F.count_if(F.col("label") == "HN") / F.count(F.lit(1))).alias("hard_negative_rate")
    )


def default_source(sources: DataFrame, prefix: str, preferred: dict[str, str]) -> DataFrame:
    """The source for texts in a language: the preferred one if there is one, else the first of the language, else the first of all.

    sources: pos, name, lang."""
    rank = F.when(F.col("name") == F.lit(preferred.get(prefix)), 0).when(F.col("lang") == prefix, 1).otherwise(2)
    return sources.orderBy(rank, "pos").limit(1).select("name")
