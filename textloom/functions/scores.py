"""Scores and vectors, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minmax01(x: Column, low: float, high: float) -> Column:
    """x between low and high as 0 to 1, clamped; 0 if the range is empty."""
    return F.lit(0.0) if high <= low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def calibrated_percentage(raw: Column, low: float, high: float, power: float = 1.2) -> Column:
    """0 to 100, with halves to the even number."""
    return F.bround(F.pow(minmax01(raw, low, high), F.lit(power)) * 100).cast("int")


def display_score(x: Column) -> Column:
    """0 to 100, with halves up; a dash for what is no number."""
    bad = x.isNull() | F.isnan(x)
    return F.when(bad, "—").otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5))).cast("int").cast("string"))


def jaccard(inter: Column, base: Column, other: Column) -> Column:
    """From sums of weights: the union is never built."""
    union = base + other - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def recall(inter: Column, base: Column) -> Column:
    return F.when(base > 0, inter / base).otherwise(0.0)


def diversity_penalty(generic_shared: Column, shared: Column, weight: float = 0.25) -> Column:
    """More of it, the more of what is shared is generic."""
    return F.when(shared > 0, F.lit(weight) * generic_shared / shared).otherwise(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(F.lit(1), F.greatest(a, b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def min_match(n: Column) -> Column:
    """How many of n query tokens must match: three fifths, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(n * 3 / 5)).cast("int")


def tier(x: Column) -> Column:
    return F.when(x >= 0.5, "high").when(x >= 0.2, "mid").otherwise("low")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; the zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def language_blend(first: Column, second: Column, second_text: Column, share: float = 0.70) -> Column:
    """Similarity over two languages; the first alone where the second has no text."""
    return F.when(F.trim(F.coalesce(second_text, F.lit(""))) != "", share * first + (1 - share) * second).otherwise(first)


def vector_preview(v: Column, dims: int = 8, places: int = 4) -> Column:
    return F.transform(F.slice(v.cast("array<double>"), 1, dims), lambda x: F.round(x, places))
