"""Identifiers of the form group:number and what a query asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_arabic(c: Column) -> Column:
    return F.regexp_like(c, F.lit("[\u0600-\u06FF]"))


def query_intent(c: Column) -> Column:
    """'id', 'ar' or 'en'; null for an empty query."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(None)).when(F.regexp_like(t, F.lit(r"^\d+\s*[:.\-]\s*\d+")), "id").when(has_arabic(t), "ar").otherwise("en")


def parse_id(c: Column) -> Column:
    """group:number without leading zeros; null for anything else. Only a colon parts the two, unlike in query_intent()."""
    t = F.trim(c)
    part = lambda i: F.regexp_extract(t, r"^(\d+)\s*:\s*(\d+)$", i).cast("bigint").cast("string")
    return F.when(F.regexp_like(t, F.lit(r"^\d+\s*:\s*\d+$")), F.concat_ws(":", part(1), part(2)))


def make_id(*parts: Column, sep: str = ":") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def group_of(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1)).cast("int")


def number_of(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(2)).cast("int")


def id_order(key: Column) -> list[Column]:
    """Sort keys for identifiers as numbers; plain sorting has '10:1' before '2:1'."""
    return [group_of(key).asc(), number_of(key).asc()]
