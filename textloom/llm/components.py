"""Connected components of an edge table by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialise


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long), in any direction, repeats allowed. Returns node, component: the smallest node that it reaches.

    Every step aggregates with partial sums and joins on a node, so a node with many neighbours is never gathered; each
    round's edges are written to the shared folder. Nodes without an edge to another are not returned."""
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the least of them. Every edge has u > v here.
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(m.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, "edges")
        after = _state(new)
        discard(e)
        e = new
        if after == before:
            break
        before = after
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
