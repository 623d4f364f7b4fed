"""What a task of an overlap join holds."""

from pyspark.sql import functions as F

from textloom.operators import index, overlap


def test_parts_grow_with_meetings(spark, monkeypatch):
    """A term that all have meets in one task; the pairs that it makes must not be summed there."""
    monkeypatch.setattr(overlap, "ROWS_A_TASK", 500)
    a = spark.range(20).select("id", F.explode(F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 5))).alias("term"))
    c = spark.range(1000, 1600).select("id", F.explode(F.array(F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 7))).alias("term"))
    found = overlap.weighted_overlap(a, c, index.idf_table(a.unionAll(c), 620))
    parts = found.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert found.count() == 20 * 600 and parts[0] <= 5 * 500 and parts[1] > 8
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    exchange = plan.index("hashpartitioning(cand")
    assert "partial_sum(w" in plan[:exchange] and "partial_sum(w" not in plan[exchange : plan.index("sortmergejoin", exchange) if "sortmergejoin" in plan[exchange:] else plan.index("broadcasthashjoin", exchange)]
    k = {(r.anchor, r.cand): r.k for r in found.collect()}
    assert all(n == 1 + (i % 5 == j % 7) for (i, j), n in k.items())
