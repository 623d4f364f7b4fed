"""Range lookups, the last observation before a position, and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_lookup(rows: DataFrame, ranges: DataFrame, key: str, width: int) -> DataFrame:
    """rows with the columns of the range (start, end, ...) that holds their key; rows outside all ranges go.

    Both sides meet on blocks of ``width`` numbers, so no pair is tried that is not near; a range stands in every block it touches."""
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    met = rows.withColumn("_block", F.floor(F.col(key) / width)).join(blocks, "_block")
    return met.where((F.col(key) >= F.col("start")) & (F.col(key) <= F.col("end"))).drop("_block")


#: A group of more rows than this is dealt to several tasks.
LONG_GROUP = 100_000


def carried(rows: DataFrame, group: str, order: str, values: dict[str, Column], long: int = LONG_GROUP) -> DataFrame:
    """rows with, by name, the last value of each kind that is not null at the greatest position up to their own.

    A group of up to ``long`` rows is one window. The rows of longer ones are dealt by ranges of positions: each range looks back within
    itself, and what it begins with comes from the ranges before it, of which a group has one row each."""
    own = lambda df, by: df.withColumns({n: F.last(v, ignorenulls=True).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for n, v in values.items()})
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > long).select("_g")
    from textloom.sources.sinks import scratch

    sizes = scratch(sizes)
    if sizes.isEmpty():
        return own(rows, Window.partitionBy(group))
    same = lambda df: df.join(sizes, F.col(group).eqNullSafe(F.col("_g")), "left_semi")
    short = rows.join(sizes, F.col(group).eqNullSafe(F.col("_g")), "left_anti")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch(same(rows).repartitionByRange(parts, group, order).withColumn("_p", F.spark_partition_id()))
    at_end = {f"_last {n}": F.max_by(v, F.when(v.isNotNull(), F.col(order))) for n, v in values.items()}
    ends = dealt.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(*[c.alias(n) for n, c in at_end.items()])
    before = Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_g", "_q", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in at_end])
    met = own(dealt, Window.partitionBy("_p", group)).join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")), "left")
    met = met.withColumns({n: F.coalesce(n, f"_last {n}") for n in values})
    return own(short, Window.partitionBy(group)).unionByName(met.select(*rows.columns, *values))


def last_observation(rows: DataFrame, group: str, order: str, value: str, long: int = LONG_GROUP) -> DataFrame:
    """rows with found, covers_from and covers_to: the value at the greatest position up to their own that has one. An empty text is none."""
    v = F.nullif(F.col(value), F.lit(""))
    out = carried(rows, group, order, {"found": v, "covers_from": F.when(v.isNotNull(), F.col(order))}, long)
    return out.withColumn("covers_to", F.when(F.col("found").isNotNull(), F.col(order)))


def number_range(prefix: Column, start: Column, end: Column) -> Column:
    """Identifiers prefix:start to prefix:end."""
    return F.transform(F.sequence(start, end), lambda i: F.concat_ws(":", prefix, i.cast("string")))


def daily_pick(day: Column, n: int) -> Column:
    """A number under n that changes with the day."""
    return F.pmod(F.unix_date(day), F.lit(n))


def numbered(rows: DataFrame, order: list[Column], name: str = "serial") -> DataFrame:
    """rows numbered from 1 without gaps in a total order. Ranges are numbered apart and shifted by the sizes before them, so no task
    holds all rows."""
    spread = rows.select(F.struct(*order).alias("_o"), F.struct(*rows.columns).alias("_r")).orderBy("_o").withColumn("_p", F.spark_partition_id())
    from textloom.sources.sinks import scratch

    kept = scratch(spread)
    sizes = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.withColumn("before", F.sum("n").over(Window.orderBy("_p")) - F.col("n")).select("_p", "before")  # one row a partition
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
    return kept.join(F.broadcast(shift), "_p").withColumn(name, own + F.col("before")).select(name, "_r.*")
