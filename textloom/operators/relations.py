"""Joins with defaults, coverage, bridges, set operations, merges and small window operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ids import group_of, number_of
from textloom.functions.text import trailing_number
from textloom.operators.ranges import carried


def filled(c: Column | str) -> Column:
    """A text, or null where it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def checked_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join of two tables with the same keys; an error names how many are on one side alone."""
    only_left, only_right = left.join(right, key, "left_anti").count(), right.join(left, key, "left_anti").count()
    if only_left or only_right:
        raise ValueError(f"keys differ: {only_left} on the left alone, {only_right} on the right alone")
    return left.join(right, key, "left")


def lookup(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """A left join with a default for each column that the right side lacks."""
    out = left.join(right, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key and status: 'missing' for expected keys that were not found, 'extra' for found ones that were not expected."""
    e, f = expected.select(key).distinct(), found.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("status", F.lit("missing")).unionAll(f.join(e, key, "left_anti").withColumn("status", F.lit("extra")))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: missing, extra and equal."""
    return coverage(a, b, key).agg(F.count(F.when(F.col("status") == "missing", 1)).alias("missing"), F.count(F.when(F.col("status") == "extra", 1)).alias("extra")).withColumn(
        "equal", (F.col("missing") == 0) & (F.col("extra") == 0)
    )


def bridge_in_order(bridge: DataFrame, records: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Records by a bridge table, ids without a record left out; sort by its position."""
    return bridge.join(records, key)


def exploded_list(df: DataFrame, items: str, key: str = "id") -> DataFrame:
    return df.select(*[c for c in df.columns if c != items], F.posexplode(items).alias("pos", key))


def overlay(base: DataFrame, active: DataFrame, key: str, text: str, default: str) -> DataFrame:
    """The active text of each record, or its default where there is none."""
    a = active.select(key, F.col(text).alias("_active"))
    return base.join(a, key, "left").withColumn(text, first_filled("_active", default)).drop("_active")


def merge_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in place of old ones with their key; other old rows stay."""
    columns = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_is_new"))
    return old.join(n, key, "full").select(key, *[F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def batch_lookup(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records of a set of ids, each once; ids without one are left out."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def toggled(stored: Column, keys: Column) -> Column:
    """Symmetric difference: keys that are there go, others come."""
    return F.array_union(F.array_except(stored, keys), F.array_except(keys, stored))


def having_all(pairs: DataFrame, key: str, item: str, n: Column | int) -> DataFrame:
    """Keys that have n different items."""
    return pairs.groupBy(key).agg(F.countDistinct(item).alias("n_items")).where(F.col("n_items") == n)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def grouped_ids(ids: DataFrame, key: str = "id") -> DataFrame:
    """group, ids: identifiers of each group in number order."""
    order = F.sort_array(F.collect_list(F.struct(number_of(F.col(key)).alias("n"), F.col(key).alias("k"))))
    return ids.groupBy(group_of(F.col(key)).alias("group")).agg(F.transform(order, lambda x: x["k"]).alias("ids"))


def joined_notes(notes: DataFrame, group: list[str], order: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Texts of a group in order, joined."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return notes.groupBy(*group).agg(F.array_join(F.transform(rows, lambda x: x["t"]), sep).alias("notes"))


def scaled_to_max(df: DataFrame, value: str, width: int, name: str = "bar") -> DataFrame:
    """Widths of bars: the largest value is ``width``, halves go up."""
    top = df.agg(F.max(value).alias("_top"))  # one row
    return df.crossJoin(F.broadcast(top)).withColumn(name, F.floor(F.col(value) / F.col("_top") * width + 0.5).cast("int")).drop("_top")


def one_of_each(df: DataFrame, group: str, key: str) -> DataFrame:
    """A row of each group that does not depend on order: the one whose key has the least hash."""
    return df.groupBy(group).agg(F.min_by(key, F.md5(F.col(key).cast("string"))).alias(key))


def numeric_strict(df: DataFrame, columns: list[str], kind: str = "bigint") -> DataFrame:
    """Columns as numbers; a value that is none is an error that names it. Null stays null."""
    def number(c):
        n = F.col(c).try_cast(kind)
        return F.when(F.col(c).isNotNull() & n.isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.col(c).cast("string")))).otherwise(n)

    return df.withColumns({c: number(c) for c in columns})


def numeric_coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as integers; rows in which one is no number go."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as bigint)") for c in columns}).dropna(subset=columns)


def running_last(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """The last value that is not null, row by row."""
    return carried(df, group, order, {name: F.col(value)})


def edition_join(rows: DataFrame, reference: str, book: str, editions: DataFrame) -> DataFrame:
    """rows with ``text`` of the edition of their book that has the trailing number of their reference; others go.

    editions: book, number, position, text. Of a number that a book has several times the last text counts, blank ones do not."""
    texts = editions.where(F.trim("text") != "").groupBy(F.col("book").alias("_book"), F.col("number").cast("long").alias("_number")).agg(F.max_by(F.trim("text"), "position").alias("text"))
    numbered = rows.withColumn("_ref", trailing_number(reference))
    return numbered.join(texts, (F.col(book) == F.col("_book")) & (F.col("_ref") == F.col("_number"))).drop("_book", "_number", "_ref")


def described(wanted: DataFrame, remote: DataFrame, languages: dict[str, str]) -> DataFrame:
    """key, id, label, author, lang of wanted sources, from what a remote list says of their slug, or else from the configuration.

    wanted: key, slug and label, author, lang as fallbacks. remote: slug, id, name, author, language. A slug that the list does not have
    gives nothing; a language is named through ``languages``, and falls back if it is not there."""
    known = remote.select("slug", "id", "name", F.col("author").alias("its_author"), F.lower(first_filled("language")).alias("language"))
    met = wanted.join(known, "slug")
    code = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair]) if languages else F.create_map().cast("map<string,string>")
    return met.select("key", "id", first_filled("name", "label").alias("label"), first_filled("its_author", "author").alias("author"), F.coalesce(code[F.coalesce("language", F.lower("lang"))], F.col("lang")).alias("lang"))
