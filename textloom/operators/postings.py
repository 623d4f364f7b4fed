"""A written inverted index: built once for a table, reused by every search until the table changes.

Its tables lie in folders by a hash of the term, sorted by term, so a search opens the folders of its own terms only:

    lists   bucket, term, block, n, offsets   a stretch of SPAN ids of a term's list; ids are block * SPAN + offset
    terms   bucket, term, df
    grams   bucket, gram, term                the vocabulary by trigram, a row for each pair

No row grows with the corpus: a frequent term has more blocks, not longer ones. What needs only the first ids of a list, or the ids that
several lists share, chooses its blocks by their heads (term, block, n) and reads the offsets of no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import trigrams
from textloom.sources.sinks import scratch, shared_folder

#: Ids that one block spans.
SPAN = 8192
#: Rows of (id, term) or (gram, term) that one folder is meant to hold, and the most folders.
BUCKET_ROWS, MAX_BUCKETS = 4_000_000, 4096


#: Tables of an index; also where one has no rows.
SCHEMAS = {
    "about": "buckets int, rows long",
    "lists": "term string, block long, n int, offsets array<int>, bucket int",
    "terms": "term string, df long, bucket int",
    "grams": "gram string, term string, bucket int",
}


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")


def _bucket(c: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, key: str, rest: list[str], about: tuple[int, int], path: str) -> None:
    """Folders by bucket, sorted. Where a bucket has several parts, a frequent term's blocks are dealt to all of them."""
    buckets, parts = about
    part = F.pmod(F.xxhash64(key, *(F.floor(F.col(c) / 1024) if c == "block" else c for c in rest)), F.lit(parts))
    dealt = rows.withColumn("bucket", _bucket(key, buckets)).repartition(buckets * parts, "bucket", part).sortWithinPartitions("bucket", key, *rest)
    dealt.write.partitionBy("bucket").parquet(path)


def build(term_rows: DataFrame, path: str) -> Postings:
    """Writes the index of (id, term), different terms of each id; ids are whole numbers, rows without id or term are left out."""
    rows = scratch(term_rows.where("id is not null and term is not null").select(F.col("id").cast("long").alias("id"), F.col("term").cast("string").alias("term")))
    lists = rows.withColumn("block", F.expr(f"(id - pmod(id, {SPAN}L)) div {SPAN}L")).groupBy("term", "block")
    lists = lists.agg(F.sort_array(F.collect_set((F.col("id") - F.col("block") * SPAN).cast("int"))).alias("offsets"))
    lists = lists.select("term", "block", F.size("offsets").alias("n"), "offsets")
    total = rows.count()
    buckets = max(8, min(MAX_BUCKETS, total // BUCKET_ROWS))
    about = buckets, max(1, total // (buckets * BUCKET_ROWS))
    _write(lists, "term", ["block"], about, f"{path}/lists")
    spark = rows.sparkSession
    terms = _read(spark, path, "lists").groupBy("term").agg(F.sum("n").alias("df"))
    _write(terms, "term", [], about, f"{path}/terms")
    grams = _read(spark, path, "terms").select(F.explode(F.array_distinct(trigrams(F.col("term")))).alias("gram"), "term")
    _write(grams, "gram", ["term"], about, f"{path}/grams")
    spark.createDataFrame([(buckets, total)], SCHEMAS["about"]).write.parquet(f"{path}/about")
    return Postings(spark, path)


def fingerprint(spark: SparkSession, source: str) -> str:
    """Of the names, sizes and times of a table's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    n, h = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38)"))).first()
    return f"{n}-{h or 0}".replace("--", "-m")


def built(spark: SparkSession, source: str, recipe: str, rows) -> Postings:
    """The index of a table in the cluster's shared folder: the one that is there, or one that is built now of rows(). recipe names how the
    terms come from the table. An index appears under its name only when it is whole."""
    path = f"{shared_folder(spark)}/postings-{recipe}-{fingerprint(spark, source)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        draft = f"{path}-{uuid.uuid4().hex}"
        build(rows(), draft)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), at) and not fs.exists(at):
            raise OSError(f"{draft} could not become {path}")
    return Postings(spark, path)


class Postings:
    """An index that build() wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.buckets = _read(spark, path, "about").first()["buckets"]
        self.lists, self.terms, self.grams = (_read(spark, path, name) for name in ("lists", "terms", "grams"))

    def _keyed(self, wanted: DataFrame, key: str = "term") -> DataFrame:
        # always true: Spark prunes folders by what a join's other side has only if that side is filtered
        return wanted.withColumn("bucket", _bucket(key, self.buckets)).where(F.col("bucket") < self.buckets)

    def known(self, wanted: DataFrame) -> DataFrame:
        """wanted (term and more) with df, where the term is in the index."""
        return self._keyed(wanted).join(self.terms, ["bucket", "term"]).drop("bucket")

    def unknown(self, wanted: DataFrame) -> DataFrame:
        return self._keyed(wanted).join(self.terms, ["bucket", "term"], "left_anti").drop("bucket")

    def near(self, wanted: DataFrame) -> DataFrame:
        """wanted (gram and more) with every term that has the trigram."""
        return self._keyed(wanted, "gram").join(self.grams, ["bucket", "gram"]).drop("bucket")

    def rows(self, wanted: DataFrame) -> DataFrame:
        """wanted (term and more) with the ids of the term."""
        return _opened(self._keyed(wanted).join(self.lists, ["bucket", "term"])).drop("bucket")

    def first(self, wanted: DataFrame, limit: int) -> DataFrame:
        """term, id, rank: the first ids of each term in order. Only blocks that can have them are read."""
        asked = self._keyed(wanted.select("term").distinct())
        before = F.sum("n").over(Window.partitionBy("bucket", "term").orderBy("block")) - F.col("n")
        heads = asked.join(self.lists.select("bucket", "term", "block", "n"), ["bucket", "term"]).withColumn("before", before).where(F.col("before") < limit)
        met = heads.drop("n").join(self.lists, ["bucket", "term", "block"])
        ids = met.select("term", "before", "block", F.posexplode("offsets").alias("at", "offset"))
        return ids.withColumn("rank", (F.col("before") + F.col("at") + 1).cast("int")).where(F.col("rank") <= limit).select("term", (F.col("block") * SPAN + F.col("offset")).alias("id"), "rank")

    def common(self, words: DataFrame) -> DataFrame:
        """qid, id: the ids that have a term of every word. words: qid, pos (a word), term (any of its terms), words (how many). Blocks in
        which a word has no id are passed over by their heads."""
        keyed = self._keyed(words)
        heads = keyed.join(self.lists.select("bucket", "term", "block"), ["bucket", "term"])
        full = heads.groupBy("qid", "block").agg(F.countDistinct("pos").alias("met"), F.max("words").alias("words")).where("met = words").select("qid", "block")
        met = keyed.join(self.lists, ["bucket", "term"]).join(full, ["qid", "block"], "left_semi")
        return _opened(met).groupBy("qid", "id").agg(F.countDistinct("pos").alias("met"), F.max("words").alias("words")).where("met = words").select("qid", "id")


def _opened(blocks: DataFrame) -> DataFrame:
    rest = [c for c in blocks.columns if c not in ("block", "n", "offsets")]
    return blocks.select(*rest, "block", F.explode("offsets").alias("offset")).select(*rest, (F.col("block") * SPAN + F.col("offset")).alias("id"))
