"""Queries over sources and sinks: tables are written in a format to the shared folder and read again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from textloom.functions.text import STOPWORDS_AR, normalized_ar
from textloom.operators import relations
from textloom.plans.catalogue import query
from textloom.plans.tables import table
from textloom.sources import http, readers, sinks


def place(spark, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_encoded", "SELECT CAST(doc_id AS VARCHAR) AS serial, lang || ' é “' || source || '”' AS text, 'Unknown' AS book FROM documents")
def csv_encoded(spark, sf_dir):
    """CSV of unknown encoding and header: the first path that is there, columns by their other names, a default for the one that is missing."""
    path = place(spark, "csv")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Serial_No"), F.concat("lang", F.lit(" é “"), "source", F.lit("”")).alias(" TEXT "))
    readers.all_charsets(spark)
    d.write.option("header", True).option("encoding", "windows-1256").option("ignoreLeadingWhiteSpace", False).csv(path)
    df = readers.read_csv(spark, readers.required(spark, path + "-none", path))
    return readers.resolve(df, {"serial": ["id", "serial no"], "text": ["text", "english text"], "book": ["book"]}, defaults={"book": "Unknown"})


@query("worksheet_rows", "SELECT n_name AS word, CAST(n_regionkey AS INTEGER) AS \"group\", CAST(n_nationkey AS INTEGER) AS number FROM nation")
def worksheet_rows(spark, sf_dir):
    """A worksheet as pandas reads it: rows without an id, or with one of another form, fall out."""
    import pandas as pd

    n = table(spark, sf_dir, "nation").select(F.concat_ws(":", "n_regionkey", "n_nationkey").alias("Verse"), F.col("n_name").alias("word")).toPandas()
    frame = pd.concat([n, pd.DataFrame({"Verse": [None, "total", "1.5"], "word": ["x", "y", "z"]})])
    return readers.worksheet(spark, frame).select("word", "group", "number")


@query("json_array", "SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS note FROM nation")
def json_array(spark, sf_dir):
    path = place(spark, "array")
    rows = F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)  # an array a file
    return readers.read_json_array(spark, path, "id int, name string, note string")


@query("json_map_shards", """
WITH s AS (SELECT CAST(s_suppkey % 10 AS INTEGER) AS shard, CAST(s_suppkey AS VARCHAR) AS id, s_name AS text FROM supplier), r AS (SELECT shard, id, text FROM s UNION ALL SELECT 10, id, 'last ' || text FROM s WHERE shard = 3)
SELECT id, arg_max(text, shard) AS text FROM r GROUP BY id""")  # fmt: skip
def json_map_shards(spark, sf_dir):
    """Objects in shards, one of them empty; of an id in two the last shard wins."""
    base = place(spark, "maps")
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).cast("int").alias("shard"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("text"))
    every = s.unionAll(s.where("shard = 3").select(F.lit(10), "id", F.concat(F.lit("last "), "text")))
    maps = every.groupBy("shard").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "text")))).alias("value"))
    maps.write.option("maxRecordsPerFile", 1).partitionBy("shard").text(base)
    spark.createDataFrame([("{}",)], "value string").coalesce(1).write.text(f"{base}/shard=11")
    files = {r["shard"]: r["file"] for r in spark.read.text(base).select("shard", F.input_file_name().alias("file")).distinct().collect()}  # one of each shard
    return readers.read_all_shards(spark, [files[k] for k in sorted(files)])


@query("json_compact", "SELECT doc_id, lang, source FROM documents")
def json_compact(spark, sf_dir):
    path = place(spark, "json")
    sinks.write_json(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), path)
    return spark.read.schema("doc_id long, lang string, source string").json(path)


@query("range_shards", "SELECT CAST(floor((o_orderkey - 1) / 1000.0) AS BIGINT) AS block, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def range_shards(spark, sf_dir):
    """Shards of a thousand serial numbers, as they stand in the files."""
    path = place(spark, "ranges")
    sinks.shard_by_range(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", path)
    back = spark.read.schema("o_orderkey long, o_orderstatus string, block long").json(path)
    return back.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("line_list", "SELECT DISTINCT p_brand AS word FROM part")
def line_list(spark, sf_dir):
    path = place(spark, "lines")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("value"))
    p.unionAll(spark.createDataFrame([("# a comment",), ("",), ("   ",)], "value string")).write.text(path)
    return readers.read_line_list(spark, path)


AR_WORDS = sorted({normalized_ar(w) for w in STOPWORDS_AR})


@query("default_list", "SELECT word FROM (VALUES " + ", ".join(f"('{w}')" for w in AR_WORDS) + ") AS t(word)")
def default_list(spark, sf_dir):
    """The stopword file is written where it is missing, and read as it is where it is not."""
    path = place(spark, "words")
    readers.bootstrap_list(spark, path, [normalized_ar(w) for w in STOPWORDS_AR])
    return readers.bootstrap_list(spark, path, ["other"])


def _served(url: str, total: int = 1200) -> bytes:
    """A paged address without a network: records 0 to total - 1."""
    args = dict(x.split("=") for x in url.split("?")[1].split("&"))
    page, size, first = int(args["page"]), int(args["per_page"]), int(args["first"])
    rows = [{"id": first + i, "text": f"t{i}"} for i in range((page - 1) * size, min(total, page * size))]
    return json.dumps({"rows": rows, "pagination": {"next_page": page + 1 if page * size < total else None}}).encode()


@query("http_pages", "SELECT id, 't' || (id % 10000) AS text FROM (SELECT range AS id FROM range(0, 1200) UNION ALL SELECT range FROM range(10000, 11200))")
def http_pages(spark, sf_dir):
    urls = [f"local://rows?first={i}" for i in (0, 10000)]
    return http.read_pages(spark, urls, "rows", "id long, text string", _served, delay=0.0).select("id", "text")


@query("vector_records", "SELECT vec_id AS point_id, label, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS d1 FROM embeddings")
def vector_records(spark, sf_dir):
    """A collection's table: it replaces what is there."""
    path = place(spark, "vectors")
    records = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding", "label")
    for _ in range(2):
        sinks.vector_table(records, {"en": "embedding"}, ["label"], path)
    return spark.read.parquet(path).select("point_id", "payload.label", F.size("en").alias("dims"), F.round(F.get("en", F.lit(0)).cast("double"), 6).alias("d1"))


@query("vector_batches", "SELECT CAST(sum(n) AS BIGINT) AS records, max(n) <= 256 AS bounded FROM (SELECT count(*) AS n FROM embeddings GROUP BY vec_id // 256)")
def vector_batches(spark, sf_dir):
    """Upserts go out in batches of up to 256 records."""
    sent = sinks.upsert_batches(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "embedding"), lambda rows: None)
    return sent.agg(F.sum("n").alias("records"), (F.max("n") <= 256).alias("bounded"))


@query("written_once", "SELECT * FROM (VALUES (0, 'planned'), (1, 'written'), (2, 'skipped'), (3, 'written')) AS t(step, status)")
def written_once(spark, sf_dir):
    """A write that can be repeated: a dry run plans, a second run skips, a forced one writes."""
    path, d = place(spark, "once"), table(spark, sf_dir, "region")
    said = [sinks.write_idempotent(d, path, **k) for k in ({"dry_run": True}, {}, {}, {"force": True})]
    return spark.createDataFrame(list(enumerate(said)), "step int, status string")


@query("item_batches", """
WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS item, CASE WHEN trim(text) <> '' THEN text END AS content, lang = 'en' AS first FROM documents),
b AS (SELECT 1 AS batch, item, CASE WHEN content IS NULL THEN 'failed' ELSE 'written' END AS status FROM i WHERE first
  UNION ALL SELECT 2, item, CASE WHEN first AND content IS NOT NULL THEN 'skipped' WHEN content IS NULL THEN 'failed' ELSE 'written' END FROM i
  UNION ALL SELECT 3, item, CASE WHEN content IS NULL THEN 'failed' ELSE 'written' END FROM i)
SELECT batch, count(*) FILTER (status = 'written') AS written, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM b GROUP BY batch""")  # fmt: skip
def item_batches(spark, sf_dir):
    """English documents go into a store, then all of them, then all by force: what each batch wrote, skipped and failed to write."""
    store = sinks.ItemStore(spark, place(spark, "items"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("content"), "lang")
    for rows, force in ((docs.where("lang = 'en'"), False), (docs, False), (docs, True)):
        store.put(rows, force)
    return store.counts()


@query("numeric_strict", "SELECT c_custkey, CAST(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number FROM customer")
def numeric_strict(spark, sf_dir):
    return relations.numeric_strict(table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "[0-9]+", 0).alias("number")), ["number"])


@query("replaced_block", """SELECT page_id, md5(CASE WHEN strpos(html, '<title>') > 0 AND strpos(substring(html, strpos(html, '<title>') + 7), '</title>') > 0
  THEN substring(html, 1, strpos(html, '<title>') + 6) || url || substring(html, strpos(html, '<title>') + 6 + strpos(substring(html, strpos(html, '<title>') + 7), '</title>')) ELSE html END) AS h FROM pages""")  # fmt: skip
def replaced_block(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(readers.replace_block("html", "<title>", "</title>", "url")).alias("h"))
